"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import block_wand, chosen_path, context_mixing, cross_polytope, dac, gam, mixing, pigeonhole, preference, prefix_trie, rules, suffix_dedup, toxicity
from .common import fold, word_count


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed, report = mixing.mix(docs, F.array("source"), F.col("size"), mixing.weights_by_rank())
    table = spark.createDataFrame([(s, n, report["targets"][s]) for s, n in report["holdings"].items()], "source string, source_size long, target double")
    taken = (F.col("size") * F.size("allocation")).cast("long")
    joined = mixed.withColumn("taken", taken).alias("m").join(F.broadcast(table).alias("t"), F.expr("m.source <=> t.source"))
    return joined.select("doc_id", "size", "source_size", "target", "taken")


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = preference.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    pairs = preference.format_pairs(preference.against_first_reply(conversations))
    return pairs.select("conv_id", "n_shared", "prompt", "chosen_completion", "rejected_completion", F.to_json("chosen_spans").alias("chosen_spans"), F.to_json("rejected_spans").alias("rejected_spans"))


def op3_dac(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return dac.round_trip(documents(spark, sf_dir).select("doc_id", "text"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def _held_out(modulus: int, remainder: int):
    """Condition on doc_id; a null id isn't held out."""
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(False))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = gam.train(docs, labels(spark, sf_dir), fold("__id", 3) != 1)
    held = gam.score(docs, model).withColumn("held_out", _held_out(3, 1))
    return held.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, labels(spark, sf_dir), fold("__id", 5) != 0)
    held = toxicity.score(docs, model).withColumn("held_out", _held_out(5, 0))
    return held.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = context_mixing.score(documents(spark, sf_dir).select("doc_id", "text"), fold("doc_id", 7) != 2)
    return scored.select("doc_id", _held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)


def op11_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op12_block_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_wand.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefix_trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(*prefix_trie.inherit(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_preference": op2_preference,
    "op3_dac": op3_dac,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontamination": op5_decontamination,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_context_mixing": op8_context_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_cross_polytope": op11_cross_polytope,
    "op12_block_wand": op12_block_wand,
    "op13_prefix_trie": op13_prefix_trie,
}

_STOP_LIST = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)

_RENDER = "'<|' || coalesce({x}.role, '') || '|>' || chr(10) || coalesce({x}.text, '') || '<|end|>' || chr(10)"


def _spans_sql(part: str) -> str:
    """Spans of the assistant's turns: each turn is 12 marks and line ends longer than its role and text, plus one line end."""
    size = "(length(coalesce({x}.role, '')) + length(coalesce({x}.text, '')) + 13)"
    before = f"coalesce(list_sum(list_transform({part}[1:i - 1], lambda y: {size.format(x='y')})), 0)"
    head = f"({before} + length(coalesce({part}[i].role, '')) + 5)::BIGINT"
    tail = f"({before} + {size.format(x=f'{part}[i]')} - 1)::BIGINT"
    span = f"""'{{"from":' || {head} || ',"to":' || {tail} || '}}'"""
    return f"'[' || array_to_string(list_transform(list_filter(range(1, len({part}) + 1), lambda i: coalesce({part}[i].role = 'assistant', false)), lambda i: {span}), ',') || ']'"


ORACLE_SQL: dict[str, str] = {
    "op2_preference": f"""
WITH c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT conv_id, t, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')) AS z,
             list_min(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')) AS a FROM c),
p AS (SELECT conv_id, t[1:z] AS chosen, list_append(t[1:z - 1], t[a]) AS rejected, z FROM l WHERE z IS NOT NULL AND t[z] IS DISTINCT FROM t[a]),
n AS (SELECT conv_id, (z - 1)::INTEGER AS n_shared, chosen[1:z - 1] AS pre, chosen[z:] AS cc, rejected[z:] AS rr FROM p)
SELECT conv_id, n_shared, array_to_string(list_transform(pre, lambda x: {_RENDER.format(x="x")}), '') AS prompt,
       array_to_string(list_transform(cc, lambda x: {_RENDER.format(x="x")}), '') AS chosen_completion,
       array_to_string(list_transform(rr, lambda x: {_RENDER.format(x="x")}), '') AS rejected_completion,
       {_spans_sql("cc")} AS chosen_spans, {_spans_sql("rr")} AS rejected_spans
FROM n""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, t, ws, ls, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri FROM w),
r AS (SELECT doc_id, rid, pos, count(*) OVER (PARTITION BY rid, gram) AS n
      FROM (SELECT doc_id, rid, unnest(tri) AS gram, generate_subscripts(tri, 1) AS pos FROM (SELECT *, row_number() OVER () AS rid FROM g))),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM r WHERE n > 1) GROUP BY rid),
m AS (SELECT g.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOP_LIST})))::BIGINT AS n_stop_words
      FROM (SELECT *, row_number() OVER () AS rid FROM g) g LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {rules.verdict_sql()} AS kept
FROM m""",
    "op12_block_wand": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, r, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
a AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM d),
q AS (SELECT item_id, i, term, count(*)::BIGINT AS times FROM
      (SELECT item_id, i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
       FROM (SELECT *, row_number() OVER () AS i FROM benchmark)) GROUP BY ALL),
o AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM o, a GROUP BY term),
s AS (SELECT item_id, i, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl))))::BIGINT AS score
      FROM q JOIN o USING (term) JOIN w USING (term) JOIN d USING (r), a GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20""",
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS part, t.pos, role, text FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.pos <= h
      UNION ALL SELECT h.c, 1, t.pos, role, text FROM h JOIN t ON t.c = h.c AND t.pos > h),
n AS (SELECT c, row_number() OVER w AS d, length(text) AS size, md5(role) || md5(text) AS turn FROM r WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
p AS (SELECT c, d, size, md5(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM n UNION ALL SELECT c, 0, 0, 'root' FROM h),
z AS (SELECT c, max(d) AS d FROM p GROUP BY c),
m AS (SELECT d, k, min(c) AS o, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved FROM p GROUP BY d, k),
u AS (SELECT m.*, q.o AS up, q.k AS up_k FROM m LEFT JOIN p ON p.c = m.o AND p.d = m.d - 1 LEFT JOIN m AS q ON q.d = p.d AND q.k = p.k),
b AS (SELECT d - 1 AS d, up_k AS k, count(*) AS kids FROM u WHERE d > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(kids, 0) AS kids FROM u LEFT JOIN b USING (d, k)),
s AS (SELECT p.d, p.k, sum(v.saved) AS saved, count_if(v.kids = 0) AS leaves FROM v JOIN p ON p.c = v.o AND p.d <= v.d GROUP BY ALL),
e AS (SELECT p.d, p.k, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM z JOIN p USING (c, d) GROUP BY ALL)
SELECT v.o AS conv_id, v.d::BIGINT AS depth, v.up AS parent_conv_id, n_convs::BIGINT AS n_convs, kids::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN s USING (d, k) LEFT JOIN e USING (d, k)""",
}
