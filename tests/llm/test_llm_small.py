"""Operators of the training-data subpackage against brute force on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("shellcluster.llm")

import public_tokenizers
from pyspark.sql import functions as F

from shellcluster.llm import chosen_path, common, context_mixing, dac, gam, mixing, pigeonhole, preference, rules, stream, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, extra string"


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared passages, blanks, nulls, repeated rows and null ids."""
    rng = np.random.default_rng(seed)
    lexicon = [f"w{i}" for i in range(400)] + ["the", "of", "é́t", "Ünd."]
    texts = [" ".join(rng.choice(lexicon, int(rng.integers(1, 120)))) for _ in range(n)]
    passage = " ".join(rng.choice(lexicon, 55))
    texts[3] = texts[2]
    texts[5] = texts[4] + " w1"
    for i in range(10, 25):
        texts[i] = f"{texts[i]}\n{passage} {texts[i]}"
    texts[30], texts[31], texts[32], texts[33] = None, "", " \n\t ", "a b\x0bc\x0c d"
    texts[34] = "again " * 300
    texts[35] = " ".join(rng.choice(lexicon, 5000))
    texts[36] = texts[35] + " tail"
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "x") for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, texts[10], "s0", None), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


# --- 1 --------------------------------------------------------------------------------------


def test_capped_shares_match_repeated_resharing():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = [int(x) for x in rng.integers(1, 1000, 7)]
        weights = [(3, 1, 2)[i % 3] for i in range(7)]
        total, out, fixed = 1.5 * sum(sizes), [0.0] * 7, set()
        while True:
            left, open_ = total - sum(2 * sizes[i] for i in fixed), [i for i in range(7) if i not in fixed]
            for i in open_:
                out[i] = left * weights[i] / sum(weights[j] for j in open_)
            over = {i for i in open_ if out[i] > 2 * sizes[i]}
            for i in over:
                out[i] = 2.0 * sizes[i]
            fixed |= over
            if not over:
                break
        assert np.allclose(mixing.capped_shares(sizes, weights, total, 2), out)


def test_flow_prefers_first_passes_and_meets_quotas():
    capacity = {"a": 100, "ab": 100, "b": 100}
    members = {"a": ["A"], "ab": ["A", "B"], "b": ["B"]}
    flow = mixing.min_cost_flow(capacity, members, {"A": 190, "B": 110}, 2)
    assert sum(v for (_, s), v in flow.items() if s == "A") == 190
    assert sum(v for (_, s), v in flow.items() if s == "B") == 110
    assert sum(flow.get(("ab", s), 0) for s in "AB") == 100  # no pattern is repeated when one pass is enough


def test_mix_meets_targets(docs):
    sized = docs.withColumns({"size": common.word_count(F.col("text")), "segments": F.lit(1), "long_class": F.lit(2), "allocation": F.lit("clash")})
    mixed, report = mixing.mix(sized, F.array("source"), F.col("size"), mixing.weights_by_rank())
    rows = mixed.collect()
    assert len(rows) == docs.count()
    taken = Counter()
    for r in rows:
        assert len(r["allocation"]) <= 2
        for a in r["allocation"]:
            assert a["source"] == r["source"]
            taken[r["source"]] += r["size"]
    largest = max(r["size"] for r in rows)
    for s, target in report["targets"].items():
        assert target <= 2 * report["holdings"][s] + 1e-9
        assert abs(taken[s] - target) <= largest
    again, _ = mixing.mix(sized.repartition(5), F.array("source"), F.col("size"), mixing.weights_by_rank())
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], len(r["allocation"]))
    assert sorted(map(key, rows)) == sorted(map(key, again.collect()))
    assert set(mixing.take(mixed).columns) == set(sized.columns) - {"allocation"}


def test_mix_of_overlapping_sources(spark):
    rows = [(i, ["A", "B"] if i % 2 else ["A"], 10) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    mixed, _ = mixing.mix(table, F.col("sources"), F.col("size"), lambda h: {"A": 3000, "B": 1500})
    taken = Counter()
    for r in mixed.collect():
        for a in r["allocation"]:
            assert a["source"] in r["sources"]
            taken[a["source"]] += 10
    assert abs(taken["A"] - 3000) <= 40 and abs(taken["B"] - 1500) <= 40


def test_mix_empty(empty):
    mixed, _ = mixing.mix(empty, F.array("source"), F.lit(1).cast("long"), mixing.weights_by_rank())
    assert mixed.count() == 0


# --- 2 --------------------------------------------------------------------------------------


def test_preference_pairs(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", "no"), (2, 0, "user", "x"), (3, 0, None, "a"), (3, 1, "assistant", ""), (4, 0, "assistant", "k"), (4, 1, "assistant", "k")]
    talks = preference.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = preference.format_pairs(preference.against_first_reply(talks)).collect()
    assert [r["conv_id"] for r in out] == [1]
    r = out[0]
    assert r["n_shared"] == 3
    assert r["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n"
    for side, text in (("chosen", "no"), ("rejected", "yes")):
        assert r[f"{side}_completion"] == f"<|assistant|>\n{text}<|end|>\n"
        spans = r[f"{side}_spans"]
        assert [r[f"{side}_completion"][s["from"] : s["to"]] for s in spans] == [f"{text}<|end|>"]


def test_preference_prefix_against_brute_force(spark):
    rng = np.random.default_rng(3)
    turn = lambda: (str(rng.choice(["user", "assistant"])), str(rng.choice(["a", "b", "c"])))
    pairs = []
    for i in range(60):
        shared = [turn() for _ in range(int(rng.integers(0, 4)))]
        pairs.append((i, shared + [turn() for _ in range(int(rng.integers(0, 3)))], shared + [turn() for _ in range(int(rng.integers(0, 3)))]))
    pairs += [(98, None, [("user", "a")]), (99, None, None)]
    kind = "id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    for r in preference.format_pairs(spark.createDataFrame(pairs, kind)).collect():
        a, b = [tuple(t) for t in r["chosen"] or []], [tuple(t) for t in r["rejected"] or []]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        render = lambda ts: "".join(f"<|{x}|>\n{y}<|end|>\n" for x, y in ts)
        assert r["n_shared"] == n
        assert (r["prompt"], r["chosen_completion"], r["rejected_completion"]) == (render(a[:n]), render(a[n:]), render(b[n:]))
        assert [r["chosen_completion"][s["from"] : s["to"]] for s in r["chosen_spans"]] == [f"{y}<|end|>" for x, y in a[n:] if x == "assistant"]


# --- 3 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("widths", [(8, 8, 16), (16, 16), (32,), (8, 8, 8, 8)])
def test_codes_round_trip(widths):
    rng = np.random.default_rng(4)
    ids = (rng.integers(0, 2**32, 5000, dtype=np.uint64) >> rng.integers(0, 32, 5000, dtype=np.uint64)).astype(np.uint32)
    starts = np.array([0, 0, 17, 4000, 5000])
    file = dac.Reader(dac.encode(ids, np.arange(4), np.array([True, False, True, True]), starts, widths))
    assert (file.slice(0, 5000) == ids).all()
    for a, b in ((0, 0), (1, 2), (511, 513), (4999, 5000), (100, 3333)):
        assert (file.slice(a, b) == ids[a:b]).all()
    assert [file[i] for i in range(0, 5000, 97)] == ids[::97].tolist()
    assert (file.document(1) == ids[:17]).all() and not len(file.document(0))
    assert file.known.tolist() == [True, False, True, True]


def test_codes_of_nothing():
    assert len(dac.Reader(dac.encode(np.empty(0, np.uint32), np.empty(0), np.empty(0, bool), np.array([0]))).slice(0, 0)) == 0


TRICKY = ["it's 'S don't. a.. b,, x., <|endoftext|>. <|ENDOFTEXT|> a", "H̱ Í i̇ İ", "naïve ÉÉ. é. \xa0x\x1cy z", "12.5 3, #a. -. .", "日本語。 ok", "a.\nb,\tc\x0bd", "K 'll I'LL."]


def test_files_hold_the_tokenizer_ids(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    rows = sorted(dac.round_trip(table, path).collect(), key=lambda r: r["start"])
    tokenizer = Tokenizer.from_file(path)
    ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    expected = Counter((r["doc_id"], len(ids(r["text"])), zlib.crc32(ids(r["text"]).tobytes())) for r in table.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == expected
    at = 0
    for before, r in zip([None, *rows], rows):
        assert r["start"] == at and (before is None or before["doc_id"] is None or r["doc_id"] >= before["doc_id"])
        at += r["n_tokens"]


def test_other_tokenizers_and_empty(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    some = docs.where("doc_id < 12").select("doc_id", "text").distinct()
    got = {r["doc_id"]: r["n_tokens"] for r in dac.round_trip(some, path).collect()}
    assert got == {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in some.collect()}
    assert dac.round_trip(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# --- 4, 7 -----------------------------------------------------------------------------------


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    p = label == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def held_out(spark, module, label, modulus, remainder, sf="/root/testdata/sf0.01"):
    table, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = module.train(table, marks, common.fold("__id", modulus) != remainder)
    seen = module.score(table, model).join(marks, "doc_id").where(common.fold("doc_id", modulus) == remainder).select("score", label).toPandas()
    return seen["score"].to_numpy(), seen[label].to_numpy()


def test_quality_on_held_out(spark):
    score, label = held_out(spark, gam, "quality", 3, 1)
    assert auc(score, label) > 0.9 and ((score >= 0.5) == label).mean() > 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_on_held_out(spark, sf):
    score, label = held_out(spark, toxicity, "toxic", 5, 0, f"/root/testdata/{sf}")
    assert auc(score, label) > 0.9 and ((score >= 0.5) == label).mean() > 0.9


@pytest.mark.parametrize("module", [gam, toxicity])
def test_classifiers_on_odd_rows(spark, docs, empty, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 0), (3, None, None), (4, 7, 7)], "doc_id long, quality int, toxic int")
    model = module.train(docs.withColumn("label", F.lit(5)), labels, F.lit(True))
    rows = module.score(docs.withColumns({"score": F.lit("clash"), "label": F.lit(5)}), model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(empty, model).count() == 0
    # a repeated id, and a table without any labelled document
    again = docs.unionByName(docs)
    assert module.score(again, module.train(again, labels, F.lit(True))).count() == again.count()
    assert all(0 <= r["score"] <= 1 for r in module.score(docs, module.train(empty, labels, F.lit(True))).collect())
    one_sided = module.train(docs, labels.where("doc_id = 1"), F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in module.score(docs, one_sided).collect())


def test_lookup_tables_add_up():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95  # only a pair can tell
    assert any({i, j} == {0, 1} for i, j, *_ in model.pairs)


def test_unseen_misspelling_scores_high():
    rng = np.random.default_rng(6)
    lexicon = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(300)]
    bags, label = [], []
    for i in range(600):
        text = " ".join(rng.choice(lexicon, 7))
        b = toxicity.Bags([text + (" horrible" if i % 2 else "")])
        bags.append(b.gram)
        label.append(i % 2)
    value, bias = toxicity.fit_vectors(bags, np.array(label, float))
    model = toxicity.Model(value, bias, (1.0, 0.0, 0.0))
    clean = " ".join(rng.choice(lexicon, 7))
    logits, _ = model.worst([clean, clean + " horrible", clean + " horribble", "", "\n"])
    assert logits[0] < logits[2] <= logits[1] + 1e-9 or logits[0] < logits[2]
    assert logits[1] > logits[0] + 1


# --- 5 --------------------------------------------------------------------------------------


def edit_search(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = np.random.default_rng(7)
    for _ in range(60):
        item, text = ("".join(rng.choice(list("abc"), int(n))) for n in (rng.integers(1, 90), rng.integers(0, 120)))
        assert pigeonhole.Pattern(item).best(text)[0] == edit_search(item, text)


@pytest.mark.parametrize("chars", [1_000_000, 500, 20])  # 1, 2 or 3, and as many shards as items
def test_matches_against_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(pigeonhole, "SHARD_CHARS", chars)
    rng = np.random.default_rng(8)
    letters = list("abcdefgh ")
    items = ["".join(rng.choice(letters, int(rng.integers(40, 120)))) for _ in range(12)]

    def damage(t, k):
        t = list(t)
        for _ in range(k):
            i = int(rng.integers(0, len(t)))
            t[i : i + 1] = [["x"], [], [t[i], "y"]][int(rng.integers(0, 3))]
        return "".join(t)

    texts = ["".join(rng.choice(letters, 200)) + damage(items[i % 12], i % 8) + "".join(rng.choice(letters, 150)) for i in range(60)] + [None, "", items[0].upper(), "  ".join(items[1].split(" "))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short = "tiny wit"
    texts += [f"a {short}.", f"a{short}", f"x {short}s", short.upper(), "tiny, wit"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (None, items[0]), (52, short)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in pigeonhole.matches(table, bench).collect()}
    expected = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            item = pigeonhole.normalize(item)
            n = edit_search(item, pigeonhole.normalize(t or "")) if t else 999
            if n <= int(len(item) * pigeonhole.ERROR_RATE):
                expected[d, i] = n
                if i == 0:
                    expected[d, None] = n
    # an item too short for an edit counts between word boundaries only
    expected |= {(64, 52): 0, (67, 52): 0}
    assert got == expected
    left = {r["doc_id"] for r in pigeonhole.decontaminate(table.withColumn("item_id", F.lit("clash")), bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in expected}


def test_matches_of_named_items(spark, docs):
    bench = spark.createDataFrame([("q/1", "some passage that no document holds at all"), ("q/2", "tiny wit")], "name string, body string")
    table = spark.createDataFrame([(1, "Tiny  wit", "x"), (2, "some passage that no dokument holds at all", "y"), (None, "tiny wit", "z")], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in pigeonhole.matches(table, bench, item_id="name", item_text="body").collect()}
    assert got == {(1, "q/2", 0), (None, "q/2", 0), (2, "q/1", 1)}


def test_matches_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert pigeonhole.matches(docs, none).count() == 0
    assert pigeonhole.decontaminate(docs, none).count() == docs.count()
    assert pigeonhole.matches(empty, none).count() == 0


# --- 6 --------------------------------------------------------------------------------------


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    degree = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
                if sets[i] != sets[j]:
                    degree[i].add(sets[j])
                    degree[j].add(sets[i])
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[i][0], least[find(i)] if sets[i] else rows[i][0], len(degree[i])) for i in range(len(rows)))


def test_near_duplicates_against_brute_force(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.near_duplicates(docs).collect())
    assert got == near(rows)
    assert chosen_path.near_duplicates(empty).count() == 0


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for i in rng.integers(0, 120, int(rng.integers(0, 3))):
            t[i] = f"x{rng.integers(0, 1000)}"
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice([f"c{i}" for i in range(900)], 60)) for _ in range(50)]
    rows = list(enumerate(texts))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near(rows)


def test_dense_groups_in_blocks(spark, monkeypatch):
    """Chains in which each text is near the next alone, among near copies of one text: with many blocks no link or component is lost."""
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    monkeypatch.setattr(chosen_path, "SMALL", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    rng = np.random.default_rng(10)
    texts = []
    for c in range(3):
        long = [f"{c}w{i}" for i in range(1000)]
        texts += [" ".join(long[i * 14 : i * 14 + 200]) for i in range(50)]
    base = [f"b{i}" for i in range(120)]
    for _ in range(60):
        t = list(base)
        for i in rng.integers(0, 120, int(rng.integers(0, 4))):
            t[i] = f"x{rng.integers(0, 50)}"
        texts.append(" ".join(t))
    texts += texts[:1] * 9 + ["", None, "one", "one"]
    order = rng.permutation(len(texts))
    rows = [(None if i % 40 == 3 else int(order[i]), t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, 7, "c") for i, t in rows], "doc_id long, text string, class int, n string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.near_duplicates(frame).collect())
    assert got == near(rows)


def test_parts_of_a_block():
    rng = np.random.default_rng(11)
    for _ in range(20):
        n = int(rng.integers(2, 30))
        full = np.triu(rng.random((n, n)) < 0.05, 1)
        full |= full.T
        label = chosen_path.linked_parts(full, np.arange(n), np.arange(n), n)
        expected = np.arange(n)
        for _ in range(n):
            for i, j in zip(*np.nonzero(full), strict=True):
                expected[[i, j]] = min(expected[i], expected[j])
        assert (label == expected).all()


def test_recall_of_links(spark):
    """Links of all documents against an inverted index of all shingles."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    sets = [frozenset(hash(x) for x in shingles(t)) for _, t in rows]
    where = defaultdict(list)
    for i, own in enumerate(sets):
        for x in own:
            where[x].append(i)
    got = {r["doc_id"]: r["n_links"] for r in chosen_path.near_duplicates(table).collect()}
    true = found = 0
    for i, (doc, _) in enumerate(rows):
        if sets[i]:
            shared = Counter(j for x in sets[i] for j in where[x])
            links = len({sets[j] for j, n in shared.items() if sets[j] != sets[i] and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9})
            true += links
            found += min(links, got[doc])
            assert got[doc] <= links
    print("recall of links", found, "of", true)
    assert true > 100 and found >= 0.99 * true


def test_keep_one(docs):
    kept = chosen_path.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and 3 not in ids and 5 not in ids and {2, 4, 30, 31} <= set(ids)


# --- 8 --------------------------------------------------------------------------------------


def test_language_model(spark, docs, empty):
    learns = common.fold("doc_id", 7) != 2
    got = context_mixing.score(docs, learns).collect()
    rows = docs.select("text", "doc_id", F.coalesce(learns, F.lit(True)).alias("l")).collect()
    lower = lambda t: words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counts = Counter()
    for r in rows:
        if r["l"]:
            counts.update([*lower(r["text"]), None])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for r in rows:
        t = [*lower(r["text"]), None]
        expected[r["doc_id"], len(t), sum(counts[x] > 0 for x in t), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert context_mixing.score(empty, F.lit(True)).count() == 0
    assert context_mixing.score(docs, F.lit(False)).where("train_tokens = 0 AND n_known = 0").count() == docs.count()


def test_joined_tail_gives_the_same_base(docs, monkeypatch):
    key = lambda r: (str(r["doc_id"]), r["n_known"], round(r["base_score"], 6))
    whole = sorted(map(key, context_mixing.score(docs, F.lit(True)).collect()))
    monkeypatch.setattr(context_mixing, "HEAD_ROWS", 40)
    assert sorted(map(key, context_mixing.score(docs, F.lit(True)).collect())) == whole


def test_joined_tail_gives_the_same_score(docs, monkeypatch):
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 6))
    learns = common.fold("doc_id", 7) != 2
    whole = sorted(map(key, context_mixing.score(docs, learns).collect()))
    for rows in (40, 0):
        monkeypatch.setattr(context_mixing, "HEAD_ROWS", rows)
        assert sorted(map(key, context_mixing.score(docs, learns).collect())) == whole


def test_large_counts_keep_their_ratio():
    pairs = np.array([[124702, 60107], [3_000_000, 1_500_000], [10, 40_000_000], [65535, 3]])
    both = context_mixing._halves(pairs)
    got = np.stack([both & 0xFFFF, both >> 16], 1).astype(float)
    assert np.allclose(got[:2, 0] / got[:2, 1], pairs[:2, 0] / pairs[:2, 1], rtol=1e-4)
    assert got[2].tolist() == [1, 65535] and got[3].tolist() == [65535, 3]


def test_tables_grow_with_the_vocabulary(docs, monkeypatch):
    monkeypatch.setattr(context_mixing, "TABLE_BITS", (4,) * context_mixing.PREDICTORS)
    vocab = context_mixing.vocabulary(docs.select("text"), F.lit(True))
    sizes = context_mixing._sizes(vocab)
    tables = context_mixing.unpack(context_mixing.pack(sizes, context_mixing._count(vocab, sizes)))
    assert all(0 < (t > 0).mean() < 0.6 for t in tables) and sizes[5] > sizes[1]
    assert context_mixing.score(docs, F.lit(True)).where("score < 0").count() == docs.count()


def test_model_is_a_distribution():
    """Probabilities of all bytes after a prefix add up to that of the prefix."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    model = context_mixing._fresh([context_mixing._halves(rng.integers(0, 5, (1 << b, 2))) for b in context_mixing.TABLE_BITS])
    model.apm += 3
    symbols = np.arange(256, dtype=np.uint8)
    some = pa.array([b"ab" + bytes([i]) for i in range(256)], pa.binary())
    s, _, each, base = context_mixing.contexts(some, np.ones(256, np.int64))
    third = each.reshape(256, 4)[:, 2]
    assert (s[third] == symbols).all() and len(np.unique(each.reshape(256, 4)[:, 0])) == 1
    node, bit = context_mixing.bits_of(s[third])
    x, gate = model.inputs([b[third] for b in base], node, None)
    p = model.refined(model.mixed(x, gate, node.reshape(-1)), node.reshape(-1)).reshape(node.shape)
    assert abs(np.where(bit == 1, p, 1 - p).prod(1).sum() - 1) < 1e-6
    one, two = model.log10(pa.array([b"abc"], pa.binary()), np.ones(1, np.int64)), model.log10(some, np.ones(256, np.int64))
    assert abs(one[0] - two[ord("c")]) < 1e-9


def test_model_beats_base_on_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = context_mixing.score(table, common.fold("doc_id", 7) != 2).join(table.where(common.fold("doc_id", 7) == 2).select("doc_id"), "doc_id").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_code_of_words_is_a_distribution():
    """Whatever the words before, the probabilities of all codes add up to one, at any expected word."""
    rng = np.random.default_rng(8)
    h = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    code = stream.build(h, np.append(np.sort(rng.integers(2, 5000, 300))[::-1], 70))
    assert (np.sort(code.of(h)) == np.arange(300)).all() and code.of(np.array([5], np.uint64))[0] == 300
    tables = [rng.integers(0, 1 << 16, 1 << 16).astype(np.uint16) for _ in range(stream.CONTEXTS)]
    mixer = stream.fresh()
    mixer.apm += rng.integers(0, 9, mixer.apm.shape)
    for expected in (-1, 0, 7, 300):
        ctx = [np.full(301, x, np.uint32) for x in rng.integers(0, 1 << 32, stream.CONTEXTS)]
        got = mixer.log10(code, tables, np.arange(301), ctx, np.full(301, expected), None)
        assert abs((10.0**got).sum() - 1) < 1e-4
        # the expected word is hinted at for all its bits, any other up to the first that differs
        node, bit, _, size = stream.bits_of(code, np.arange(301), ctx)
        hint = np.split(stream.matched(code, np.arange(301), np.full(301, expected), (2 * bit - 1).astype(np.float32), size), np.cumsum(size)[:-1])
        way = lambda i: code.path[code.begin[i] : code.begin[i] + code.size[i]].tolist()
        for i in range(301):
            told = {step >> 1: step & 1 for step in way(expected)} if expected >= 0 else {}
            assert hint[i].tolist() == [0 if step >> 1 not in told else 2 * told[step >> 1] - 1 for step in way(i)]


def test_runs_of_one_length_of_code_give_what_single_tokens_do():
    """Slots of nodes of a line are one line, each of its own; runs of tokens give the bits, hints and probabilities of each token alone."""
    rng = np.random.default_rng(9)
    h = rng.integers(1, 1 << 62, 500).astype(np.uint64) << np.uint64(1)
    code = stream.build(h, np.append(np.sort(rng.integers(2, 50_000, 500))[::-1], 70))
    assert (np.sort(code.of(h)) == np.arange(500)).all() and (code.of(h + np.uint64(1)) == 500).all()
    codes, expected = rng.integers(0, 501, 400), rng.integers(-1, 501, 400)
    expected[::7] = codes[::7]
    ctx = [rng.integers(0, 1 << 32, 400).astype(np.uint32) for _ in range(stream.CONTEXTS)]
    found = list(stream.runs(code, codes, ctx, 60))
    assert sorted(np.concatenate(found).tolist()) == list(range(400)) and all(len(set(code.size[codes[r]])) == 1 for r in found)
    node, bit, slots, size = stream.bits_of(code, codes, ctx, 16)
    hint = stream.matched(code, codes, expected, (2 * bit - 1).astype(np.float32), size)
    every = [np.split(x, np.cumsum(size)[:-1]) for x in (node, bit, *slots, hint)]
    for r in found:
        n, b, s, k = stream.bits_of(code, codes[r], [c[r] for c in ctx], 16)
        for own, whole in zip((n, b, *s, stream.matched(code, codes[r], expected[r], (2 * b - 1).astype(np.float32), k)), every, strict=True):
            assert own.tolist() == np.concatenate([whole[i] for i in r]).tolist()
    for at in every[2]:
        lines = [at[i : i + stream.LINE_STEPS] >> stream.LINE_STEPS for i in range(0, len(at), stream.LINE_STEPS)]
        assert all(len(set(x.tolist())) == 1 for x in lines)
    # all nodes under one context: those of a line have slots of their own
    first = stream.bits_of(code, np.arange(501), [np.full(501, 77, np.uint32)] * 2, 16)
    of_node = dict(zip(first[0].tolist(), first[2][0].tolist(), strict=True))
    line = code.line[list(of_node)]
    assert len(set(zip(line.tolist(), of_node.values(), strict=True))) == len(of_node)
    tables = [rng.integers(0, 1 << 16, 1 << 16).astype(np.uint16) for _ in range(stream.CONTEXTS)]
    whole = stream.fresh().log10(code, tables, codes, ctx, expected, np.ones(400, np.int32))
    single = [stream.fresh().log10(code, tables, codes[i : i + 1], [c[i : i + 1] for c in ctx], expected[i : i + 1], np.ones(1, np.int32))[0] for i in range(400)]
    assert np.allclose(whole, single, rtol=1e-5)


def test_counts_beyond_16_bits(spark):
    """A word that comes 70,000 times after itself is counted as often, in tables of 16 bits."""
    texts = spark.createDataFrame([("a " * 70_000, True), ("b", True), ("a " * 40_000, True), ("a " * 90_000, False)], "text string, learns boolean").coalesce(1)
    a, b = (int(context_mixing.Tokens(np.frombuffer(x, np.uint8), np.array([0, 1])).hash[0]) for x in (b"a", b"b"))
    code = stream.build(np.array([a, b], np.uint64), np.array([110_000, 20_000, 30_000]))
    sent = spark.sparkContext.broadcast(code)
    bits = stream.table_bits(110_005)
    tables = [np.zeros((1 << bits, 2), np.uint8) for _ in range(stream.CONTEXTS)]
    for j, at, raw in stream.count(texts, sent, 110_005, context_mixing.Tokens):
        part = stream.unpress(raw, np.uint16)
        tables[j][at : at + len(part)] = np.stack([part & 255, part >> 8], 1)
    t = [np.array(x, np.uint64) for x in ([a] * 70_000 + [a + 2], [b, a + 2], [a] * 40_000 + [a + 2])]
    begin = [np.zeros(len(x), np.int64) for x in t]
    expected = [np.zeros((1 << bits, 2), np.int64) for _ in range(stream.CONTEXTS)]
    for h, first in zip(t, begin, strict=True):
        ctx, _ = stream.before(h, first, first)
        _, bit, slots, _ = stream.bits_of(code, code.of(h), ctx, bits)
        for table, at in zip(expected, slots, strict=True):
            np.add.at(table, (at, bit), 1)
    assert max(x.max() for x in expected) > 65_535
    for table, own in zip(tables, expected, strict=True):
        assert (table == stream.level_of(own)).all()


def test_score_depends_on_the_order_of_words(spark):
    """Texts held out are likelier than the same words in random order, and than by a model that knows no order."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    rng = np.random.default_rng(0)
    held = table[[zlib.crc32(str(i).encode()) % 7 == 2 and len(words(t or "")) > 30 for i, t in zip(table["doc_id"], table["text"])]]
    mixed = [(int(i) + 10**9, " ".join(rng.permutation(words(t)))) for i, t in zip(held["doc_id"], held["text"])]
    both = [(int(i), t) for i, t in zip(table["doc_id"], table["text"])] + mixed
    learns = (F.col("doc_id") < 10**9) & (common.fold("doc_id", 7) != 2)
    got = {r["doc_id"]: r for r in context_mixing.score(spark.createDataFrame(both, "doc_id long, text string"), learns).collect()}
    total = lambda column, ids: sum(got[i][column] for i in ids)
    own = held["doc_id"].tolist()
    assert total("score", own) > 0.95 * total("score", [i for i, _ in mixed])
    assert total("score", own) > 0.92 * total("base_score", own)


# --- 9 --------------------------------------------------------------------------------------


def test_rules_against_brute_force(docs, empty):
    for r in rules.judge(docs.withColumn("n_words", F.lit("clash"))).collect():
        t = r["text"] or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = Counter(tri)
        covered = {j for i, g in enumerate(tri) if many[g] > 1 for j in (i, i + 1, i + 2)}
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert rules.judge(empty).count() == 0


# --- 10 -------------------------------------------------------------------------------------


def test_automaton_finds_first_places():
    rng = np.random.default_rng(10)
    for _ in range(30):
        segments = [rng.integers(0, 3, int(rng.integers(4, 20))).tolist() for _ in range(8)]
        masks = suffix_dedup.judge_segments(segments, 4)
        seen = set()
        for s, mask in zip(segments, masks):
            for j in range(len(s) - 3):
                g = tuple(s[j : j + 4])
                assert bool(mask >> j & 1) == (g in seen)
                seen.add(g)


def removed(rows):
    """Brute force: rows of one id and text count once."""
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    by_id = Counter((a, b) for a, b, _ in order)
    assert all(n == 1 for (a, _), n in by_id.items() if a)
    seen, out = set(), {}
    for known, i, t in order:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(g)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i if known else None, t] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("frequent", [256, 2])
def test_substring_dedup_against_brute_force(spark, docs, empty, monkeypatch, frequent):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    table = docs.where("doc_id IS NOT NULL OR text IS NOT NULL")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    expected = removed(rows)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(table).collect())
    assert got == Counter((i, *expected[i, t or ""]) for i, t in rows)
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_substring_dedup_in_passes(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(suffix_dedup, "PASS_ANCHORS", 200)
    expected = removed([(r["doc_id"], r["text"]) for r in table.collect()])
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(table, with_text=False).collect()}
    assert got == {(i, *v) for (i, _), v in expected.items()}


def test_substring_dedup_of_many_null_ids(spark, monkeypatch):
    """Rows of null id and one text are one document, however many; a frequent passage meets no single task's array."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 4)
    t, u = " ".join(f"t{i}" for i in range(30)), " ".join(f"u{i}" for i in range(40))
    rows = [(None, t)] * 3000 + [(None, u)] + [(i, f"x{i} {t} y{i}") for i in range(40)] + [(50, u)]
    table = spark.createDataFrame([(i, x, "clash", 3) for i, x in rows], "doc_id long, text string, h string, whole int").repartition(5)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in suffix_dedup.deduplicate(table, with_text=False).collect())
    assert got == Counter([(None, 30, 0)] * 3000 + [(None, 40, 0)] + [(i, 32, 30) for i in range(40)] + [(50, 40, 40)])
