"""Each registered query on a small folder of tables with nulls, blanks, copies and repeated rows: what its columns must hold."""

import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("shellcluster.llm")

import public_tokenizers
from test_llm_small import corpus, near, removed, words

import corpus_pipeline
from shellcluster.llm import mixing, queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", s, len(t or "")) for i, t, s, _ in corpus(n=90)]
    item = "what is the answer to the question about everything that nobody has asked so far"
    rows += [(i, f"some words before. {item.upper()}! and {i} after", "en", "s1", 9) for i in (200, 201)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 1)) for i in range(0, 90, 2)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    vectors = [(i, [float((i * 7 + j * j) % 11 - 5) for j in range(8)], i % 3) for i in range(90)] + [(100, None, 1), (None, [1.0] * 8, 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    turns = [(c, t, ("user", "assistant")[t % 2], f"turn {c} {t} " + "long " * (9000 * (c == 2))) for c in range(4) for t in range(c + 2)]
    turns += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, 3, "assistant", "z"), (9, 0, None, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture(scope="module")
def hollow(spark, folder, tmp_path_factory):
    """The same tables without rows."""
    at = str(tmp_path_factory.mktemp("hollow"))
    for t in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def ids(found):
    return sorted((r["doc_id"] for r in found), key=lambda i: (i is None, i))


def fold(i, modulus):
    return None if i is None else zlib.crc32(str(i).encode()) % modulus


def test_mixing(spark, folder, rows):
    found = queries.op1_mixing(spark, folder).collect()
    assert ids(found) == ids([{"doc_id": i} for i, *_ in rows])
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, len(words(t))) for i, t, _ in rows)
    held = defaultdict(int)
    for _, t, s in rows:
        held[s] += len(words(t))
    source = {i: s for i, _, s in rows}
    ordered = sorted(held, key=lambda s: (s is None, s or ""))
    total, weight, target = 1.5 * sum(held.values()), {s: (3, 1, 2)[k % 3] for k, s in enumerate(ordered)}, {}
    while len(target) < len(held):  # reshare until none is above
        rest = {s: weight[s] for s in held if s not in target}
        left = total - sum(target.values())
        over = [s for s in rest if left * weight[s] / sum(rest.values()) > 2 * held[s]]
        target |= {s: 2.0 * held[s] for s in over} if over else {s: left * weight[s] / sum(rest.values()) for s in rest}
    for r in found:
        if r["doc_id"] is not None:
            assert r["source_size"] == held[source[r["doc_id"]]] and abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert Counter(map(tuple, found)) == Counter(map(tuple, queries.op1_mixing(spark, folder).collect()))


def test_preference(spark, folder):
    found = {r["conv_id"]: r for r in queries.op2_preference(spark, folder).collect()}
    assert set(found) == {2, 3}  # those with two different replies of the assistant
    r = found[2]
    assert r["n_shared"] == 3 and r["prompt"].startswith("<|user|>\nturn 2 0 long") and len(r["chosen_completion"]) > 45_000


def test_codes(spark, folder, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = sorted(queries.op3_dac(spark, folder).collect(), key=lambda r: r["start"])
    at = 0
    left = Counter((i, t or "") for i, t, _ in rows)
    encode = lambda t: [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
    by = Counter()
    for (i, t), n in left.items():
        tokens = encode(t)
        by[i, len(tokens), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in tokens))] += n
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == by
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in found if r["doc_id"] is not None]
    assert known == sorted(known)


@pytest.mark.parametrize("query,modulus,remainder", [("op4_quality_classifier", 3, 1), ("op7_toxicity", 5, 0)])
def test_classifiers(spark, folder, rows, query, modulus, remainder):
    found = queries.QUERIES[query](spark, folder).select("doc_id", "held_out", "score", "predicted").collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, *_ in rows)
    for r in found:
        assert r["held_out"] == (fold(r["doc_id"], modulus) == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_decontamination(spark, folder):
    assert {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, folder).collect()} == {(200, 1), (201, 1)}


def test_near_duplicates(spark, folder, rows):
    found = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in queries.op6_jaccard_join(spark, folder).collect())
    assert found == near([(i, t) for i, t, _ in rows])


def test_language_model(spark, folder, rows):
    found = queries.op8_context_mixing(spark, folder).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, *_ in rows)
    train = sum(len(words(t)) + 1 for i, t, _ in rows if fold(i, 7) != 2)
    for r in found:
        assert r["held_out"] == (fold(r["doc_id"], 7) == 2) and r["train_tokens"] == train
        assert r["score"] < 0 and r["n_known"] <= r["n_tokens"]


def test_rules(spark, folder, rows):
    found = queries.op9_quality_rules(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"]) for r in found) == Counter((i, len(words(t)), sum(map(len, words(t)))) for i, t, _ in rows)


def test_substrings(spark, folder, rows):
    expected = removed([(i, t) for i, t, _ in rows if i is not None or t is not None])
    found = queries.op10_suffix_dedup(spark, folder).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) in [v for (i, _), v in expected.items() if i == r["doc_id"]]


@pytest.mark.parametrize("query", list(queries.QUERIES))
def test_empty_tables(spark, hollow, query):
    assert queries.QUERIES[query](spark, hollow).collect() == []


def test_pipeline(spark, folder, hollow, rows):
    found = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in found}
    assert kept <= {i for i, *_ in rows} - {200, 201} and max(Counter(r["doc_id"] for r in found if r["doc_id"] is not None).values(), default=0) <= 2
    assert corpus_pipeline.run(spark, hollow).collect() == []


def test_weights_cycle_over_sources():
    quotas = mixing.weights_by_rank()({"a": 100, "b": 100, "c": 100, None: 100})
    assert abs(sum(quotas.values()) - 600) < 1e-9 and quotas["a"] == quotas[None] == 200
