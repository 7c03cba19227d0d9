"""Ranked search with block maxima against a score of every document."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("shellcluster.llm")

from shellcluster.llm import block_wand, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df, out = Counter(t for _, c in counted for t in c), []
    for ident, text in items:
        scored = []
        for i, c in counted:
            m = 75 + 25 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(ident, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def table():
    """Zipfian words in several scripts and cases, copies (ties), nulls, blanks, repeated ids, a text of 20,000 words."""
    rng = np.random.default_rng(5)
    lexicon = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "The", "the", "THE", "x1y2", "日本", "a b"]
    p = 1 / np.arange(1, len(lexicon) + 1)
    text = lambda n: "".join(w + str(rng.choice([" ", "-", "\n", "_", "!", "\x7f"])) for w in rng.choice(lexicon, n, p=p / p.sum()))
    docs = [(int(i), text(int(rng.integers(1, 80)))) for i in rng.permutation(400)]
    docs += [(1000 + i, docs[0][1]) for i in range(30)] + [docs[5], docs[5], (None, docs[7][1]), (None, None), (7000, None), (7001, ""), (7002, " -_\x00"), (7003, text(20_000)), (7004, "rare")]
    items = [(i, text(int(rng.integers(1, 40)))) for i in range(40)] + [(90, "rare"), (91, None), (92, " !"), (93, "absent words"), (None, "the the W1"), (94, docs[0][1])]
    return docs, items


@pytest.fixture(scope="module")
def data(spark):
    docs, items = table()
    return docs, items, spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, terms string").repartition(4).cache(), spark.createDataFrame(items, "item_id int, text string")


def same(found, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=key) == sorted(wanted, key=key)


@pytest.mark.parametrize("postings", [1_000_000, 700])
def test_ranks_all_documents(data, monkeypatch, postings):
    """In one shard a task, and in many."""
    docs, items, df, queried = data
    monkeypatch.setattr(block_wand, "SHARD_POSTINGS", postings)
    same(block_wand.rank(df, queried, k=7), brute(docs, items, 7))


def test_passes_over_terms(data, monkeypatch):
    docs, items, df, queried = data
    monkeypatch.setattr(block_wand, "PASS_TERMS", 60)
    same(block_wand.rank(df, queried, k=3), brute(docs, items, 3))


def test_query_and_sql(data, tmp_path):
    docs, items, df, queried = data
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    queried.write.parquet(f"{tmp_path}/benchmark.parquet")
    import pyspark.sql

    wanted = brute(docs, items, 20)
    same(queries.op12_block_wand(pyspark.sql.SparkSession.active(), str(tmp_path)), wanted)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    told = c.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLE_SQL['op12_block_wand']})").fetchall()
    assert sorted(map(str, told)) == sorted(map(str, wanted))


def test_empty_tables(data):
    _, _, df, queried = data
    assert block_wand.rank(df.limit(0), queried).collect() == []
    assert block_wand.rank(df, queried.limit(0)).collect() == []


def test_term_counts_of_a_text_in_stretches(monkeypatch):
    monkeypatch.setattr(block_wand, "STRETCH", 10)
    text = "Ab ab_long" + "g" * 50 + " été! ÉTÉ 12 " * 9
    assert block_wand.term_counts(text.encode()) == Counter(t.encode() for t in terms(text))


def test_cuts_have_the_least_error():
    """The dynamic programme against all cuttings of a short list."""
    rng = np.random.default_rng(0)
    high, width, price = rng.integers(1, 50, (6, 9)).astype(float), np.full((6, 9), 4), rng.uniform(1, 200, 6)
    starts = block_wand._trace(block_wand._least_error_cuts(high, width, price), np.full(6, 9))

    def cost(row, begins):
        return sum(price[row] + 4 * (b - a) * high[row, a:b].max() for a, b in zip(begins, [*begins[1:], 9]))

    for row in range(6):
        all_cuts = ([0, *[j for j in range(1, 9) if mask >> (j - 1) & 1]] for mask in range(256))
        assert math.isclose(cost(row, np.flatnonzero(starts[row]).tolist()), min(cost(row, c) for c in all_cuts))


def test_blocks_cover_each_list():
    rng = np.random.default_rng(1)
    sizes = [1, 3, 4, 5, 64, 700, 5000]
    impact, offsets = rng.integers(1, 10**6, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    begins = block_wand.block_starts(impact, offsets)
    assert set(offsets[:-1]) <= set(begins) and np.diff(np.append(begins, offsets[-1])).max() <= block_wand.CELL * block_wand.WINDOW
    assert len(begins) < 2 * sum(sizes) / block_wand.MEAN_BLOCK + len(sizes)
