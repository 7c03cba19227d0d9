"""The trie of rebuilt conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

pytest.importorskip("shellcluster.llm")

from pyspark.sql import functions as F

from shellcluster.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, size string, depth string"


def originals(rows):
    found = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            found[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [turn[2:] for turn in sorted(v)] for c, v in found.items()}


def rebuilt(own):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def brute(conversations):
    members, kids, below, out = defaultdict(list), defaultdict(list), {}, []
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, own + sum(below[k][1] for k in kids[p]))
        ends = ",".join(str(c) for c in sorted(members[p]) if len(conversations[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: r[:2])


def table(seed=3):
    """Shared prefixes, equal conversations, prefixes of others, ties, nulls, an absent base, a long conversation and a long text."""
    rng, rows = random.Random(seed), []
    for c in [*range(30), *range(100, 120), *range(205, 225), 7000]:
        for t in range(rng.choice([1, 1, 2, 3, 8, 40])):
            turn = rng.choice([t, t, None]) if c % 7 == 0 else t
            rows.append((c, turn, rng.choice(["u", "a", None]) if c % 5 == 0 else "u", rng.choice(["x", "yé𝒳", None, "zz"]) if c % 3 else "q"))
    rows += [(c, 0, "u", "same") for c in range(400, 440)]
    return rows + rows[:5] + [(None, 1, "u", "a"), (3, 99, "u", "word " * 20_000)]


@pytest.fixture(scope="module")
def rows(spark):
    return table()


@pytest.fixture(scope="module")
def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA).repartition(5).cache()


def test_trie_against_brute_force(spark, rows, conversations, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)  # lists of ends over several stretches
    conversations.drop("size", "depth").write.parquet(f"{tmp_path}/conversations.parquet")
    wanted = brute(rebuilt(originals(rows)))
    assert found(queries.op13_prefix_trie(spark, str(tmp_path))) == wanted
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    told = c.execute(f"SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({queries.ORACLE_SQL['op13_prefix_trie']})").fetchall()
    assert sorted(told, key=lambda r: r[:2]) == wanted


def test_conversations_as_they_are(spark, rows, conversations):
    """Columns whose names clash with internal ones don't matter."""
    assert found(prefix_trie.conversation_trie(conversations)) == brute(originals(rows))


def test_without_conversations(spark, conversations):
    for empty in (conversations.limit(0), conversations.where("conv_id IS NULL")):
        assert prefix_trie.trie(*prefix_trie.inherit(prefix_trie.turns(empty))).collect() == []


@pytest.mark.parametrize("parts", [1, 9])
def test_running_over_ranges(spark, parts):
    """A key of most rows is spread over ranges and goes on from one to the next."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.when(F.col("id") % 10 < 7, 5).otherwise(F.col("id") % 4).cast("long").alias("k"), F.col("id").alias("x"), (F.col("id") * 7919).alias("y"))
        got = prefix_trie.running(df, ["k"], [F.col("x").asc()], {"x": "sum", "y": "xor"}, "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, xors = defaultdict(int), defaultdict(int)
    for r in sorted(got, key=lambda r: r["x"]):
        sums[r["k"]] += r["x"]
        xors[r["k"]] ^= r["y"]
        assert (r["run_x"], r["run_y"]) == (sums[r["k"]], xors[r["k"]])
    assert len(got) == 3000
