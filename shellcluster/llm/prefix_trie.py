"""Prefix trie of conversations: binary search for each conversation's first owned depth, chains, bottom-up sums.

A node is a distinct sequence of first turns. Its owner is the least conversation that starts with it. Of a
conversation's prefixes those it owns are the last ones, since members of a longer prefix are members of
a shorter: so one depth, the first owned, says which nodes a conversation gives. A conversation's owned
nodes are a chain; chains hang on nodes of other chains, and what a subtree holds is summed over chains.

All tables are narrow: a turn is two halves of a digest and a size, a prefix two 64-bit keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import map_in_arrow, materialize, scratch_path, ship
from .common import join_hot

#: Ids of one stretch of a node's list of ends; a longer list is hashed stretch by stretch.
STRETCH = 4096

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, str], name: str) -> DataFrame:
    """df with run_<value>: sum or xor (as values says) over the rows of the same keys up to this one, in order.

    keys and values are long columns without nulls. Rows are dealt by ranges of keys and order, so a key
    of many rows is spread; each range runs on by itself, and only its first key may go on from an earlier one:
    the driver adds up a row for each range.
    """
    spark = df.sparkSession
    ship(spark)
    names, kept = list(values), [c for c in df.columns if not c.startswith("__")]
    ordered = df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*[F.col(k) for k in keys], *order).select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) + "".join(f", run_{v} long" for v in names) + ", __head boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, carry = None, None, dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in keys])
            begins = np.ones(batch.num_rows, bool)
            begins[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            goes_on = last is not None and bool((key[:, 0] == last).all())
            begins[0] = not goes_on
            first = key[:, 0].copy() if first is None else first
            start = np.maximum.accumulate(np.where(begins, np.arange(batch.num_rows), -1))
            out = []
            for v in names:
                x = batch.column(v).to_numpy().astype(np.int64)
                if values[v] == "sum":
                    total = np.concatenate([[0], np.cumsum(x)])
                    r = total[1:] - np.where(start >= 0, total[np.maximum(start, 0)], -carry[v])
                else:
                    total = np.concatenate([[0], np.bitwise_xor.accumulate(x)])
                    r = total[1:] ^ np.where(start >= 0, total[np.maximum(start, 0)], carry[v])
                carry[v] = int(r[-1])
                out.append(pa.array(r, pa.int64()))
            last = key[:, -1].copy()
            head = (key == first[:, None]).all(axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(head)], names=[*batch.schema.names, *[f"run_{v}" for v in names], "__head"])

    placed = map_in_arrow(ordered, run, schema).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, name)
    ends = F.struct(*[f"run_{v}" for v in names])
    key = F.struct(*keys)
    parts = placed.groupBy("__part").agg(
        F.min_by(key, "__at").alias("first"), F.max_by(key, "__at").alias("last"), F.expr("bool_and(__head)").alias("only"),
        F.max_by(ends, F.when(F.col("__head"), F.col("__at"))).alias("first_run"), F.max_by(ends, "__at").alias("last_run"),
    )
    carries, at, held = [], None, dict.fromkeys(names, 0)
    for p in parts.orderBy("__part").collect():
        goes_on = at is not None and p["first"] == at
        if goes_on:
            carries.append((p["__part"], *[held[v] for v in names]))
        for v in names:
            own = p["last_run"][f"run_{v}"]
            before = held[v] if goes_on and p["only"] else 0
            held[v] = own + before if values[v] == "sum" else own ^ before
        at = p["last"]
    if not carries:
        return placed.select(*kept, *[f"run_{v}" for v in names])
    table = spark.createDataFrame(carries, "__part int" + "".join(f", __carry_{v} long" for v in names))
    joined = placed.join(F.broadcast(table), "__part", "left")
    whole = []
    for v in names:
        c = F.when(F.col("__head"), F.coalesce(f"__carry_{v}", F.lit(0))).otherwise(F.lit(0))
        whole.append((F.col(f"run_{v}") + c if values[v] == "sum" else F.col(f"run_{v}").bitwiseXOR(c)).alias(f"run_{v}"))
    return joined.select(*kept, *whole)


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (128-bit digest of role and text), size (code points of the text).

    Ordered by turn, null first; equal turns by role, then text; repeated rows are turns each. A null role
    or text is empty. Rows with a null conv_id belong to no conversation and are left out; other columns are ignored.
    """
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("__turn"), F.coalesce(F.col(role), F.lit("")).alias("__role"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    digest = F.md5(F.concat(F.length("__role").cast("string"), F.lit(":"), F.col("__role"), F.col("__text")).cast("binary"))
    rows = rows.withColumn("__digest", digest).withColumns({"t1": _half(F.col("__digest"), 1), "t2": _half(F.col("__digest"), 17), "size": F.length("__text").cast("long"), "pos": F.lit(1).cast("long")})
    order = [F.col("__turn").asc_nulls_first(), F.col("__role").asc(), F.col("__text").asc()]
    return running(rows, ["conv_id"], order, {"pos": "sum"}, "trie-turns").drop("pos").withColumnRenamed("run_pos", "pos")


def inherit(rows: DataFrame, per: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations as (rows, members): the first h turns of conversation c - c % per, then c's own after its first h.

    h is the crc32 of the decimal id modulo most. members: conv_id and n, its turns, also where there are none.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    counts = materialize(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "trie-counts")
    base = (F.col("conv_id") - F.col("conv_id") % per).alias("base")
    # a base has per conversations at most, so its rows are never joined to many
    heads = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = counts.select("conv_id", "n", base, h.alias("h")).join(heads, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = materialize(plan.select("conv_id", "base", "n", "h", "m"), "trie-plan")
    first = rows.where(f"conv_id % {per} = 0 AND pos < {most}").select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "t1", "t2", "size")
    taken = plan.where("m > 0").select("conv_id", "base", "m").join(first, "base").where("depth <= m").select("conv_id", "depth", "t1", "t2", "size")
    own = join_hot(rows, plan.select("conv_id", "h", "m", "n"), ["conv_id"], "inner").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "t1", "t2", "size")
    members = plan.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("n"))
    return taken.unionByName(own).withColumn("depth", F.col("depth").cast("long")), members


def _prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2, size, low: keys of each prefix, and the lowest bit of its depth, by which files are parted."""
    lanes = {f"__k{i}": F.xxhash64(F.lit(i), "depth", "t1", "t2") for i in (1, 2)}
    keyed = rows.withColumns(lanes).select("conv_id", "depth", "size", F.col("__k1").alias("k1"), F.col("__k2").alias("k2"))
    found = running(keyed, ["conv_id"], [F.col("depth").asc()], {"k1": "xor", "k2": "xor"}, "trie-keys")
    found = found.select("conv_id", "depth", F.col("run_k1").alias("k1"), F.col("run_k2").alias("k2"), "size", F.expr("depth & -depth").alias("low"))
    path = scratch_path(rows.sparkSession, "trie-prefixes")
    found.write.partitionBy("low").parquet(path)
    return rows.sparkSession.read.schema(found.schema).parquet(path)


def _owned(prefixes: DataFrame, members: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """(chains, nodes). chains: conv_id, n, owns_from, parent (owner of the node before), null if that is the root. nodes: conv_id, depth, n_convs, size.

    A conversation knows of `before` prefixes that it doesn't own. A round of step s asks for the depth s further on; these
    are just the depths whose lowest bit is s, so over all rounds each prefix is read, and its least conversation
    found, once.
    """
    state = members.select("conv_id", "n", F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("parent"))
    nodes = None
    step = 1 << max(0, top.bit_length() - 1)
    while step:
        here = prefixes.where(F.col("low") == step)
        least = here.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.min("size").alias("size"))
        least = materialize(least, "trie-minima")
        found = least.select(F.col("owner").alias("conv_id"), "depth", F.col("n").alias("n_convs"), "size")
        nodes = found if nodes is None else nodes.unionByName(found)
        ask = state.where(F.col("before") + step <= F.col("n")).select("conv_id", (F.col("before") + step).alias("depth"))
        asked = join_hot(here.select("conv_id", "depth", "k1", "k2").join(ask, ["conv_id", "depth"]), least.select("depth", "k1", "k2", "owner", "n"), ["depth", "k1", "k2"], "inner")
        lost = asked.where("owner != conv_id").select("conv_id", "depth", "owner")
        state = state.join(lost, "conv_id", "left").select("conv_id", "n", F.coalesce("depth", "before").alias("before"), F.coalesce("owner", "parent").alias("parent"))
        state = materialize(state, "trie-search")
        step >>= 1
    return state.select("conv_id", "n", (F.col("before") + 1).alias("owns_from"), "parent"), nodes


def _chain_sums(chains: DataFrame) -> DataFrame:
    """conv_id, leaves, saved over all that hangs on a chain: sums over 2^k levels, then over twice as many, until no chain has an ancestor left."""
    sums = materialize(chains.select("conv_id", "parent", "leaves", "saved"), "trie-sums")
    while sums.where("parent IS NOT NULL").limit(1).count():
        below = sums.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("n"))
        below = materialize(below.join(sums.select("conv_id", F.col("parent").alias("above")), "conv_id"), "trie-below")
        grown = sums.join(below.drop("n", "above"), "conv_id", "left").select("conv_id", "parent", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        sums = join_hot(grown, below.select(F.col("conv_id").alias("parent"), "above", "n"), ["parent"])
        sums = materialize(sums.select("conv_id", F.col("above").alias("parent"), "leaves", "saved"), "trie-sums")
    return sums.drop("parent")


def _end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the comma-joined ascending `member` ids. Lists are joined in stretches; those of a long list follow one another in one stream, since each step of the digest needs the one before."""
    ranked = running(ends.withColumn("one", F.lit(1).cast("long")), ["conv_id", "depth"], [F.col("member").asc()], {"one": "sum"}, "trie-ends")
    joined = F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",")
    stretches = ranked.groupBy("conv_id", "depth", F.expr(f"(run_one - 1) div {STRETCH}").alias("stretch")).agg(joined.alias("ids"), F.max("run_one").alias("upto"))
    stretches = materialize(stretches, "trie-stretches")
    long = stretches.where("stretch > 0").select("conv_id", "depth").distinct()
    alone = stretches.join(long, ["conv_id", "depth"], "left_anti").select("conv_id", "depth", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for c, d, ids in zip(batch["conv_id"].to_pylist(), batch["depth"].to_pylist(), batch["ids"].to_pylist()):
                if (c, d) == at:
                    state.update(f",{ids}".encode())
                    continue
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (c, d), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["conv_id", "depth", "ends_sha256"])
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], names=["conv_id", "depth", "ends_sha256"])

    streams = stretches.join(long, ["conv_id", "depth"], "left_semi").select("conv_id", "depth", "stretch", "ids").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "stretch")
    return alone.unionByName(map_in_arrow(streams, run, "conv_id long, depth long, ends_sha256 string"))


def trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the trie: conv_id (the owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conv_id, depth (1 to n without gaps), t1, t2, size; members: conv_id, n, each once, also those without
    turns. The root has depth 0, the least id, no parent and no text. n_leaves and saved_tokens are of the whole subtree:
    its childless nodes, and (n_convs - 1) * size summed. Equal conversations are members of the same nodes and end in the same
    one. Without members there is no node.
    """
    spark = rows.sparkSession
    ship(spark)
    members = materialize(members, "trie-members")
    least, top, total = members.agg(F.min("conv_id"), F.max("n"), F.count("*")).first()
    if least is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    chains, nodes = _owned(_prefixes(rows), members, top)
    root = F.col("conv_id") == least
    parent = F.when(~root, F.coalesce("parent", F.lit(least)))
    chains = materialize(chains.select("conv_id", "n", F.when(root, 0).otherwise(F.col("owns_from")).cast("long").alias("owns_from"), parent.alias("parent")), "trie-chains")
    nodes = nodes.unionByName(spark.createDataFrame([(least, 0, total, 0)], "conv_id long, depth long, n_convs long, size long"))
    owning = chains.where("owns_from <= n")
    hang = owning.where("parent IS NOT NULL").select(F.col("parent").alias("conv_id"), (F.col("owns_from") - 1).alias("depth"), F.col("conv_id").alias("child"))
    forks = hang.groupBy("conv_id", "depth").agg(F.count("*").alias("forks"))
    last = owning.select("conv_id", F.col("n").alias("depth"), F.lit(True).alias("is_last"))
    told = nodes.join(forks, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left")
    kids = F.coalesce("forks", F.lit(0)) + F.when(F.col("is_last"), 0).otherwise(1)
    told = told.select("conv_id", "depth", "n_convs", kids.cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    told = materialize(told.withColumn("leaves", (F.col("n_children") == 0).cast("long")), "trie-nodes")

    own = told.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sums = _chain_sums(owning.select("conv_id", "parent").join(own, "conv_id"))
    hung = join_sums(hang, sums).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    here = told.join(hung, ["conv_id", "depth"], "left")
    here = here.withColumns({x: F.col(x) + F.coalesce(f"hung_{x}", F.lit(0)) for x in ("leaves", "saved")}).drop("hung_leaves", "hung_saved")
    whole = running(here, ["conv_id"], [F.col("depth").desc()], {"leaves": "sum", "saved": "sum"}, "trie-subtrees")

    ends = chains.select(F.when(F.col("owns_from") <= F.col("n"), F.col("conv_id")).otherwise(F.col("parent")).alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member"))
    above = owning.select("conv_id", F.col("owns_from").alias("depth"), F.col("parent").alias("above"), F.lit(True).alias("is_first"))
    out = whole.join(above, ["conv_id", "depth"], "left").join(_end_digests(ends), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("is_first"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("run_leaves").alias("n_leaves"), F.col("run_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def join_sums(hang: DataFrame, sums: DataFrame) -> DataFrame:
    """hang with the sums of each child, which stands in it once."""
    return hang.join(sums.withColumnRenamed("conv_id", "child"), "child")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are: see turns and trie."""
    rows = turns(conversations)
    return trie(rows.withColumnRenamed("pos", "depth"), rows.groupBy("conv_id").agg(F.count("*").alias("n")))
