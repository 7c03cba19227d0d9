"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources a document belongs to). Patterns
supply tokens, sources have quotas, and the k-th pass over a pattern costs k: a convex price of
repetition. The flow is solved on the driver over patterns and sources only; which documents fill
it follows from a seeded hash order, so reruns agree. Documents never meet in one task: prefix sums
run over hash buckets, and rows are sorted only in the few buckets that a cut falls in.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import materialize

#: Patterns and sources that the driver solves for at most; more raise ValueError.
MAX_PATTERNS = 4096
BUCKETS = 1024
#: A document over this part of its pattern and over 8 times the mean is placed by its hash bucket.
LONG_PARTS = 200


def capped_shares(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """total by weight; what would exceed cap times a size stops there, and its excess is reshared by weight.

    Closed form of the repeated resharing: sources reach their caps in the order of cap / weight.
    """
    out, left, open_weight = [0.0] * len(sizes), float(total), float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i)):
        share = left * weights[i] / open_weight if open_weight > 0 else 0.0
        out[i] = min(float(cap * sizes[i]), share)
        left -= out[i]
        open_weight -= weights[i]
    return out


def min_cost_flow(capacity: dict[str, int], members: dict[str, Sequence], quota: dict, max_repeats: int) -> dict[tuple[str, object], int]:
    """Tokens that each pattern gives to each of its sources.

    Successive shortest paths. A pattern has max_repeats arcs of its capacity, the k-th at cost k, so
    early passes fill first; a source takes its quota at most. Works in whole tokens.
    """
    graph: dict = defaultdict(list)
    arcs: list[list] = []

    def arc(a, b, cap, cost):
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            graph[u].append(len(arcs))
            arcs.append([u, v, c, w])

    for p in sorted(capacity):
        if capacity[p] > 0 and members[p]:
            for k in range(max_repeats):
                arc("S", ("p", p), capacity[p], k)
            for s in members[p]:
                arc(("p", p), ("s", s), capacity[p] * max_repeats, 0)
    for s, q in quota.items():
        arc(("s", s), "T", int(q), 0)
    potential: dict = defaultdict(int)
    while True:
        distance, via, seen = {"S": 0}, {}, set()
        heap, tick = [(0, 0, "S")], 1
        while heap:
            d, _, u = heapq.heappop(heap)
            if u in seen:
                continue
            seen.add(u)
            for i in graph[u]:
                _, v, c, w = arcs[i]
                if c > 0 and (n := d + w + potential[u] - potential[v]) < distance.get(v, 1 << 62):
                    distance[v], via[v] = n, i
                    heapq.heappush(heap, (n, tick, v))
                    tick += 1
        if "T" not in distance:
            break
        for v, d in distance.items():
            potential[v] += min(d, distance["T"])
        for v in graph:
            if v not in distance:
                potential[v] += distance["T"]
        path, v = [], "T"
        while v != "S":
            path.append(via[v])
            v = arcs[via[v]][0]
        push = min(arcs[i][2] for i in path)
        for i in path:
            arcs[i][2] -= push
            arcs[i ^ 1][2] += push
    flow: dict[tuple[str, object], int] = {}
    for i in range(0, len(arcs), 2):
        u, v, _, _ = arcs[i]
        if isinstance(u, tuple) and u[0] == "p" and arcs[i + 1][2] > 0:
            flow[u[1], v[1]] = arcs[i + 1][2]
    return flow


def _cuts(flow: dict, capacity: dict[str, int], members: dict) -> dict[str, list[tuple[int, int, int, object]]]:
    """By pattern: (pass, from, to, source), offsets within a pass over the pattern's tokens."""
    out: dict = {}
    for p, cap in capacity.items():
        at, found = 0, []
        for s in members[p]:
            left = flow.get((p, s), 0)
            while left > 0:
                k, o = divmod(at, cap)
                n = min(left, cap - o)
                found.append((k, o, o + n, s))
                at, left = at + n, left - n
        if found:
            out[p] = found
    return out


def mix(
    docs: DataFrame,
    sources: Column,
    size: Column,
    quotas: Callable[[dict], dict],
    doc_id: str = "doc_id",
    max_repeats: int = 2,
    seed: int = 17,
) -> tuple[DataFrame, dict]:
    """docs with `allocation`, an array of (pass, source) for each copy the mix takes; and the report.

    sources: array column of the sources of a document, nulls allowed as a source of their own; null or
    empty: the document belongs to none and is never taken. size: its tokens, a long. quotas: from
    {source: tokens that belong to it} to {source: tokens wanted}. No document is taken more than
    max_repeats times. A document is taken for a pass if its middle lies before the cut, so a source's
    sum misses its flow by half a document at each cut. Repeated rows and null ids are rows like any
    other; among rows of one id their order in ties is of no effect on the sums by id and size.
    An empty table gives an empty table. Columns of docs stay; one named `allocation` is replaced.
    """
    spark = docs.sparkSession
    ordered = F.sort_array(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    keyed = docs.withColumns(
        {
            "__mix_pattern": F.to_json(ordered),
            "__mix_order": F.xxhash64(F.lit(seed), F.col(doc_id).cast("string")),
            "__mix_size": size,
        }
    ).withColumns({"__mix_bucket": F.shiftrightunsigned("__mix_order", 54).cast("int"), "__mix_class": F.length(F.bin("__mix_size"))})
    counts = materialize(keyed.groupBy("__mix_pattern", "__mix_bucket", "__mix_class").agg(F.sum("__mix_size").alias("size"), F.count("*").alias("n")), "mix-histogram")
    by_pattern = counts.groupBy("__mix_pattern").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(by_pattern) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    capacity = {r["__mix_pattern"]: int(r["size"]) for r in sorted(by_pattern, key=lambda r: r["__mix_pattern"])}
    members = {p: sorted(json.loads(p), key=lambda s: (s is None, s or "")) for p in capacity}
    holdings: dict = defaultdict(int)
    for p, ss in members.items():
        for s in ss:
            holdings[s] += capacity[p]
    holdings = {s: holdings[s] for s in sorted(holdings, key=lambda s: (s is None, s or ""))}
    wanted = quotas(holdings)
    flow = min_cost_flow(capacity, members, {s: round(q) for s, q in wanted.items()}, max_repeats)
    cuts = _cuts(flow, capacity, members)
    report = {"holdings": holdings, "targets": wanted, "flow": flow}

    # a document that is long for its pattern would move a cut by much: its place follows from its bucket alone, and the others' cuts make up for it
    long_class = {r["__mix_pattern"]: max(int(r["size"]) // LONG_PARTS, 8 * int(r["size"]) // max(1, int(r["n"]))).bit_length() + 1 for r in by_pattern}
    plan = _plan(spark, counts, cuts, capacity, long_class)
    # at most MAX_PATTERNS rows
    marked = keyed.join(F.broadcast(plan), "__mix_pattern", "left").withColumn("__mix_long", F.coalesce(F.col("__mix_class") >= F.col("__mix_long_class"), F.lit(False)))
    is_cut = F.coalesce(F.array_contains("__mix_cut_buckets", F.col("__mix_bucket")), F.lit(False)) & ~F.col("__mix_long")
    whole = marked.where(~is_cut).withColumn("__mix_at", F.lit(None).cast("double"))
    w = Window.partitionBy("__mix_pattern", "__mix_bucket").orderBy("__mix_order", F.col(doc_id), "__mix_size").rowsBetween(Window.unboundedPreceding, 0)
    part = marked.where(is_cut).withColumn(
        "__mix_at",
        F.sum("__mix_size").over(w) - F.col("__mix_size") / 2 + F.element_at("__mix_cut_starts", F.array_position("__mix_cut_buckets", F.col("__mix_bucket")).cast("int")),
    )
    # a bucket without a cut lies in a segment as a whole; in one with a cut the row's middle tells
    inside = F.expr(
        "transform(filter(__mix_segments, s -> CASE WHEN __mix_long THEN __mix_bucket + 0.5D >= s.long_low AND __mix_bucket + 0.5D < s.long_high"
        " WHEN __mix_at IS NULL THEN __mix_bucket > s.low_bucket AND __mix_bucket < s.high_bucket"
        " ELSE __mix_at >= s.low AND __mix_at < s.high END), s -> named_struct('pass', s.pass, 'source', s.source))"
    )
    out = whole.unionByName(part).withColumn("allocation", F.coalesce(inside, F.array().cast("array<struct<pass:int,source:string>>")))
    return out.select(*[c for c in docs.columns if c != "allocation"], "allocation"), report


def _plan(spark, counts: DataFrame, cuts: dict, capacity: dict, long_class: dict) -> DataFrame:
    """A row for each pattern: its segments, and the buckets in which cuts fall with their first offset."""
    offsets = [(p, o, BUCKETS * o / capacity[p]) for p, found in cuts.items() for o in sorted({x for _, a, b, _ in found for x in (a, b)})]
    classes = spark.createDataFrame(list(long_class.items()), "__mix_pattern string, long_class int")
    typed = counts.join(classes, "__mix_pattern")
    cut = spark.createDataFrame(offsets, "__mix_pattern string, offset long, place double")
    below = typed.where("__mix_class >= long_class").join(cut, "__mix_pattern").where("__mix_bucket + 0.5D < place").groupBy("__mix_pattern", "offset").agg(F.sum("size")).collect()
    taken = {(r[0], r[1]): int(r[2]) for r in below}
    short: dict = {}
    for p, o, _ in offsets:  # ascending by pattern
        short[p, o] = max(o - taken.get((p, o), 0), short.get((p, "last"), 0))
        short[p, "last"] = short[p, o]
    running = Window.partitionBy("__mix_pattern").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, 0)
    held = typed.where("__mix_class < long_class").groupBy("__mix_pattern", "__mix_bucket").agg(F.sum("size").alias("size"))
    held = held.withColumn("high", F.sum("size").over(running)).withColumn("low", F.col("high") - F.col("size"))
    wanted = spark.createDataFrame([(p, short[p, o]) for p, o in sorted({(p, o) for p, o, _ in offsets})], "__mix_pattern string, offset long").distinct()
    # the bucket of an offset: the last that starts at it or before; rows: one for each cut
    at = held.join(wanted, "__mix_pattern").where("low <= offset AND offset < high")
    place = {(r[0], r[1]): (r[2], r[3]) for r in at.select("__mix_pattern", "offset", "__mix_bucket", "low").collect()}
    rows = []
    for p, found in cuts.items():
        ends = [(k, short[p, a], short[p, b], a, b, s) for k, a, b, s in found]
        buckets = sorted({place[p, o] for _, a, b, *_ in ends for o in (a, b) if (p, o) in place})
        segments = [
            (k, s, float(a), float(b), place[p, a][0] if (p, a) in place else BUCKETS, place[p, b][0] if (p, b) in place else BUCKETS, BUCKETS * long_a / capacity[p], BUCKETS * long_b / capacity[p])
            for k, a, b, long_a, long_b, s in ends
        ]
        rows.append((p, segments, [b for b, _ in buckets], [float(low) for _, low in buckets], long_class[p]))
    segment = "array<struct<pass:int,source:string,low:double,high:double,low_bucket:int,high_bucket:int,long_low:double,long_high:double>>"
    return spark.createDataFrame(rows, T._parse_datatype_string(f"__mix_pattern string, __mix_segments {segment}, __mix_cut_buckets array<int>, __mix_cut_starts array<double>, __mix_long_class int"))


def weights_by_rank(cycle: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> Callable[[dict], dict]:
    """Quotas: sources in code point order, null last, weigh as cycle, and share a multiple of all tokens."""

    def quotas(holdings: dict) -> dict:
        sizes = list(holdings.values())
        return dict(zip(holdings, capped_shares(sizes, [cycle[i % len(cycle)] for i in range(len(sizes))], share * sum(sizes), cap), strict=True))

    return quotas


def take(mixed: DataFrame, column: str = "allocation") -> DataFrame:
    """Each document as often as the mix takes it, without the allocation."""
    return mixed.withColumn("__copy", F.explode(column)).drop("__copy", column)
