"""Benchmark decontamination by pigeonhole edit matching.

An item within k edits of a passage has at least one of k + 1 pieces unchanged there. All pieces go
into one Aho-Corasick automaton; where a piece is found, Myers' bit-parallel distance decides on the
passage around it. Texts and items are compared in lower case with white space collapsed. An item too
short for any edit must stand between word boundaries.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import at_release, map_in_arrow, materialize, ship

#: Edits allowed for each character of an item.
ERROR_RATE = 0.05
#: Characters of items that go into one automaton, and so into one broadcast; more items take more passes.
SHARD_CHARS = 1_000_000


def normalize(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly equal length that make up the item."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit-parallel approximate search for one item; an integer of any length is the bit vector."""

    def __init__(self, item: str):
        self.item = item
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end): the least edit distance of the item to any substring of text, and where the first such ends."""
        m = len(self.item)
        full, top, get = (1 << m) - 1, 1 << (m - 1), self.masks.get
        pv, mv, score = full, 0, m
        found, at = m, 0
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = (mv | ~(xh | pv)) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph <<= 1
            mh <<= 1
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv & full
            if score < found:
                found, at = score, j
        return found, at


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] neither begins nor ends inside a word."""
    before = start == 0 or not (text[start - 1].isalnum() and text[start].isalnum())
    return before and (end == len(text) or not (text[end].isalnum() and text[end - 1].isalnum()))


class Matcher:
    """Finds items of one shard in texts. items: (id, normalised text)."""

    def __init__(self, items: Iterable[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = list(items)
        self.budget = [int(len(t) * rate) for _, t in self.items]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t, self.budget[i]):
                where[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in where.items():
            self.automaton.add_word(piece, (len(piece), found))
        if where:
            self.automaton.make_automaton()
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}
        self.empty = not where

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, distance, start, end) of the best match of each item that is within its budget, in the order of items."""
        if self.empty:
            return []
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (n, found) in self.automaton.iter(text):
            for i, offset in found:
                k, m = self.budget[i], len(self.items[i][1])
                start = end + 1 - n - offset
                if not k and not stands_alone(text, start, start + m):
                    continue
                spans[i].append((max(0, start - k), min(len(text), start + m + k)))
        out = []
        for i, windows in sorted(spans.items()):
            ident, item = self.items[i]
            if not self.budget[i]:
                out.append((ident, 0, *min(windows)))
                continue
            if (at := text.find(item)) >= 0:
                out.append((ident, 0, at, at + len(item)))
                continue
            windows.sort()
            merged = [list(windows[0])]
            for a, b in windows[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            forward, backward = self.patterns.setdefault(i, (Pattern(item), Pattern(item[::-1])))
            best = min((forward.best(text[a:b]) + (a,) for a, b in merged), key=lambda x: x[0])
            if best[0] <= self.budget[i]:
                end = best[2] + best[1]
                low = max(0, end - len(item) - self.budget[i])
                out.append((ident, best[0], end - backward.best(text[low:end][::-1])[1], end))
        return out


#: What a worker keeps: the matcher of the shard it has had last, by the shard's own name.
_matchers: dict[tuple[str, float], Matcher] = {}
at_release.append(_matchers.clear)


def _id_type(benchmark: DataFrame, item_id: str) -> str:
    return "long" if benchmark.schema[item_id].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def _shards(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[str, list[tuple[object, str]]]]:
    """A name and normalised items, SHARD_CHARS at a time; the driver holds one shard. At least one comes, maybe empty."""
    shard, size = [], 0
    items = benchmark.select(F.col(item_id).cast(_id_type(benchmark, item_id)).alias("i"), F.col(text).alias("t"))
    for row in items.where("t IS NOT NULL").distinct().orderBy("i", "t").toLocalIterator():
        item = normalize(row["t"])
        if not item:
            continue
        if shard and size + len(item) > SHARD_CHARS:
            yield uuid.uuid4().hex, shard
            shard, size = [], 0
        shard.append((row["i"], item))
        size += len(item)
    yield uuid.uuid4().hex, shard


def _matcher(shared, rate: float) -> Matcher:
    name, items = shared.value
    if (name, rate) not in _matchers:
        _matchers.clear()
        _matchers[name, rate] = Matcher(items, rate)
    return _matchers[name, rate]


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, start, end: a row for each document and item it holds within the item's edit budget.

    start and end: characters of the normalised text; of several passages the nearest, then the first.
    item_id is a long where the benchmark's ids are integers, else a string. Null and blank texts and
    items match nothing. Repeated rows of docs are searched each for itself; items of one id, or with a
    null one, are searched each. Empty tables: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    schema = f"doc_id long, item_id {_id_type(benchmark, item_id)}, distance int, start int, end int"
    kinds = (pa.int64(), pa.int64() if "item_id long" in schema else pa.string(), pa.int32(), pa.int32(), pa.int32())
    found = None
    for items in _shards(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, rate)
            for batch in batches:
                ids, out = batch.column(0), []
                for i, t in enumerate(batch.column(1)):
                    out += [(ids[i].as_py(), *m) for m in matcher.find(normalize(t.as_py()))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

        part = map_in_arrow(rows, run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """docs without the rows that hold an item. All columns stay; nothing is shuffled. Null texts stay.

    Each shard of items is a pass over what the one before left; between passes that is written down, so
    a task holds one automaton however many items there are.
    """
    spark = docs.sparkSession
    ship(spark)
    place = docs.columns.index(text)
    for number, items in enumerate(_shards(benchmark, item_id, item_text)):
        if number:
            docs = materialize(docs, "decontaminated")
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, rate)
            for batch in batches:
                keep = [t is None or not matcher.find(normalize(t)) for t in batch.column(place).to_pylist()]
                yield batch.filter(pc.fill_null(pa.array(keep, pa.bool_()), True))

        docs = map_in_arrow(docs, run, docs.schema)
    return docs
