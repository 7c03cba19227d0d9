"""Ranked lexical search with variable block maxima: an exact top k of all documents for each item.

Documents are counted once against the items' terms; what is kept of a document is its length and those
terms. A shard is a run of such rows with a bounded number of postings. In a shard each term's postings, in
the order of ids, are cut into blocks whose largest impacts bound their scores; the cuts are where the bounds are least too
high, found by dynamic programming. An item's search goes through its lists' cursors in order of document, takes the
first that could pass the threshold by the lists' bounds, and leaves blocks out whose bounds can't.
All shards begin with the same threshold, the k-th best of scores seen while looking up each item's rarest terms.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import map_in_arrow, materialize, ship
from .common import text_slices

#: Different terms that one pass takes to the workers; more items take further passes.
PASS_TERMS = 200_000
#: Postings of a shard, which one task holds; a document's own come whole.
SHARD_POSTINGS = 1_000_000
#: Bytes of a text that are split at once.
STRETCH = 4 << 20
#: Cuts fall between cells of CELL postings; a block has WINDOW cells at most, and a list's blocks have about MEAN_BLOCK on average.
CELL, WINDOW, MEAN_BLOCK = 4, 24, 32
#: Documents of an item's rarest terms that a shard looks at for the first threshold.
SEEDS = 256

_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes.maketrans(_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")


def term_counts(text: bytes) -> Counter[bytes]:
    """How often each term stands in a text: runs of ASCII letters and digits and of all bytes beyond ASCII, A to Z lower-cased."""
    folded = text.translate(_FOLD)
    if len(folded) <= STRETCH:
        return Counter(folded.split())
    found, at = Counter(), 0
    while at < len(folded):
        to = folded.find(b" ", at + STRETCH)
        to = len(folded) if to < 0 else to
        found.update(folded[at:to].split())
        at = to
    return found


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What an occurrence count tf adds to the score of a document with length terms."""
    m = 75 + 25 * length * n_docs // total
    return weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def _least_error_cuts(high: np.ndarray, width: np.ndarray, price: np.ndarray) -> np.ndarray:
    """For rows of cells (largest impact, postings; padded by zeros) the first cell of the block that ends before cell j of a best cutting of the first j.

    A block costs its price and, for each posting, its largest impact: what the bounds are too high by, but for a sum that all cuttings share.
    """
    rows, n = high.shape
    best = np.full((rows, n + 1), np.inf)
    best[:, 0] = 0
    came = np.zeros((rows, n + 1), np.int32)
    upto = np.concatenate([np.zeros((rows, 1)), np.cumsum(width, axis=1)], axis=1)
    for j in range(1, n + 1):
        a = max(0, j - WINDOW)
        top = np.maximum.accumulate(high[:, a:j][:, ::-1], axis=1)[:, ::-1]
        cost = best[:, a:j] + top * (upto[:, j : j + 1] - upto[:, a:j])
        at = cost.argmin(axis=1)
        best[:, j] = cost[np.arange(rows), at] + price
        came[:, j] = at + a
    return came


def _trace(came: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where a block begins, by row and cell; cells past a row's n are blocks of no one."""
    rows = np.arange(len(came))
    starts, at = np.zeros(came.shape, bool), n.copy()
    while (at > 0).any():
        at = np.where(at > 0, came[rows, at], 0)
        starts[rows, at] = True
    return starts[:, :-1]


def block_starts(impact: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in impact where blocks begin. offsets: of the lists, ascending, from 0 to len(impact); no list is empty.

    The price of a block is bisected for each list down to the least seen at which blocks have MEAN_BLOCK postings or more on average.
    """
    size = np.diff(offsets)
    cells = -(-size // CELL)
    found = [offsets[:-1]]
    for c in np.unique(np.ceil(np.log2(cells)).astype(int)) if len(cells) else ():
        lists = np.flatnonzero(np.ceil(np.log2(cells)).astype(int) == c)
        width = int(cells[lists].max())
        if width == 1:
            continue
        for some in np.array_split(lists, max(1, len(lists) * width // (1 << 19))):
            at = offsets[some][:, None] + np.arange(width * CELL)[None, :]
            inside = at < offsets[some + 1][:, None]
            grid = np.where(inside, impact[np.minimum(at, len(impact) - 1)], 0).reshape(len(some), width, CELL)
            high, count = grid.max(axis=2).astype(float), inside.reshape(grid.shape).sum(axis=2)
            low_price, high_price, wanted = np.zeros(len(some)), np.maximum(high.max(axis=1) * MEAN_BLOCK, 1.0), np.ceil(size[some] / MEAN_BLOCK)
            starts = _trace(_least_error_cuts(high, count, high_price), cells[some])
            for _ in range(4):
                price = (low_price + high_price) / 2
                tried = _trace(_least_error_cuts(high, count, price), cells[some])
                too_many = tried.sum(axis=1) > wanted
                starts = np.where(too_many[:, None], starts, tried)
                low_price, high_price = np.where(too_many, price, low_price), np.where(too_many, high_price, price)
            row, cell = np.nonzero(starts & (np.arange(width)[None, :] < cells[some][:, None]))
            found.append(offsets[some][row] + cell * CELL)
    return np.unique(np.concatenate(found))


class Postings:
    """A list of one term in a shard: documents by place, impacts, blocks (last document, largest impact)."""

    __slots__ = ("bound", "docs", "impact", "last", "most")

    def __init__(self, docs: np.ndarray, impact: np.ndarray, begins: np.ndarray):
        self.docs, self.impact = docs.tolist(), impact.tolist()
        self.last = docs[np.append(begins[1:], len(docs)) - 1].tolist()
        self.most = np.maximum.reduceat(impact, begins).tolist()
        self.bound = max(self.most)


def search(lists: list[tuple[Postings, int]], k: int, threshold: int) -> list[tuple[int, int]]:
    """(score, document) of the k best with a score above threshold; of equal scores the first documents. lists: with how often the item has the term.

    A document's score is never computed unless the bounds of the blocks it lies in could pass what is already found.
    """
    heap: list[tuple[int, int]] = []
    # cursor: [document, place, block, list, times, bound]
    cursors = [[p.docs[0], 0, 0, p, q, p.bound * q] for p, q in lists]
    cursors.sort(key=lambda c: c[0])
    while cursors:
        reach, pivot = 0, -1
        for i, c in enumerate(cursors):
            reach += c[5]
            if reach > threshold:
                pivot = i
                break
        if pivot < 0:
            break
        doc = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
            pivot += 1
        reach, ends = 0, None
        for c in cursors[: pivot + 1]:
            p = c[3]
            last = p.last
            if last[c[2]] < doc:
                c[2] = bisect_left(last, doc, c[2])
                if c[2] == len(last):  # the list ends before
                    c[2] -= 1
                    continue
            reach += p.most[c[2]] * c[4]
            if ends is None or last[c[2]] < ends:
                ends = last[c[2]]
        if reach > threshold:
            if cursors[0][0] == doc:
                score = 0
                for c in cursors[: pivot + 1]:
                    score += c[3].impact[c[1]] * c[4]
                if score > threshold:
                    if len(heap) < k:
                        heappush(heap, (score, -doc))
                    else:
                        heapreplace(heap, (score, -doc))
                    if len(heap) == k:
                        threshold = max(threshold, heap[0][0])
                to = doc + 1
            else:
                to = doc
        else:  # no document before the end of the first block, nor before another list comes in, can pass
            to = ends + 1
            if pivot + 1 < len(cursors) and cursors[pivot + 1][0] < to:
                to = cursors[pivot + 1][0]
        ended = False
        for c in cursors[: pivot + 1]:
            if c[0] < to:
                docs = c[3].docs
                at = c[1] + 1
                if at < len(docs) and docs[at] < to:
                    at = bisect_left(docs, to, at)
                if at >= len(docs):
                    c[0] = -1
                    ended = True
                else:
                    c[1], c[0] = at, docs[at]
        if ended:
            cursors = [c for c in cursors if c[0] >= 0]
        cursors.sort(key=lambda c: c[0])
    return [(s, -d) for s, d in heap]


class Shard:
    """Postings of a run of counted documents, by term."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, length: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_terms: np.ndarray, stats: dict):
        order = np.lexsort((ids, null))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.null = ids[order], null[order]
        docs = np.repeat(place, n_terms)
        by = np.lexsort((docs, terms))
        terms, self.docs = terms[by], docs[by]
        self.impact = impacts(stats["weight"][terms], tf[by].astype(np.int64), np.repeat(length, n_terms)[by].astype(np.int64), stats["n"], stats["total"])
        first = np.flatnonzero(np.diff(terms, prepend=-1))
        self.offsets = np.append(first, len(terms))
        self.of = {int(t): i for i, t in enumerate(terms[first])}

    def seeds(self, item: list[tuple[int, int]], k: int, weight: np.ndarray) -> list[int]:
        """The k best scores among documents that hold one of the item's rarest terms."""
        mine = sorted((-int(weight[t]), self.of[t], q) for t, q in item if t in self.of)
        docs, n = [], 0
        for _, i, _ in mine:
            docs.append(self.docs[self.offsets[i] : self.offsets[i + 1]][: SEEDS - n])
            n += len(docs[-1])
            if n >= SEEDS:
                break
        if not n:
            return []
        some = np.unique(np.concatenate(docs))
        score = np.zeros(len(some), np.int64)
        for _, i, q in mine:
            a, b = self.offsets[i], self.offsets[i + 1]
            at = np.minimum(a + np.searchsorted(self.docs[a:b], some), b - 1)
            score += np.where(self.docs[at] == some, self.impact[at] * q, 0)
        return np.sort(score)[::-1][:k].tolist()

    def lists(self) -> list[Postings]:
        begins = block_starts(self.impact, self.offsets)
        cut = np.searchsorted(begins, self.offsets)
        return [Postings(self.docs[a:b], self.impact[a:b], begins[i:j] - a) for a, b, i, j in zip(self.offsets[:-1], self.offsets[1:], cut[:-1], cut[1:])]

    def id_of(self, place: int) -> int | None:
        return None if self.null[place] else int(self.ids[place])


def _shards(batches: Iterator[pa.RecordBatch], stats: dict) -> Iterator[Shard]:
    held, size = [], 0

    def shard() -> Shard:
        ids, null, length, terms, tf, n_terms = (np.concatenate(x) for x in zip(*held))
        return Shard(ids, null, length, terms, tf, n_terms, stats)

    for batch in batches:
        terms, ids = batch.column("terms"), batch.column("doc_id")
        if not len(ids):
            continue
        held.append((ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), batch.column("n").to_numpy(), terms.flatten().to_numpy(), batch.column("tf").flatten().to_numpy(), np.diff(terms.offsets.to_numpy())))
        size += len(held[-1][3])
        if size >= SHARD_POSTINGS:
            yield shard()
            held, size = [], 0
    if size:
        yield shard()


def _passes(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[dict[bytes, int], list[tuple[object, list[tuple[int, int]]]]]]:
    """Terms with numbers, and items as (id, [(term, times)]): PASS_TERMS terms at a time, of which the driver holds no more."""
    vocabulary, found = {}, []
    for row in items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        if not (counts := term_counts(row["t"].encode())):
            continue
        if found and len(vocabulary) + len(counts) > PASS_TERMS:
            yield vocabulary, found
            vocabulary, found = {}, []
        found.append((row["i"], sorted((vocabulary.setdefault(t, len(vocabulary)), n) for t, n in counts.items())))
    if found:
        yield vocabulary, found


def _count(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n, terms, tf of documents with a term at all; terms: those of the pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value[0]
        known = vocabulary.keys()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, data, offsets in text_slices(texts):
                keep, n, terms, tf, sizes = [], [], [], [], [0]
                whole = data.tobytes()
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    counts = term_counts(whole[a:b])
                    if not counts:
                        continue
                    keep.append(at + i)
                    n.append(counts.total())
                    for t in known & counts.keys() if len(counts) > len(known) else counts.keys() & known:
                        terms.append(vocabulary[t])
                        tf.append(counts[t])
                    sizes.append(len(terms))
                if keep:
                    lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return map_in_arrow(docs, run, "doc_id long, n long, terms array<int>, tf array<int>")


def _document_frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """In how many rows each term is: a row for each task and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    found = map_in_arrow(counted.select("terms"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


def rank(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of the highest scores above 0, equal scores by ascending doc_id.

    The score is that of the module's impacts, in integers. Null texts have no term, and neither are nor count as
    documents; null and blank items have no rows. Rows of one doc_id are documents each, a null id comes last among
    equal scores. Each row of items is ranked for itself, so equal item_ids give equal ranks. Other columns are ignored.
    Items are taken PASS_TERMS different terms at a time, and documents are counted anew for each pass.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    found = None
    for vocabulary, wanted in _passes(items, item_id, item_text):
        shared = spark.sparkContext.broadcast((vocabulary, [terms for _, terms in wanted]))
        counted = materialize(_count(rows, shared), "wand-counted")
        n_docs, total = counted.agg(F.count("*"), F.sum("n")).first()
        names = spark.createDataFrame([(i, ident) for i, (ident, _) in enumerate(wanted)], f"item int, item_id {kind}")
        if not n_docs:
            continue
        stats = {"n": n_docs, "total": total, "weight": term_weights(_document_frequencies(counted, len(vocabulary)), n_docs)}
        told = spark.sparkContext.broadcast(stats)
        postings = counted.where(F.size("terms") > 0)

        def seed(batches: Iterator[pa.RecordBatch], shared=shared, told=told) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, told.value):
                found = [(i, s) for i, terms in enumerate(shared.value[1]) for s in shard.seeds(terms, k, told.value["weight"])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64()))], names=["item", "score"])

        best = Window.partitionBy("item").orderBy(F.desc("score"))
        seeds = map_in_arrow(postings, seed, "item int, score long").withColumn("at", F.row_number().over(best)).where(F.col("at") <= k)
        first = {r["item"]: r["score"] for r in seeds.where(F.col("at") == k).select("item", "score").collect()}
        floors = spark.sparkContext.broadcast(first)

        def ranked(batches: Iterator[pa.RecordBatch], shared=shared, told=told, floors=floors) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, told.value):
                lists, out = shard.lists(), []
                for i, terms in enumerate(shared.value[1]):
                    mine = [(lists[shard.of[t]], q) for t, q in terms if t in shard.of]
                    out += [(i, shard.id_of(d), s) for s, d in search(mine, k, max(0, floors.value.get(i, 1) - 1))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

        hits = map_in_arrow(postings, ranked, "item int, doc_id long, score long")
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        part = materialize(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "wand-ranked")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found
