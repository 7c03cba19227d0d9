"""Substring deduplication by suffix automata.

A window of WINDOW words is removed where its words also start earlier. Windows are found again by
their anchor, the smallest hash of the word grams in them: equal windows have equal anchors. Anchors
that two different documents share, or one holds twice, are repeated; around them, segments (the words
of all windows of one anchor) are cut out, and equal segments become one with its first place. These
are the reference, dealt into shards by anchor. A suffix automaton of each shard streams the segments
dealt to it: the matching statistic at a word, cut to the window length, leads to the state whose first
end position is the window's first place. A whole reference has no size bound, so it isn't broadcast:
segments travel to the shard of their anchor instead. What is broadcast is a bitmap of fixed size of
the repeated anchors; where it lies, a segment is streamed without effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_in_arrow, materialize, ship
from .common import Words, grams, join_hot, mix, text_slices

WINDOW = 20
GRAM = 8
#: Bits of each bitmap of anchors: repeated ones, and frequent ones.
BITS = 1 << 26
#: Repeated anchors for each pass over the documents; more are dealt with in more passes, by hash range.
PASS_ANCHORS = BITS // 8
#: An anchor in so many documents is split: each of its windows is a segment of its own.
FREQUENT = 256
#: Words of a shard's automaton, about.
SHARD_WORDS = 20_000
#: Windows of frequent anchors that a task remembers having sent.
SENT = 200_000
#: Null ids stand before all others, as this one.
NO_ID = -(1 << 63)


class Anchored:
    """Words of a slice of texts, their 32-bit ids, and the anchors of all windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.words = words = Words(data, offsets)
        h = words.hashes()
        self.ids = (h >> np.uint64(32)).astype(np.uint32)
        self.first = words.first
        count = np.diff(self.first)
        whole = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h + (np.arange(len(h)) - np.repeat(self.first[:-1], count)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=whole[1:])
        #: A hash of each text's word sequence.
        self.key = mix(whole[self.first[1:]] - whole[self.first[:-1]] + count.astype(np.uint64)).view(np.int64)
        self.count = count
        span = window - gram + 1
        g = grams(h, gram)
        if len(g) < span:
            self.anchor = self.low = self.high = self.doc = np.empty(0, np.int64)
            self.hash = np.empty(0, np.uint64)
            return
        n = len(g) - span + 1
        least, width = g.copy(), 1
        while width * 2 <= span:
            least[: len(least) - width] = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[span - width : span - width + n])
        at = np.empty(n, np.int64)
        for j in range(span - 1, -1, -1):
            hit = g[j : j + n] == least
            at[hit] = np.flatnonzero(hit) + j
        doc = np.repeat(np.arange(len(count)), count)[:n]
        start = np.flatnonzero(np.arange(n) + window <= self.first[doc + 1])
        doc, at = doc[start], at[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        #: For each run of windows with one anchor: its document, its place, the first and the last window start.
        self.doc, self.anchor, self.low = doc[begin], at[begin], start[begin]
        self.high = start[np.append(begin[1:], len(start)) - 1] if len(begin) else begin
        self.hash = g[self.anchor]


def _bit(h: np.ndarray) -> np.ndarray:
    return (mix(h) & np.uint64(BITS - 1)).astype(np.int64)


def _pass_of(h: np.ndarray, passes: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(passes)


def _scan(docs: DataFrame, make, schema: str) -> DataFrame:
    """docs: doc_id, text (not null). make: from ids and an Anchored to a list of arrays."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for at, data, offsets in text_slices(batch.column(1)):
                own = slice(at, at + len(offsets) - 1)
                found = make(ids[own], h[own], Anchored(data, offsets, WINDOW, GRAM))
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in found], names=names)

    return docs.mapInArrow(run, schema)


def _bitmap(positions: DataFrame) -> np.ndarray:
    """positions: bit. A bitmap, put together from slices of fixed size, of BITS bits at any input."""
    chunk = 1 << 20

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(chunk, bool)
        bits[table["bit"].to_numpy() % chunk] = True
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(BITS // 8, np.uint8)
    sliced = positions.distinct().withColumn("slice", F.expr(f"bit div {chunk}"))
    for row in sliced.groupBy("slice").applyInArrow(run, "slice long, bits binary").collect():
        out[row["slice"] * chunk // 8 : (row["slice"] + 1) * chunk // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    b = _bit(h)
    return (bitmap[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


class Automaton:
    """Suffix automaton of a sequence; each state knows where it first ended."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last, self.n = 0, 0

    def add(self, c: int) -> None:
        nexts, link, length, first = self.next, self.link, self.length, self.first
        cur = len(nexts)
        nexts.append({})
        length.append(length[self.last] + 1)
        first.append(self.n)
        link.append(0)
        p = self.last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        self.n += 1

    def firsts(self, sequence: list[int], window: int) -> list[int]:
        """For each full window of the sequence, in order, where an equal run first ended; -1: nowhere."""
        nexts, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        out = []
        for j, c in enumerate(sequence):
            while state and c not in nexts[state]:
                state = link[state]
                matched = length[state]
            if c in nexts[state]:
                state = nexts[state][c]
                matched += 1
            while state and length[link[state]] >= window:  # the state of the last window words alone
                state = link[state]
            matched = min(matched, length[state])
            if j >= window - 1:
                out.append(first[state] if matched >= window else -1)
        return out


def judge_segments(segments: list[list[int]], window: int) -> list[int]:
    """Bit j of a segment's mask: its window j also occurs in an earlier segment, or earlier in itself."""
    sam, ends = Automaton(), []
    for i, s in enumerate(segments):
        for c in s:
            sam.add(c)
        ends.append(sam.n)
        sam.add(-1 - i)  # a separator of its own
    masks, at = [], 0
    for i, s in enumerate(segments):
        mask = 0
        for j, end in enumerate(sam.firsts(s, window)):
            if end < at + j + window - 1:
                mask |= 1 << j
        masks.append(mask)
        at = ends[i] + 1
    return masks


def _verdicts(segments: DataFrame) -> DataFrame:
    """segments: key, segment, doc, text_key, anchor, sorted by these: the mask of windows that are no first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            masks = judge_segments([np.frombuffer(x[1], np.uint32).tolist() for x in held], WINDOW)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.int64()), pa.array([x[3] for x in held], pa.int64()), pa.array([x[4] for x in held], pa.int64()), pa.array([x[5] for x in held], pa.int64()), pa.array(masks, pa.int64())],
                names=["key", "sequence", "doc", "text_key", "anchor", "mask"],
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "segment", "sequence", "doc", "text_key", "anchor")), strict=True):
                if size >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[1]) // 4
        if held:
            yield flush()

    return map_in_arrow(segments, run, "key long, sequence long, doc long, text_key long, anchor long, mask long")


def _runs(a: Anchored, repeated: np.ndarray, frequent: np.ndarray, which: int, passes: int):
    """Runs of windows around repeated anchors; those of frequent ones one window each. (doc, anchor, low, high, key, hash of the words)."""
    some = np.flatnonzero(_has(repeated, a.hash) & (_pass_of(a.hash, passes) == which)) if len(a.hash) else np.empty(0, np.int64)
    doc, anchor, low, high, key = a.doc[some], a.anchor[some], a.low[some], a.high[some], a.hash[some]
    many = _has(frequent, key) if len(key) else np.empty(0, bool)
    n = np.where(many, high - low + 1, 1)
    each = np.repeat(np.arange(len(some)), n)
    step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    hot = many[each]
    low, high = low[each] + step, np.where(hot, low[each] + step, high[each])
    doc, anchor, key = doc[each], anchor[each], key[each].copy()
    size = high - low + WINDOW
    total = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(total[-1]) - np.repeat(total[:-1], size)
    ids = a.ids[np.repeat(low, size) + place]
    value = mix(ids.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    sequence = mix(np.add.reduceat(value, total[:-1]) + size.astype(np.uint64)) if len(size) else np.empty(0, np.uint64)
    key[hot] = sequence[hot]
    return doc, anchor, low, high, key, sequence, ids, total


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, h and cuts (array of (low, mask, whole)): the windows of each document to remove; documents without any have no row.

    doc: the id, NO_ID for a null one; h: a hash of the text, which tells rows of one id apart. A window
    that starts at word low + j goes if bit j of mask is set; where whole isn't 0 all of them go. See
    deduplicate for nulls and ties.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).where("text IS NOT NULL")

    def texts(ids, h, a):
        long = a.count >= WINDOW
        return [ids[long], h[long], a.key[long], a.count[long].astype(np.int64)]

    whole = materialize(_scan(rows, texts, "doc long, h long, text_key long, words long").distinct(), "spans-texts")
    first = materialize(whole.groupBy("text_key").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "spans-firsts")
    copies = join_hot(whole, first, ["text_key"], "inner").where("doc > first")

    def anchors(ids, h, a):
        # of each document once, so the counts don't depend on copies
        key = a.key[a.doc]
        order = np.lexsort((key, a.hash))
        h, k = a.hash[order], key[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        times = np.diff(np.append(np.flatnonzero(new), len(h)))
        doc = a.doc[order]
        # twice in one text: two runs of one document
        twice = np.zeros(len(h), bool)
        twice[1:] = ~new[1:] & (doc[1:] == doc[:-1])
        again = np.add.reduceat(twice, np.flatnonzero(new)) > 0 if len(h) else twice
        return [h[new].view(np.int64), k[new], again, np.ones(len(times), np.int64)]

    seen = _scan(rows, anchors, "anchor long, text_key long, again boolean, n long")
    counted = seen.groupBy("anchor").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.max("again").alias("again"), F.sum("n").alias("n"))
    repeated = materialize(counted.where("again OR a != b").select("anchor", "n"), "spans-anchors")
    passes = max(1, -(-repeated.count() // PASS_ANCHORS))

    cuts = copies.select("doc", "h", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("mask"), F.col("words").alias("whole"))
    for which in range(passes):
        own = _positions(repeated, which, passes)
        shared = spark.sparkContext.broadcast((_bitmap(own.select("bit")), _bitmap(own.where(F.col("n") >= FREQUENT).select("bit"))))

        sent: dict[int, tuple] = {}  # each task has its own

        def segments(ids, _, a, which=which, shared=shared, sent=sent):
            doc, anchor, low, high, key, sequence, words, total = _runs(a, *shared.value, which, passes)
            base = a.first[doc]
            # equal segments of a slice: the first one stands for them
            order = np.lexsort((anchor - base, a.key[doc], ids[doc], sequence, key))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (sequence[order][1:] != sequence[order][:-1])
            pick = order[new]
            # a window of a frequent anchor is in nearly every slice: a task sends it again only where it has found an earlier place
            keep = np.ones(len(pick), bool)
            for i in np.flatnonzero(key[pick] == sequence[pick]).tolist():
                j = pick[i]
                place, window = (int(ids[doc[j]]), int(a.key[doc[j]]), int(anchor[j] - base[j])), int(key[j])
                keep[i] = window not in sent or place < sent[window]
                if keep[i]:
                    sent[window] = place
            if len(sent) > SENT:
                sent.clear()
            pick = pick[keep]
            size = np.diff(total)[pick]
            bounds = np.concatenate([[0], np.cumsum(size)])
            body = words[np.repeat(total[:-1][pick], size) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)]
            binary = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body).view(np.uint8))])
            return [key[pick].view(np.int64), sequence[pick].view(np.int64), binary, ids[doc[pick]], a.key[doc[pick]], (anchor - base)[pick]]

        found = _scan(rows, segments, "key long, sequence long, segment binary, doc long, text_key long, anchor long")
        place = F.min(F.struct("doc", "text_key", "anchor")).alias("p")
        distinct = found.repartition(F.col("key")).groupBy("key", "sequence").agg(place, F.any_value("segment").alias("segment"))
        ordered = distinct.select("key", "segment", "sequence", "p.doc", "p.text_key", "p.anchor").sortWithinPartitions("key", "doc", "text_key", "anchor")
        verdicts = materialize(_verdicts(ordered).select("key", "sequence", F.col("doc").alias("first_doc"), F.col("text_key").alias("first_key"), F.col("anchor").alias("first_anchor"), "mask"), "spans-verdicts")

        def places(ids, h, a, which=which, shared=shared):
            doc, anchor, low, high, key, sequence, _, _ = _runs(a, *shared.value, which, passes)
            base = a.first[doc]
            return [key.view(np.int64), sequence.view(np.int64), ids[doc], h[doc], a.key[doc], anchor - base, low - base, high - low + 1]

        # a passage of many documents is a key of many rows here: adaptive execution splits the side of the places
        at = _scan(rows, places, "key long, sequence long, doc long, h long, text_key long, anchor long, low long, n long")
        is_first = F.expr("doc = first_doc AND text_key = first_key AND anchor = first_anchor")
        hit = at.join(verdicts, ["key", "sequence"]).withColumn("gone", F.when(is_first, F.col("mask")).otherwise(F.expr("shiftleft(1L, cast(n AS int)) - 1L")))
        cuts = cuts.unionByName(hit.where("gone != 0").select("doc", "h", "low", F.col("gone").alias("mask"), F.lit(0).cast("long").alias("whole")))
    # a set: rows equal in id and text have the same cuts
    grouped = cuts.groupBy("doc", "h").agg(F.collect_set(F.struct("low", "mask", "whole")).alias("cuts"))
    return materialize(grouped, "spans-cuts")


def _positions(repeated: DataFrame, which: int, passes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            own = _pass_of(h, passes) == which
            yield pa.RecordBatch.from_arrays([pa.array(_bit(h[own])), pa.array(batch.column(1).to_numpy()[own])], names=["bit", "n"])

    return map_in_arrow(repeated, run, "bit long, n long")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: each document without the words of repeated windows.

    A word goes if a window of WINDOW words that covers it has the same words as one that starts earlier:
    in a document with a smaller id, or before it in its own. kept: the words left, joined by one space;
    kept_sha256: of its UTF-8; without with_text there is no kept. Null and blank texts have no words. Null ids stand before all others; rows
    of one id are ordered by a hash of their words, and rows equal in both count as one document and
    give the same. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = spans(docs, doc_id, text)
    joined = rows.withColumns({"doc": F.coalesce("doc_id", F.lit(NO_ID)), "h": F.xxhash64("text")}).join(cuts, ["doc", "h"], "left").select("doc_id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(1)):
                a = Anchored(data, offsets, WINDOW, GRAM)
                cuts = batch.column(2).slice(at, len(offsets) - 1).to_pylist()
                raw, starts, ends = data.tobytes(), a.words.starts, a.words.ends
                removed, digest, kept = [], [], []
                for i, found in enumerate(cuts):
                    lo, n = int(a.first[i]), int(a.count[i])
                    gone = np.zeros(n + 1, np.int32)
                    for c in found or ():
                        if c["whole"]:
                            gone[0] += 1
                        mask, at_word = c["mask"], c["low"]
                        while mask:
                            if mask & 1:
                                gone[at_word] += 1
                                gone[at_word + WINDOW] -= 1
                            mask >>= 1
                            at_word += 1
                    left = np.flatnonzero(np.cumsum(gone[:n]) == 0)
                    body = b" ".join([raw[starts[lo + j] : ends[lo + j]] for j in left.tolist()])
                    removed.append(n - len(left))
                    digest.append(hashlib.sha256(body).hexdigest())
                    if with_text:
                        kept.append(body.decode("utf-8", "replace"))
                columns = [batch.column(0).slice(at, len(cuts)), pa.array(a.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())] + [pa.array(kept, pa.string())] * with_text
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return map_in_arrow(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
