"""Language-model scoring by logistic context mixing.

A text is coded as its tokens: lower-cased words, then one end. Frequent words have a binary code each
(stream.py), and every bit of it is predicted at its place in the text: hashed tables of bit counts
under the word before and the two before, and what followed the word before earlier in the text, are mixed in the logistic domain by weights that gates choose, trained online over the
texts, and an adaptive map refines the result. All other words have one code in common, an escape.

An escaped word is then spelled byte by byte and bit by bit by predictors of the same make, under bytes
before, place in the word and language of the last function word. Those it had in training also have
a prediction of their own: the discounted count, the rest of the probability going to the spelling.
The spelling's contexts don't reach over the word but for its kind, so it is computed once for all
places of the word, and once for all words that begin alike.

Over a text, experts add what it has repeated so far; they are mixed by how well each has done, so the
text's probability is the mean of theirs. What an expert gives a text is a sum over its tokens: those
of frequent ones are summed where the text is read, the others' when their spelling is joined.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import map_in_arrow, materialize, ship
from . import stream
from .common import Words, mix, order_of, text_slices

#: log2 of the least slots of each predictor; a vocabulary of more contexts gets more: place; 1, 2, 3, 4 and 5 bytes before; place and 2 bytes.
TABLE_BITS = (12, 17, 19, 20, 20, 21, 19)
#: log2 of the most slots: a worker holds 4 bytes a slot, 170 MB of all tables at most, however large the vocabulary. Beyond, contexts share slots.
MOST_BITS = 23
CHUNK = 1 << 16
#: One in so many contexts is looked at to size the tables, but for the two predictors of few contexts.
SIZE_SAMPLE = (1, 1, 16, 16, 16, 16, 16)
PREDICTORS = len(TABLE_BITS)
#: Escaped words whose probability goes with every task, the most frequent; that of all others is joined.
HEAD_ROWS = 800_000
END = b"\n"
SYMBOLS_AT_ONCE = 30_000
#: Distinct tokens that a task counts before it sends any.
TALLY_ROWS = 1_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Function words that tell a language; a token's kind is the language of the last one before it in its text.
FUNCTION_WORDS = (
    "the of and to in is that it for with are was be on by this from",
    "der die das und den von zu ist nicht im dem ein eine mit sich auf",
    "le la les des et un une est dans qui pour pas sur du",
    "el los y se las del por con para lo como más",
)
KINDS = len(FUNCTION_WORDS) + 1
#: Shares that experts give to what the text has had so far, and to its last token again; the rest goes to the model.
EXPERTS = ((0.0, 0.0), (0.1, 0.0), (0.25, 0.0), (0.5, 0.0), (0.05, 0.3), (0.05, 0.9), (0.5, 0.3), (0.8, 0.1))
APM = 33
#: Stands for null ids.
NO_ID = -(1 << 63)
_function_words: list = []
_END_HASH = np.uint64(0x1D8E4E27C47D124F)


# --- tokens ---------------------------------------------------------------------------------


class Tokens:
    """Tokens of some texts: words and an end for each text; hash of the word, kind of the token before, and the text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(np.frombuffer(data.tobytes().translate(_LOWER), np.uint8), offsets)
        h = w.hashes()
        n_docs, n = len(offsets) - 1, np.diff(w.first)
        total = len(h) + n_docs
        is_end = np.zeros(total, bool)
        is_end[np.cumsum(n + 1) - 1] = True
        self.hash = np.full(total, _END_HASH)
        self.hash[~is_end] = h
        #: First token of the text of each token.
        self.begin = np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
        self.doc = np.repeat(np.arange(n_docs), n + 1)
        self.is_end = is_end

    @cached_property
    def kind(self) -> np.ndarray:
        known, language = _languages()
        at = np.minimum(np.searchsorted(known, self.hash), len(known) - 1)
        told = np.where(known[at] == self.hash, language[at], 0)
        place = np.arange(len(told))
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(told > 0, place, -1))[:-1]]) if len(told) else place
        return np.where(last >= self.begin, told[np.maximum(last, 0)], 0)

    @cached_property
    def key(self) -> np.ndarray:
        return token_key(self.hash, self.kind)

    @cached_property
    def word(self) -> np.ndarray:
        return np.cumsum(~self.is_end) - 1


def _languages() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the function words of one language only, ascending, and their languages from 1."""
    if not _function_words:
        language: dict[str, int] = {}
        for i, line in enumerate(FUNCTION_WORDS, 1):
            for w in line.split():
                language[w] = 0 if w in language else i
        chosen = [w for w in language if language[w]]
        data = np.frombuffer(" ".join(chosen).encode(), np.uint8)
        h = Words(data, np.array([0, len(data)])).hashes()
        order = np.argsort(h)
        _function_words.append((h[order], np.array([language[w] for w in chosen])[order]))
    return _function_words[0]


def token_key(h: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return mix(h + kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def vocabulary(docs: DataFrame, learns: Column) -> DataFrame:
    """key, hash, kind, word, n (of the token after this kind, in training), c (of the token, in training), from all texts.

    docs: doc_id, text. One shuffle, by word; tasks send counts of distinct tokens.
    """
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(learns, F.lit(True)).alias("learns"))

    def merged(parts: list[tuple]) -> tuple:
        key, h, kind, text, train = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = order_of(key)
        first, code = _runs(key[order])
        pick = order[first]
        return key[pick], h[pick], kind[pick], text[pick], np.bincount(code, train[order], len(pick))

    def record(part: tuple) -> pa.RecordBatch:
        key, h, kind, text, train = part
        columns = [pa.array(key.view(np.int64)), pa.array(h.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(text.tolist(), pa.binary()), pa.array(train.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "hash", "kind", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0  # counts of distinct tokens of a task so far
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            for at, data, offsets in text_slices(batch.column(0)):
                t = Tokens(data, offsets)
                order = order_of(t.key)
                begin, code = _runs(t.key[order])
                first = order[begin]
                train = np.bincount(code, learn[at + t.doc[order]], len(first))
                raw, w = t.words.data.tobytes(), t.words
                text = [END if t.is_end[i] else raw[w.starts[j] : w.ends[j]] for i, j in zip(first.tolist(), t.word[first].tolist(), strict=True)]
                parts.append((t.key[first], t.hash[first], t.kind[first], np.array(text, object), train))
                held += len(first)
                if held > TALLY_ROWS:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > TALLY_ROWS // 2:
                        yield record(parts.pop())
                        held = 0
        if parts:
            yield record(merged(parts))

    counted = map_in_arrow(rows, run, "key long, hash long, kind int, word binary, n long").repartition(F.col("hash"))
    summed = counted.groupBy("hash", "kind").agg(F.any_value("key").alias("key"), F.any_value("word").alias("word"), F.sum("n").alias("n"))
    # by word, so the shuffle above serves this too; a word has a row for each kind at most
    # words that begin alike stand together in the files
    return materialize(summed.withColumn("c", F.sum("n").over(Window.partitionBy("hash"))).sortWithinPartitions("kind", "word"), "lm-vocabulary")


# --- the bit model --------------------------------------------------------------------------


def contexts(words: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct symbols of words (each with a space at its end): symbol, times, the symbols of each word in turn, context hashes.

    Symbols are distinct by kind and all of the word up to them, so words that begin alike share them.
    """
    words = words.cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    body = np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size + 1)
    last = np.cumsum(size + 1) - 1
    s = np.full(len(row), 32, np.uint8)
    inner = np.ones(len(row), bool)
    inner[last] = False
    s[inner] = body
    start = last - size
    pos = np.arange(len(row)) - start[row]
    value = mix(s.astype(np.uint64) * np.uint64(0x100000001B3) + pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    upto = np.cumsum(value, dtype=np.uint64)
    begun = np.concatenate([[np.uint64(0)], upto[:-1]])[start]
    k_of = kind[row].astype(np.uint64)
    _, first, each = np.unique(mix(upto - begun[row] + k_of + pos.astype(np.uint64)), return_index=True, return_inverse=True)
    # in the order of the words, so that a pass over them is one over similar words
    order = np.argsort(first, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    each, at = back[each], first[order]
    times = np.bincount(each, minlength=len(at))
    lag = []
    for k in range(1, 6):
        x = np.full(len(at), 256, np.uint64)
        deep = pos[at] >= k
        x[deep] = s[at[deep] - k]
        lag.append(x)
    place, kinds = pos[at].astype(np.uint64), k_of[at]
    chain = [lag[0]]
    for n in range(1, 5):
        chain.append(chain[-1] * np.uint64(257) + lag[n])
    eight = np.uint64(8)
    pack = [np.minimum(place, 15) * eight + kinds, chain[0] * eight + kinds, chain[1] * eight + kinds, chain[2] * eight + kinds, chain[3], mix(chain[4]), (chain[1] * np.uint64(16) + np.minimum(place, 12)) * eight + kinds]
    return s[at], times, each, [(mix(p + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)).astype(np.uint32) for j, p in enumerate(pack)]


def slots(base: list[np.ndarray], node: np.ndarray, bits: list[int]) -> list[np.ndarray]:
    """Slot of each bit in each predictor's table of 2 ** bits slots. node: the bits of the byte before it, with a leading 1; a column for each of the 8."""
    step = node.astype(np.uint32) * np.uint32(0x9E3779B1)
    return [(((b[:, None] + step) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - n)).astype(np.int64) for b, n in zip(base, bits, strict=True)]


def bits_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and bit of each of a symbol's 8 decisions."""
    wide = s.astype(np.int64)[:, None]
    k = np.arange(8)
    return (1 << k) | (wide >> (8 - k)), (wide >> (7 - k)) & 1


#: ln of a count and a little more.
_LOGS = np.log(np.arange(65536) + 0.03).astype(np.float32)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


@dataclass
class Model:
    """tables: for each predictor, counts by slot, of zeros in the low half and of ones in the high half of 32 bits; weights of each predictor by each gate; apm: zeros and ones by node and stretched probability."""

    tables: list[np.ndarray]
    by_depth: np.ndarray
    by_node: np.ndarray
    apm: np.ndarray

    def inputs(self, base: list[np.ndarray], node: np.ndarray, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (a row for each predictor), and the gate: how many of the longer contexts have been seen. bit: what to leave out of the counts once."""
        x = np.empty((PREDICTORS, node.size), np.float32)
        depth = np.zeros(node.size, np.int64)
        # a bit to leave out has been counted in its slot
        out = None if bit is None else (bit.reshape(-1) * 65535 + 1).astype(np.uint32)
        for j, at in enumerate(slots(base, node, [len(t).bit_length() - 1 for t in self.tables])):
            both = self.tables[j].take(at.reshape(-1))
            if out is not None:
                both -= out
            ones = both >> np.uint32(16)
            both &= np.uint32(0xFFFF)
            np.subtract(_LOGS.take(ones), _LOGS.take(both), out=x[j])
            both += ones
            if j > 1:
                depth += both > 0
        sure = (both > 0).astype(np.int64) + (both > 2) + (both > 6)  # of the last predictor
        return x, (depth * 4 + sure) * 8 + np.broadcast_to(np.arange(8), node.shape).reshape(-1)

    def mixed(self, x: np.ndarray, gate: np.ndarray, node: np.ndarray) -> np.ndarray:
        z = np.zeros(len(gate), np.float32)
        for v, by_depth, by_node in zip(x, self.by_depth, self.by_node, strict=True):
            w = by_depth.take(gate)
            w += by_node.take(node)
            w *= v
            z += w
        return z

    def refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one after the adaptive map."""
        at, part = apm_place(z)
        n0, n1 = (self.apm[:, :, k].reshape(-1).astype(np.float32) for k in (0, 1))
        at += node * APM
        n0, n1 = n0.take(at) * (1 - part) + n0.take(at + 1) * part, n1.take(at) * (1 - part) + n1.take(at + 1) * part
        p = squash(z)
        mapped = (n1 + 4 * p) / (n0 + n1 + 4)
        return np.clip((p + mapped) / 2, np.float32(1e-6), np.float32(1 - 1e-6))

    def log10(self, words: pa.Array, kind: np.ndarray) -> np.ndarray:
        """log10 probability of each token after its kind of token."""
        if not len(words):
            return np.zeros(0)
        s, _, each, base = contexts(words, kind)
        value = np.empty(len(s))
        for a in range(0, len(s), SYMBOLS_AT_ONCE):
            part = slice(a, a + SYMBOLS_AT_ONCE)
            node, bit = bits_of(s[part])
            x, gate = self.inputs([b[part] for b in base], node, None)
            flat = node.reshape(-1)
            p = self.refined(self.mixed(x, gate, flat), flat)
            value[part] = np.log(np.abs(p + (bit.reshape(-1) - 1).astype(np.float32))).reshape(node.shape).sum(1)
        value /= np.log(10)
        size = np.diff(np.append(np.flatnonzero(_first_symbols(words)), len(each)))
        return np.add.reduceat(value[each], np.cumsum(size) - size)


def _first_symbols(words: pa.Array) -> np.ndarray:
    """Marks where each word begins among the symbols of all."""
    size = np.diff(np.frombuffer(words.cast(pa.large_binary()).buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]) + 1
    mark = np.zeros(size.sum(), bool)
    mark[np.cumsum(size) - size] = True
    return mark


def apm_place(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where = (np.clip(z, -7.999, 7.999) + 8) * (APM - 1) / 16
    at = where.astype(np.int64)
    return at, where - at.astype(np.float32)


def pack(bits: list[int], slices: list) -> tuple[str, list[int], list]:
    """Tables under a name of their own, in compressed slices: most slots are empty, and each executor keeps a file of them."""
    return uuid.uuid4().hex, bits, slices


def unpack(packed: tuple[str, list[int], list], kind: type = np.uint32) -> list[np.ndarray]:
    """Kept by a worker until it gets others. kind: of a slot."""
    name, bits, slices = packed
    if name not in _unpacked:
        _unpacked.clear()
        tables = [np.zeros(1 << b, kind) for b in bits]
        for j, at, raw in slices:
            part = stream.unpress(raw, kind)
            tables[j][at : at + len(part)] = part
        _unpacked[name] = tables
    return _unpacked[name]


_unpacked: dict[str, list[np.ndarray]] = {}


def _fresh(tables: list[np.ndarray]) -> Model:
    return Model(tables, np.full((PREDICTORS, (PREDICTORS + 1) * 32), 0.07, np.float32), np.full((PREDICTORS, 256), 0.07, np.float32), np.zeros((256, APM, 2)))


def _sizes(vocab: DataFrame) -> list[int]:
    """log2 of the slots of each predictor: twice as many as its contexts have nodes in the training vocabulary, within TABLE_BITS and MOST_BITS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[] for _ in SIZE_SAMPLE]
        for batch in words_at_once(batches):
            s, _, _, base = contexts(batch.column(0), batch.column(1).to_numpy())
            for seen, b, every in zip(found, base, SIZE_SAMPLE, strict=True):
                some = np.flatnonzero(b % np.uint32(every) == 0) if every > 1 else slice(None)
                seen.append(np.unique(b[some].astype(np.int64) << 8 | s[some]))
                if len(seen) == 64:
                    seen[:] = [np.unique(np.concatenate(seen))]
        for j, seen in enumerate(found):
            if seen:
                both = np.unique(np.concatenate(seen))
                node, _ = bits_of((both & 255).astype(np.uint8))
                own = np.unique((both >> 8)[:, None] << 8 | node)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), j, np.int32)), pa.array(own)], names=["predictor", "node"])

    nodes = map_in_arrow(vocab.where("n > 0").select("word", "kind"), run, "predictor int, node long").distinct()
    found = {r[0]: r[1] * SIZE_SAMPLE[r[0]] for r in nodes.groupBy("predictor").count().collect()}
    return [min(MOST_BITS, max(least, (2 * found.get(j, 0)).bit_length())) for j, least in enumerate(TABLE_BITS)]


def _count(vocab: DataFrame, sizes: list[int]) -> list:
    """Bit counts of all distinct training tokens under each context: predictor, first slot and compressed counts of each slice of a table that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2 << b, np.uint32) for b in sizes]
        for batch in words_at_once(batches):
            s, times, _, base = contexts(batch.column(0), batch.column(1).to_numpy())
            for a in range(0, len(s), 2 * SYMBOLS_AT_ONCE):
                part = slice(a, a + 2 * SYMBOLS_AT_ONCE)
                node, bit = bits_of(s[part])
                weight = np.repeat(times[part], 8).astype(np.uint32)
                for table, at in zip(counts, slots([b[part] for b in base], node, sizes), strict=True):
                    np.add.at(table, (at * 2 + bit).reshape(-1), weight)
        for j, table in enumerate(counts):
            for c in range(0, len(table), 2 * CHUNK):
                if table[c : c + 2 * CHUNK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([c // 2], pa.int64()), pa.array([stream.press(table[c : c + 2 * CHUNK])])], names=["predictor", "slice", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(batch.schema.get_field_index("counts")):
                part = stream.unpress(raw.as_py(), np.uint32)
                total = part.astype(np.int64) if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([stream.press(_halves(total))])], names=["predictor", "slice", "counts"])

    parts = map_in_arrow(vocab.where("n > 0").select("word", "kind"), run, "predictor int, slice long, counts binary")
    return [tuple(r) for r in parts.groupBy("predictor", "slice").applyInArrow(add, "predictor int, slice long, counts binary").collect()]


def _halves(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts as one integer each. What 16 bits don't hold is scaled down as a pair; a count that isn't 0 stays 1 at least."""
    pairs = np.asarray(counts).reshape(-1, 2)
    most = pairs.max(1, initial=0)
    large = np.flatnonzero(most > 65535)
    scaled = np.maximum(np.rint(pairs[large] * (65535 / most[large])[:, None]), pairs[large] > 0)
    pairs = pairs.astype(np.uint32)
    pairs[large] = scaled.astype(np.uint32)
    return pairs[:, 0] | pairs[:, 1] << np.uint32(16)


def _train(vocab: DataFrame, shared) -> Model:
    """Mixing weights and the adaptive map. Every task goes online over its distinct tokens, each left out of the counts once; weights are then averaged. Without tables: workers have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, seen = _fresh(unpack(shared.value)), 0.0
        steps = [np.full(model.by_depth.shape, 1e-2), np.full(model.by_node.shape, 1e-2)]
        for batch in words_at_once(batches):
            s, times, _, base = contexts(batch.column(0), batch.column(1).to_numpy())
            for a in range(0, len(s), 4096):
                part = slice(a, a + 4096)
                node, bit = bits_of(s[part])
                flat, y = node.reshape(-1), bit.reshape(-1)
                x, gate = model.inputs([b[part] for b in base], node, bit)
                z = model.mixed(x, gate, flat)
                weight = np.repeat(times[part], 8).astype(np.float32)
                err = (y.astype(np.float32) - squash(z)) * (weight / weight.mean())
                for j in range(PREDICTORS):
                    slopes = err * x[j]
                    for table, g, past in zip((model.by_depth, model.by_node), (gate, flat), steps, strict=True):
                        slope = np.bincount(g, weights=slopes, minlength=table.shape[1])
                        past[j] += slope * slope
                        table[j] += 0.03 * slope / np.sqrt(past[j])
                if seen > 2e5 or a > len(s) // 2:
                    at, share = apm_place(z)
                    for k, w in ((at, weight * (1 - share)), (at + 1, weight * share)):
                        model.apm += np.bincount((flat * APM + k) * 2 + y, weights=w, minlength=model.apm.size).reshape(model.apm.shape)
                seen += len(y)
        if seen:
            sums = (model.by_depth * seen, model.by_node * seen, model.apm)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32], pa.int32()), pa.array([seen]), pa.array([pickle.dumps(sums)])], names=["part", "seen", "model"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0.0, None
        for batch in batches:
            for row in batch.select(["seen", "model"]).to_pylist():
                own = pickle.loads(row["model"])
                total += row["seen"]
                sums = own if sums is None else tuple(a + b for a, b in zip(sums, own, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total]), pa.array([pickle.dumps(sums)])], names=["part", "seen", "model"])

    schema = "part int, seen double, model binary"
    found = map_in_arrow(vocab.where("n > 0").select("word", "kind"), run, schema).groupBy("part").applyInArrow(add, schema).collect()
    out = _fresh([])
    if found:
        total = sum(r["seen"] for r in found)
        sums = [pickle.loads(r["model"]) for r in sorted(found, key=lambda r: r["part"])]
        out.by_depth, out.by_node = ((sum(x[i] for x in sums) / total).astype(np.float32) for i in (0, 1))
        out.apm = sum(x[2] for x in sums)
    return out


def words_at_once(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches of so many vocabulary rows: the more words, the more share their beginnings."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


# --- scores ---------------------------------------------------------------------------------


def score(docs: DataFrame, learns: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every text.

    learns: condition on docs; texts for which it holds, or is null, are learnt from, all others only
    scored. base_score: log10 of the add-one unigram probabilities; score: the model's. bits_per_byte:
    of the words and the spaces after them. Null texts are empty: one end token. Null ids and repeated
    rows are rows like others; without training texts all counts are 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(learns, F.lit(True)).alias("learns"))
    vocab = vocabulary(rows, F.col("learns"))
    train_tokens, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct(F.when(F.col("c") > 0, F.col("hash")))).first()
    coded = stream.least_count(vocab)
    code = spark.sparkContext.broadcast(stream.code_of(vocab, coded, train_tokens))
    escaped = vocab.where(F.col("c") < coded)
    sizes = _sizes(escaped)
    packed = spark.sparkContext.broadcast(pack(sizes, _count(escaped, sizes)))
    model = _train(escaped, packed)
    rest_share, discount = _shares(escaped)
    of_kind = escaped.groupBy("kind").agg(F.sum("n").alias("kind_n"))  # KINDS rows at most
    valued = materialize(_valued(escaped.join(F.broadcast(of_kind), "kind"), packed, model, rest_share, discount), "lm-values")
    packed.unpersist()  # all that was needed of the spelling is in the values
    bits = stream.table_bits(train_tokens)
    texts = rows.select("text", "learns")
    states = spark.sparkContext.broadcast(pack([bits] * stream.CONTEXTS, stream.count(texts, code, train_tokens, Tokens)))
    opened = lambda: unpack(states.value, np.uint16)
    mixer = stream.train(texts, code, opened, Tokens)
    is_head = F.col("n") >= _head(escaped)
    head = valued.where(is_head).select("key", "c", "log10_p").toArrow()
    order = np.argsort(head["key"].to_numpy(), kind="stable")
    shared = spark.sparkContext.broadcast(tuple(head[c].to_numpy()[order] for c in ("key", "c", "log10_p")))
    del head, order
    table = valued.where(~is_head).select("key", "c", "log10_p")
    floor = float(np.log10(train_tokens + distinct + 1))
    experts = [f"e{i}" for i in range(len(EXPERTS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, log10_p = shared.value
        own_code, tables = code.value, opened()
        for batch in batches:
            ids, hashes, learnt = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            for at, data, offsets in text_slices(batch.column(2), stream.SLICE):
                t = Tokens(data, offsets)
                n_docs = len(offsets) - 1
                key = t.key.view(np.int64)
                codes = own_code.of(t.hash)
                ctx, last = stream.before(t.hash, t.begin, t.doc)
                lead = mixer.log10(own_code, tables, codes, ctx, np.where(last >= 0, codes[last], -1), learnt[at + t.doc].astype(np.int32))
                hit = codes < len(own_code.size) - 1  # tokens of which all is known here
                counts = np.where(hit, own_code.count[codes], 0)
                p = lead.copy()  # without the spelling where that is joined later
                if len(keys):
                    some = np.flatnonzero(~hit)
                    where = np.minimum(np.searchsorted(keys, key[some]), len(keys) - 1)
                    found = keys[where] == key[some]
                    some, where = some[found], where[found]
                    hit[some] = True
                    counts[some] = c[where]
                    p[some] += log10_p[where]
                counts = counts[hit]
                total = lambda v: np.bincount(t.doc[hit], weights=v, minlength=n_docs)  # noqa: B023, E731
                size = np.bincount(t.doc, minlength=n_docs)
                chars = np.bincount(t.doc[~t.is_end], weights=t.words.ends - t.words.starts + 1, minlength=n_docs)
                own, h = ids[at : at + n_docs], hashes[at : at + n_docs]
                since, had, again = repeats(t)
                plain = (had == 0) & (again == 0)
                sums = by_expert(t, p, since, had, again, hit, plain, n_docs)
                yield _record(own, h, np.full(n_docs, -1), np.zeros(n_docs, bool), [size, chars, total((counts > 0).astype(float)), total(np.log10(counts + 1.0)), None, None, None, None, *sums])
                some = np.flatnonzero(~hit & plain)
                if len(some):
                    (doc, of), times = _tally(t.doc[some], key[some])
                    zero = np.zeros(len(times))
                    yield _record(own[doc], h[doc], of, np.ones(len(times), bool), [None] * 4 + [times, zero, zero, zero] + [None] * len(EXPERTS))
                some = np.flatnonzero(~hit & ~plain)
                if len(some):
                    doc = t.doc[some]
                    yield _record(own[doc], h[doc], key[some], np.ones(len(some), bool), [None] * 4 + [np.ones(len(some)), had[some], again[some], lead[some]] + [None] * len(EXPERTS))

    schema = "id long, h long, key long, tail boolean, " + ", ".join(f"{x} double" for x in [*_NUMBERS, *experts])
    # rows of one id and text are told apart by nothing: they are summed together and given back as often as they came
    parts = materialize(map_in_arrow(rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text", "learns").alias("h"), "text", "learns"), run, schema), "lm-parts")
    # what was sent to the workers is not needed any more
    for sent in (shared, states, code):
        sent.unpersist()
    times, log_p = F.col("times"), F.col("log10_p")
    tail = parts.where("tail").select("id", "h", "key", "times", "had", "again", "lead").join(table, "key").drop("key")
    both = parts.where("NOT tail").select("id", "h", "known", "base", "size", "bytes", *experts, F.lit(1).alias("one")).unionByName(tail, allowMissingColumns=True).repartition("id", "h")
    known = F.coalesce("known", F.when(F.col("c") > 0, times).otherwise(0.0))
    base = F.coalesce("base", times * F.log10(F.col("c") + 1))
    sums = [F.sum(F.coalesce(e, _given(mu, nu, times, log_p))).alias(e) for e, (mu, nu) in zip(experts, EXPERTS, strict=True)]
    summed = both.groupBy("id", "h").agg(F.sum("one").alias("one"), F.sum("size").alias("size"), F.sum("bytes").alias("bytes"), F.sum(known).alias("known"), F.sum(base).alias("base"), *sums)
    summed = summed.select("id", "h", "one", *[(F.col(x) / F.col("one")).alias(x) for x in ("size", "bytes", "known", "base", *experts)])
    best = F.greatest(*experts)
    mean = sum((F.pow(F.lit(10.0), F.col(e) - best) for e in experts), F.lit(0.0)) / len(EXPERTS)
    summed = summed.withColumn("model", best + F.log10(mean))
    out = summed.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("one").cast("int")))).withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id")))
    return out.select(
        "doc_id",
        F.round("size").cast("long").alias("n_tokens"),
        F.round("known").cast("long").alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("size") * floor).alias("base_score"),
        F.col("model").alias("score"),
        (-F.col("model") * float(np.log2(10)) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )


def repeats(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: how many its text has had, which share of them were the same, and whether the last was."""
    n = len(t.hash)
    place = np.arange(n)
    since = place - t.begin
    order = order_of(_of_text(t.hash, t.doc))
    same = np.zeros(n, bool)
    same[1:] = (t.hash[order][1:] == t.hash[order][:-1]) & (t.doc[order][1:] == t.doc[order][:-1])
    runs = np.flatnonzero(~same)
    times = np.empty(n)
    times[order] = place - np.repeat(runs, np.diff(np.append(runs, n)))
    again = np.zeros(n)
    again[1:] = (t.hash[1:] == t.hash[:-1]) & (since[1:] > 0)
    return since, times / np.maximum(since, 1), again


def by_expert(t: Tokens, log10_p: np.ndarray, since: np.ndarray, had: np.ndarray, again: np.ndarray, hit: np.ndarray, plain: np.ndarray, n_docs: int) -> np.ndarray:
    """log10 probability that each expert gives each text, but for what _given adds for tokens that aren't hit. log10_p: without it.

    The text's is the mean of them. That is the same as mixing them at every token by their shares so
    far, so a text that repeats itself is soon read by those that expect it.
    """
    summed = np.where(hit | plain, log10_p, 0.0)
    all_of = np.tile(np.bincount(t.doc, weights=summed, minlength=n_docs), (len(EXPERTS), 1))
    later = np.bincount(t.doc[(hit | plain) & (since > 0)], minlength=n_docs)
    some = np.flatnonzero(hit & ~plain)  # a text's first token is plain
    doc, had, again, log10_p = t.doc[some], had[some], again[some], log10_p[some]
    p = np.exp(np.maximum(log10_p, -300) * np.log(10))
    for own, (mu, nu) in zip(all_of, EXPERTS, strict=True):
        less = np.log10(1 - mu - nu)
        own += less * later
        if mu or nu:
            value = (1 - mu - nu) * p + mu * had + nu * again
            more = np.log(np.maximum(value, 1e-300)) / np.log(10) - (log10_p + less)
            own += np.bincount(doc, weights=np.where(value < 1e-290, 0.0, more), minlength=n_docs)
    return all_of


def _given(mu: float, nu: float, times: Column, log10_p: Column) -> Column:
    """What an expert adds for a token whose spelling was joined; by_expert has added the share it leaves to plain ones, and their escapes."""
    whole = log10_p + F.col("lead")
    value = (1 - mu - nu) * F.pow(F.lit(10.0), F.greatest(whole, F.lit(-300.0))) + mu * F.col("had") + nu * F.col("again")
    small = whole + float(np.log10(1 - mu - nu))
    return F.when((F.col("had") == 0) & (F.col("again") == 0), times * log10_p).otherwise(times * F.when(value < 1e-290, small).otherwise(F.log10(value)))


def _head(vocab: DataFrame) -> int:
    """Least count of a token whose probability goes with every task, so that HEAD_ROWS do at most."""
    sizes = {r[0]: r[1] for r in vocab.where("n > 0").groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*")).collect()}
    held, least = 0, None
    for level in sorted(sizes, reverse=True):
        if held + sizes[level] > HEAD_ROWS:
            break
        held, least = held + sizes[level], 1 << level
    return least if least is not None else (1 << 62)


def _shares(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """By kind, the share of the spelling among words of a vocabulary, and the discount of their counts."""
    rows = vocab.where("n > 0").groupBy("kind").agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect()
    share, discount = np.ones(KINDS), np.zeros(KINDS)
    for kind, n, types, once, twice in rows:
        discount[kind] = once / (once + 2 * twice) if 0 < once and twice else 0.5
        share[kind] = discount[kind] * types / n
    return np.clip(share, 1e-9, 1), discount


def _tally(doc: np.ndarray, key: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(doc, key) of each run of them, and its length; a pair may come in two runs."""
    order = order_of(_of_text(key.view(np.uint64), doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return (doc[new], key[new]), np.diff(np.append(np.flatnonzero(new), len(key)))


def _of_text(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(key + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and the run of each key."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


_NUMBERS = ("size", "bytes", "known", "base", "times", "had", "again", "lead")


def _record(ids, h, key, tail, numbers) -> pa.RecordBatch:
    names = ["id", "h", "key", "tail", *_NUMBERS, *[f"e{i}" for i in range(len(EXPERTS))]]
    columns = [pa.nulls(len(ids), pa.float64()) if x is None else pa.array(np.asarray(x, float)) for x in numbers]
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(h.astype(np.int64)), pa.array(key.astype(np.int64)), pa.array(tail), *columns], names=names)


def _valued(vocab: DataFrame, packed, model: Model, rest_share: np.ndarray, discount: np.ndarray) -> DataFrame:
    """key, c, n and log10 probability, after the escape, of all escaped tokens: the spelling's share of it and the discounted count in training."""
    spark = vocab.sparkSession
    shared = spark.sparkContext.broadcast((model, rest_share, discount))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rest, less = shared.value
        model = replace(model, tables=unpack(packed.value))
        for batch in words_at_once(batches):
            n, kind = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            log10_p = model.log10(batch.column(3), kind) + np.log10(rest[kind])
            known = n > 0
            count = (n[known] - less[kind[known]]) / batch.column(5).to_numpy()[known]
            log10_p[known] = np.log10(10.0 ** np.maximum(log10_p[known], -300) + count)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(log10_p)], names=["key", "c", "n", "log10_p"])

    return map_in_arrow(vocab.select("key", "c", "n", "word", "kind", "kind_n"), run, "key long, c long, n long, log10_p double")
