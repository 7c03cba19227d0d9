"""Context mixing over the words of a text, in their order: the part of context_mixing that sees the words before.

Words that are frequent in training have a Huffman code each; all others have one in common, the
escape. Each bit of a code is a decision at a node of the code's tree. Predictors give its log odds:
the training counts at the node, hashed tables of bit counts at the node under the word before and
under the two before, and the word that last followed the word before in the same text.
A gate, of how often the contexts were seen, chooses the weights that mix them. A bit of a training
text is left out of the counts once, as a coder that learns as it goes hasn't seen it yet.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_in_arrow
from .common import mix, order_of, text_slices

#: Words with a code of their own at most, the most frequent; beyond, a word is escaped and spelled.
CODE_ROWS = 1 << 16
#: log2 of the slots of a context's table, at least and at most; a worker holds 2 bytes a slot (8 while it counts).
LEAST_BITS, MOST_BITS = 16, 24
CONTEXTS = 2
INPUTS = CONTEXTS + 2
#: Levels of what each context has been seen, for the gate; matches: none, one that has held so far.
LEVELS = (6, 4)
GATES = 2 * int(np.prod(LEVELS))
APM = 33
CHUNK = 1 << 16
#: Steps of a code in a line: a context's slots of so many steps stand together, a cache line of 2 ** LINE_STEPS.
LINE_STEPS = 5
#: Decisions that are mixed at once, that are counted at once (a 16-bit count holds twice as many), and of one step of the weights.
MIX_BITS = 1 << 17
COUNT_BITS = (1 << 15) - 1
STEP_BITS = 45_000
#: Tokens whose inputs are held at once in training.
WORDS_AT_ONCE = 1 << 16
#: Bytes of texts that are cut into tokens at once, about.
SLICE = 1 << 20
#: Bits that codes are compared in; longer codes need more tokens than a Fibonacci number of so many steps.
ALIGNED = 53
#: Training tokens that a task counts, about: each sends whole tables, so few tasks send less.
TASK_TOKENS = 1 << 24
EXACT = 64
_GOLD = np.uint32(0x9E3779B1)


@dataclass
class Code:
    """hash: of coded words, ascending, the place of each one's code, and each code's training count; path: node * 2 + bit of all codes, the shorter first; odds: log odds of a one at each node in training; bits: of each code, ALIGNED to the left; line: a hash of the node's line and local: its place there, from 1. The last code is the escape's."""

    hash: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    path: np.ndarray
    odds: np.ndarray
    bits: np.ndarray
    line: np.ndarray
    local: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(h), np.int64)
        if "begun" not in self.__dict__:
            # where hashes of the same first bits begin: few share them, so few steps find a hash
            self.begun = np.searchsorted(self.hash, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        out, left = np.full(len(h), len(self.size) - 1), np.arange(len(h))
        at = self.begun.take((h >> np.uint64(46)).astype(np.int64))
        while len(left):
            own = self.hash.take(at, mode="clip")
            same = np.flatnonzero(own == h)
            out[left[same]] = self.rank.take(at[same], mode="clip")
            more = np.flatnonzero((own < h) & (at + 1 < len(self.hash)))
            left, h, at = left[more], h[more], at[more] + 1
        return out


def least_count(vocab: DataFrame) -> int:
    """Least training count of a word with a code: CODE_ROWS words have it at most. A word seen once has none, so escapes are as frequent as words that come once."""
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = {r[0]: r[1] for r in vocab.where("c > 1").groupBy(level.alias("level")).agg(F.count_distinct("hash")).collect()}
    held, least = 0, 1 << 62
    for x in sorted(sizes, reverse=True):
        held += sizes[x]
        if held > CODE_ROWS:
            break
        least = max(2, int(np.ceil(2 ** (x / 8) - 1e-9)))
    return least


def code_of(vocab: DataFrame, least: int, train_tokens: int) -> Code:
    """Huffman's code of the words of so many training counts, and of the escape."""
    rows = vocab.where(F.col("c") >= least).groupBy("hash").agg(F.any_value("c").alias("c")).toArrow()
    h, c = rows["hash"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    return build(h, np.append(c, max(1, train_tokens - int(c.sum()))))


def build(h: np.ndarray, weight: np.ndarray) -> Code:
    """h: hashes of words; weight: theirs, then the escape's."""
    n = len(weight)
    heap = [(int(w), i) for i, w in enumerate(weight)]
    heapq.heapify(heap)
    parent, side, total = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.float64)
    total[:n] = weight
    for made in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = made
        side[j] = 1
        total[made] = a + b
        heapq.heappush(heap, (a + b, made))
    ones = np.zeros(2 * n - 1)
    ones[parent[:-1][side[:-1] == 1]] = total[:-1][side[:-1] == 1]
    # all codes at once, a step towards the root at a time
    size, steps, at, live = np.zeros(n, np.int64), [], np.arange(n), np.arange(n)
    while True:
        going = at != 2 * n - 2
        live, at = live[going], at[going]
        if not len(live):
            break
        steps.append((live, (parent[at] - n) * 2 + side[at]))
        size[live] += 1
        at = parent[at]
    begin, short = np.empty(n, np.int64), np.argsort(size, kind="stable")
    begin[short] = np.cumsum(size[short]) - size[short]
    path, bits = np.zeros(int(size.sum()), np.int32), np.zeros(n, np.int64)
    for back, (who, step) in enumerate(steps, 1):
        path[begin[who] + size[who] - back] = step
        bits[who] |= (step & 1) << (ALIGNED - 1 - size[who] + back)
    # nodes from the root on
    depth, head, local = [0] * (n - 1), list(range(n - 1)), [1] * (n - 1)
    for node, up, one in zip(range(n - 3, -1, -1), (parent[n:-1] - n)[::-1].tolist(), side[n:-1][::-1].tolist(), strict=True):
        depth[node] = depth[up] + 1
        if depth[node] % LINE_STEPS:
            head[node], local[node] = head[up], local[up] * 2 + one
    line = np.array(head, np.uint32) * _GOLD
    odds = (np.log(ones[n:] + 0.03) - np.log(total[n:] - ones[n:] + 0.03)).astype(np.float32)
    order = np.argsort(h)
    return Code(h[order], order, np.asarray(weight), begin, size, path, odds, bits, line, np.array(local, np.uint32))


# --- places ---------------------------------------------------------------------------------


def before(hash_: np.ndarray, begin: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the contexts of each token, and the place of the token that followed the one before when it came last in this text (-1: none). begin: the first place of its text."""
    place = np.arange(len(hash_))
    since = place - begin
    one = np.where(since > 0, np.roll(hash_, 1), np.uint64(1))
    two = np.where(since > 1, np.roll(hash_, 2), np.uint64(2))
    apart = [mix(one), mix(one * np.uint64(0xD6E8FEB86659FD93) + two)]
    own = mix(one + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = order_of(own)
    last = np.full(len(hash_), -1)
    same = own[order][1:] == own[order][:-1]
    last[order[1:][same]] = order[:-1][same]
    return [(x >> np.uint64(32)).astype(np.uint32) for x in apart], last


def runs(code: Code, codes: np.ndarray, ctx: list[np.ndarray], most: int) -> Iterator[np.ndarray]:
    """Places of tokens, in runs of one length of code and most bits at most; like contexts stand together, so their slots are at hand."""
    size = code.size.astype(np.uint64)[codes]
    order = order_of(size << np.uint64(58) | ctx[0].astype(np.uint64) << np.uint64(26) | (ctx[1] >> np.uint32(6)).astype(np.uint64))
    yield from _cut(code, codes, order, most)


def _cut(code: Code, codes: np.ndarray, order: np.ndarray, most: int) -> Iterator[np.ndarray]:
    size = code.size[codes[order]]
    ends = np.append(np.flatnonzero(size[1:] != size[:-1]) + 1, len(size))
    for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        if a < b and size[a]:
            step = max(1, most // int(size[a]))
            for c in range(a, b, step):
                yield order[c : min(b, c + step)]


def _times(size: np.ndarray) -> int | np.ndarray:
    """Bits of each token; one number if they are equal, as in runs."""
    return int(size[0]) if len(size) and (size == size[0]).all() else size


def bits_of(code: Code, codes: np.ndarray, ctx: list[np.ndarray], bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Node and bit of each decision of some tokens, its slot of 2 ** bits in each context's table, and the decisions of each token.

    A context and a line of nodes choose a line of slots; the place in it is the node's, turned by what they choose, so nodes of a line never share a slot.
    """
    size = code.size[codes]
    times = _times(size)
    if isinstance(times, int) and times:
        # codes of one length stand together
        first = int(code.begin[codes].min())
        last = int(code.begin[codes].max()) + times
        step = code.path[first:last].reshape(-1, times).take((code.begin[codes] - first) // times, 0).reshape(-1)
    else:
        end = np.cumsum(size)
        step = code.path.take(np.arange(end[-1] if len(end) else 0) + np.repeat(code.begin[codes] - end + size, size))
    node = step >> 1
    line, local = code.line.take(node), code.local.take(node)
    slots = []
    for c in ctx:
        h = np.repeat(c, times)
        h += line
        h *= np.uint32(0x85EBCA6B)
        h >>= np.uint32(32 - bits)
        h ^= local
        slots.append(h.astype(np.int64))
    step &= 1
    return node, step, slots, size


def matched(code: Code, codes: np.ndarray, expected: np.ndarray, sign: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 or -1 where the token expected (its code; -1: none) has a one or a zero at a decision, 0 where its code has parted from what was read. sign: 1 or -1 by the bit read."""
    known = expected >= 0
    apart = np.flatnonzero(known & (expected != codes))
    agreed = np.where(known, size, 0)
    # bits in common with the expected code: exponents of 53 bits are exact
    differ = code.bits[codes[apart]] ^ code.bits[expected[apart]]
    agreed[apart] = common = ALIGNED - np.frexp(differ.astype(np.float64))[1]
    times = _times(size)
    if isinstance(times, int):
        out, rows = np.zeros((len(size), times), np.float32), np.flatnonzero(known)
        out[rows] = sign.reshape(out.shape)[rows] * (np.arange(times) < agreed[rows, None])
        out, at = out.reshape(-1), apart * times + common
    else:
        turns = np.empty((len(size), 2), np.int64)
        turns[:, 0], turns[:, 1] = agreed, size - agreed
        out = np.repeat(np.tile(np.array([1, 0], np.float32), len(size)), turns.reshape(-1)) * sign
        at = (np.cumsum(size) - size + agreed)[apart]
    out[at] = -sign[at]
    return out


# --- counts ---------------------------------------------------------------------------------


def level_of(n: np.ndarray) -> np.ndarray:
    """Counts in 8 bits: exact below EXACT, in steps of a twelfth of an octave beyond."""
    return np.where(n < EXACT, n, np.minimum(255, EXACT + np.rint(12 * np.log2(np.maximum(n, EXACT) / EXACT)))).astype(np.uint16)


_COUNT = np.where(np.arange(256) < EXACT, np.arange(256), EXACT * 2.0 ** ((np.arange(256) - EXACT) / 12))


def _looks() -> tuple[np.ndarray, list[np.ndarray]]:
    """Log odds of each state of a slot, as it is, without one zero and without one one, and each context's part of the gate, by how often it was seen."""
    zeros, ones = np.tile(_COUNT, 256), np.repeat(_COUNT, 256)
    odds, seen = [], []
    for z, o in ((0, 0), (1, 0), (0, 1)):
        a, b = np.maximum(zeros - z, 0), np.maximum(ones - o, 0)
        odds.append(np.log(b + 0.05) - np.log(a + 0.05))
        seen.append(np.log2(1 + a + b))
    steps = 2 * np.cumprod([1, *LEVELS])[:CONTEXTS]
    gates = [(np.minimum(np.concatenate(seen), n - 1).astype(np.uint8) * step).astype(np.uint8) for n, step in zip(LEVELS, steps, strict=True)]
    return np.concatenate(odds).astype(np.float32), gates


_ODDS, _SEEN = _looks()


def press(values: np.ndarray) -> bytes:
    return values.nbytes.to_bytes(8, "little") + pa.compress(values.tobytes(), "zstd", asbytes=True)


def unpress(raw: bytes, kind: type | str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), kind)


def table_bits(train_tokens: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (16 * train_tokens).bit_length()))


def count(rows: DataFrame, shared, train_tokens: int, tokens) -> list:
    """Bit counts of all training texts under each context: predictor, first slot and compressed states of each slice of a table that has any. rows: text, learns. shared: the Code, broadcast."""

    bits = table_bits(train_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, used = shared.value, False
        # counts of 16 bits; what comes to their half is put aside
        counts = [np.zeros(1 << bits + 1, np.uint16) for _ in range(CONTEXTS)]
        aside: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in counts]
        for codes, ctx, _ in _training(batches, code, tokens):
            used = True
            for part in runs(code, codes, ctx, COUNT_BITS):
                _, bit, slots, _ = bits_of(code, codes[part], [c[part] for c in ctx], bits)
                for table, at, large in zip(counts, slots, aside, strict=True):
                    at *= 2
                    at += bit
                    np.add.at(table, at, np.uint16(1))
                    full = np.flatnonzero(table.take(at) >> np.uint16(15))
                    if len(full):
                        full = np.unique(at[full])
                        large.append((full, table[full]))
                        table[full] = 0
        for j, table in enumerate(counts if used else ()):
            far, more = (np.concatenate(x) for x in zip(*aside[j], strict=True)) if aside[j] else (np.zeros(0, np.int64), np.zeros(0, np.uint16))
            for c in range(0, len(table), 2 * CHUNK):
                piece = table[c : c + 2 * CHUNK].astype(np.uint32)
                own = (far >= c) & (far < c + len(piece))
                np.add.at(piece, far[own] - c, more[own].astype(np.uint32))
                most = int(piece.max())
                if most:
                    narrow = piece.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([c // 2], pa.int64()), pa.array([narrow.itemsize], pa.int32()), pa.array([press(narrow)], pa.binary())], names=["predictor", "slice", "width", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for width, raw in zip(batch.column(batch.schema.get_field_index("width")).to_pylist(), batch.column(batch.schema.get_field_index("counts")), strict=True):
                total = total + unpress(raw.as_py(), f"u{width}").astype(np.int64)
        pairs = level_of(total).reshape(-1, 2)
        states = (pairs[:, 0] | pairs[:, 1] << np.uint16(8)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([press(states)], pa.binary())], names=["predictor", "slice", "states"])

    few = rows.coalesce(max(1, -(-train_tokens // TASK_TOKENS)))
    parts = map_in_arrow(few, run, "predictor int, slice long, width int, counts binary")
    return [tuple(r) for r in parts.groupBy("predictor", "slice").applyInArrow(add, "predictor int, slice long, states binary").collect()]


def _training(batches: Iterator[pa.RecordBatch], code: Code, tokens) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Codes, contexts and expected codes of the tokens of texts that are learnt from. Batches: text, learns."""
    for batch in batches:
        learn = batch.column(1).to_numpy(zero_copy_only=False)
        if not learn.all():
            batch = batch.filter(pa.array(learn))
        for _, data, offsets in text_slices(batch.column(0), SLICE):
            t = tokens(data, offsets)
            codes = code.of(t.hash)
            ctx, last = before(t.hash, t.begin, t.doc)
            yield codes, ctx, np.where(last >= 0, codes[last], -1)


# --- the mixer ------------------------------------------------------------------------------


@dataclass
class Mixer:
    """weights: by gate, a row for each input; apm: zeros and ones by gate and stretched probability."""

    weights: np.ndarray
    apm: np.ndarray

    def inputs(self, code: Code, tables: list[np.ndarray], codes: np.ndarray, ctx: list[np.ndarray], expected: np.ndarray, leave) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of each predictor, the gate, the bit of each decision, and the decisions of each token. leave: whether each token is left out of the counts once."""
        node, bit, slots, size = bits_of(code, codes, ctx, len(tables[0]).bit_length() - 1)
        out = None if leave is None else np.repeat(leave << 16, _times(size)) * (bit + 1)
        sign = (2 * bit - 1).astype(np.float32)
        hint = matched(code, codes, expected, sign, size)
        x, gate = [code.odds.take(node), hint], (hint != 0).astype(np.int64)
        for j, (table, at) in enumerate(zip(tables, slots, strict=True)):
            state = table.take(at).astype(np.int64)
            if out is not None:
                state += out
            x.append(_ODDS.take(state))
            gate += _SEEN[j].take(state)
        return x, gate, bit, size

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = self.weights[0].take(gate) * x[0]
        for w, v in zip(self.weights[1:], x[1:], strict=True):
            w = w.take(gate)
            w *= v
            z += w
        return np.clip(z, -15, 15, out=z)

    def log10(self, code: Code, tables: list[np.ndarray], codes: np.ndarray, ctx: list[np.ndarray], expected: np.ndarray, leave) -> np.ndarray:
        """log10 probability of the code of each token at its place."""
        value = np.zeros(len(codes))
        if len(code.size) == 1:
            return value  # the escape is the only code, of no bit
        # (p + (n1 + 4 p) / (n0 + n1 + 4)) / 2 after the adaptive map, as one step from p
        seen = self.apm[0] + self.apm[1] + 4
        flat, steep = self.apm[1] / seen / 2, 0.5 + 2 / seen
        for part in runs(code, codes, ctx, MIX_BITS):
            x, gate, bit, size = self.inputs(code, tables, codes[part], [c[part] for c in ctx], expected[part], None if leave is None else leave[part])
            z = self.mixed(x, gate)
            p = squash(z)
            at = gate * APM + apm_place(z)
            p *= steep.take(at)
            p += flat.take(at)
            p += bit.astype(np.float32) - 1
            value[part] = np.log(np.abs(p, out=p), out=p).reshape(len(size), -1).sum(1)
        return value / np.log(10)


def squash(z: np.ndarray) -> np.ndarray:
    p = np.exp(-z)
    p += 1
    return np.reciprocal(p, out=p)


def apm_place(z: np.ndarray) -> np.ndarray:
    return ((np.clip(z, -7.9, 7.9) + 8) * ((APM - 1) / 16) + 0.5).astype(np.int32)


def fresh() -> Mixer:
    weights = np.repeat(np.array([0.5, 0.5, 0.4, 0.2], np.float32)[:, None], GATES, 1)
    return Mixer(weights, np.zeros((2, GATES * APM), np.float32))


def _steps(model: Mixer, code: Code, tables: list[np.ndarray], codes: np.ndarray, ctx: list[np.ndarray], expected: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Inputs, gates and bits of all decisions of some training tokens, some STEP_BITS at a time: each step has an equal share of the codes of each length, in the order of the text."""
    held = []
    for part in _cut(code, codes, np.argsort(code.size[codes].astype(np.uint8), kind="stable"), 1 << 62):
        x, gate, bit, _ = model.inputs(code, tables, codes[part], [c[part] for c in ctx], expected[part], np.ones(len(part), np.int32))
        held.append((len(part), (*x, gate, bit)))
    steps = max(1, round(sum(len(y[0]) for _, y in held) / STEP_BITS))
    for k in range(steps if held else 0):
        *x, gate, bit = (np.concatenate(y) for y in zip(*[[v[n * k // steps * (len(v) // n) : n * (k + 1) // steps * (len(v) // n)] for v in y] for n, y in held], strict=True))
        yield x, gate, bit


def train(rows: DataFrame, shared, opened, tokens) -> Mixer:
    """Weights and the adaptive map. Every task goes online over its training texts, in their order, each bit left out of the counts once; weights are then averaged. opened: gives a worker's tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, tables, model, seen = shared.value, opened(), fresh(), 0.0
        past, apm = np.full(model.weights.shape, 1e-2), np.zeros(model.apm.shape)
        for codes, ctx, expected in _training(batches, code, tokens):
            for a in range(0, len(codes), WORDS_AT_ONCE):
                some = slice(a, a + WORDS_AT_ONCE)
                for x, gate, bit in _steps(model, code, tables, codes[some], [c[some] for c in ctx], expected[some]):
                    z = model.mixed(x, gate)
                    err = bit.astype(np.float32) - squash(z)
                    for j in range(INPUTS):
                        slope = np.bincount(gate, weights=err * x[j], minlength=GATES)
                        past[j] += slope * slope
                        model.weights[j] += 0.03 * slope / np.sqrt(past[j])
                    if seen > 2e5 or 2 * a > len(codes):
                        at = gate * APM + apm_place(z)
                        both = np.bincount(at * 2 + bit, minlength=2 * apm.shape[1])
                        apm += both.reshape(-1, 2).T
                    seen += len(bit)
        if seen:
            sums = (model.weights * seen, apm)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32], pa.int32()), pa.array([seen]), pa.array([pickle.dumps(sums)], pa.binary())], names=["part", "seen", "model"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0.0, None
        for batch in batches:
            for row in batch.select(["seen", "model"]).to_pylist():
                own = pickle.loads(row["model"])
                total += row["seen"]
                sums = own if sums is None else tuple(a + b for a, b in zip(sums, own, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total]), pa.array([pickle.dumps(sums)], pa.binary())], names=["part", "seen", "model"])

    schema = "part int, seen double, model binary"
    found = sorted(map_in_arrow(rows, run, schema).groupBy("part").applyInArrow(add, schema).collect(), key=lambda r: r["part"])
    out = fresh()
    if found:
        sums = [pickle.loads(r["model"]) for r in found]
        out.weights = (sum(x[0] for x in sums) / sum(r["seen"] for r in found)).astype(np.float32)
        out.apm = sum(x[1] for x in sums).astype(np.float32)
    return out
