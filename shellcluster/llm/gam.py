"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic gradient boosting of shallow trees, one feature at a time and then one pair at a time, adds up
to a lookup table for each feature and pair; a score is the sum of a text's bins in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import map_in_arrow, ship
from .common import Words, grams, text_slices
from .rules import STOP_WORDS

#: Labelled rows that the model is fitted on at most, taken by a hash of their ids.
SAMPLE_ROWS = 20_000
BINS = 48
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 10
RATE = 0.15
SHRINK = 5.0

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>@^~=+_{}[]\\/",
    "bar": b"|",
    "shout": b"!?",
    "point": b".,;:",
    "line": b"\n",
    "wide": bytes(range(0xC2, 0xF5)),
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
_STOP_HASHES = None

FEATURES = (
    "log_words", "word_bytes", "word_bytes_sd", "upper", "digit", "symbol", "bar", "shout", "point", "line", "wide",
    "stop", "distinct", "adjacent", "top_word", "repeat_3", "duplicate_lines", "log_line_words",
)


def _stop_hashes() -> np.ndarray:
    global _STOP_HASHES
    if _STOP_HASHES is None:
        data = np.frombuffer(" ".join(STOP_WORDS).encode(), np.uint8)
        _STOP_HASHES = np.sort(Words(data, np.array([0, len(data)])).hashes())
    return _STOP_HASHES


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, from all of it."""
    n_docs = len(offsets) - 1
    words = Words(data, offsets)
    first = words.first
    n = np.diff(first)
    h, size = words.hashes(), (words.ends - words.starts).astype(np.float64)
    doc = np.repeat(np.arange(n_docs), n)
    per = np.maximum(n, 1)

    def bytes_in(name: str) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(_TABLES[name][data], dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)

    def share(mark: np.ndarray) -> np.ndarray:
        return np.bincount(doc[: len(mark)], weights=mark, minlength=n_docs)[:n_docs] / per

    def repeats(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: values, distinct values, and times of the commonest."""
        order = np.lexsort((value, owner))
        v, o = value[order], owner[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        starts = np.flatnonzero(new)
        times = np.diff(np.append(starts, len(v)))
        top = np.zeros(n_docs)
        np.maximum.at(top, o[starts], times)
        return np.bincount(owner, minlength=n_docs), np.bincount(o[starts], minlength=n_docs), top

    mean = np.bincount(doc, weights=size, minlength=n_docs) / per
    square = np.bincount(doc, weights=size * size, minlength=n_docs) / per
    _, distinct, top = repeats(h, doc)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    g = grams(h, 3)
    inside = doc[: len(g)] == doc[2 : 2 + len(g)] if len(g) else np.empty(0, bool)
    n3, d3, _ = repeats(g[inside], doc[: len(g)][inside]) if len(g) else (np.zeros(n_docs),) * 3
    # a line: from its first word on; its hash is the sum of its words' hashes times their places
    breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])[words.starts] if len(h) else np.empty(0, np.int64)
    new_line = np.ones(len(h), bool)
    new_line[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new_line)
    if len(at):
        place = (np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))).astype(np.uint64)
        line_hash = np.add.reduceat(h * (place * np.uint64(2) + np.uint64(1)), at)
        n_lines, d_lines, _ = repeats(line_hash, doc[at])
    else:
        n_lines = d_lines = np.zeros(n_docs)
    lines = np.maximum(n_lines, 1)
    chars = np.maximum(np.bincount(doc, weights=size, minlength=n_docs), 1)
    stop = _stop_hashes()
    found = np.minimum(np.searchsorted(stop, h), len(stop) - 1)
    columns = [
        np.log1p(n), mean, np.sqrt(np.maximum(square - mean * mean, 0)), bytes_in("upper") / chars, bytes_in("digit") / chars, bytes_in("symbol") / per, bytes_in("bar") / per,
        bytes_in("shout") / per, bytes_in("point") / per, bytes_in("line") / per, bytes_in("wide") / chars, share((stop[found] == h).astype(float)), distinct / per,
        share(same), top / per, (n3 - d3) / np.maximum(n3, 1), (n_lines - d_lines) / lines, np.log1p(n / lines),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    """edges: by feature; tables: by feature, one value more than edges; pairs: (i, j, table over coarse bins)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, by bin additions."""
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for i, j, ei, ej, t in self.pairs:
            z += t[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, w: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step of each bin: a tree of a few leaves on one feature, the best cut first."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            gl, wl = np.cumsum(g[a:b])[:-1], np.cumsum(w[a:b])[:-1]
            gs, ws = g[a:b].sum(), w[a:b].sum()
            gain = gl**2 / (wl + SHRINK) + (gs - gl) ** 2 / (ws - wl + SHRINK) - gs**2 / (ws + SHRINK)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (w[a:b].sum() + SHRINK)
    return out


def _quadrants(g: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of each cell: one cut on either feature of a pair."""
    cg, cw = g.cumsum(0).cumsum(1), w.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gll, wll = cg[:-1, :-1], cw[:-1, :-1]
    gl, wl, gt, wt = cg[:-1, -1:], cw[:-1, -1:], cg[-1:, :-1], cw[-1:, :-1]
    parts = [(gll, wll), (gl - gll, wl - wll), (gt - gll, wt - wll), (cg[-1, -1] - gl - gt + gll, cw[-1, -1] - wl - wt + wll)]
    gain = sum(a**2 / (b + SHRINK) for a, b in parts) - cg[-1, -1] ** 2 / (cw[-1, -1] + SHRINK)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.empty_like(g)
    for (a, b), rows, cols in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None)), strict=True):
        step[rows, cols] = a[i, j] / (b[i, j] + SHRINK)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on the log loss. Without both labels present, a constant."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(float(np.log(rate / (1 - rate))), [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    base = float(np.log(y.mean() / (1 - y.mean())))
    edges = [_edges(c, BINS) for c in x.T]
    codes = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j, c in enumerate(codes):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(c, y - p, len(tables[j])), np.bincount(c, p * (1 - p), len(tables[j])))
            tables[j] += step
            z += step[c]
    coarse = [_edges(c, 12) for c in x.T]
    wide = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T, strict=True)]

    def grid(i, j, weight):
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(wide[i] * b + wide[j], weight, a * b).reshape(a, b)

    p = 1 / (1 + np.exp(-z))
    gains = sorted(((_quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0], i, j) for i in range(len(coarse)) for j in range(i)), reverse=True)
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in pairs:
            p = 1 / (1 + np.exp(-z))
            step = RATE * _quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1]
            table += step
            z += step[wide[i], wide[j]]
    return Model(base, edges, tables, pairs)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, usable: Column, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, label and text of at most `rows` labelled documents, by a hash of the id; usable: which ids may be learnt from.

    Of several rows of one id and label the least text counts, so a repeated id adds no rows.
    """
    kept = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & usable)
    picked = kept.orderBy(F.xxhash64("__id"), "__id", "label").limit(rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Features of the sample come to the driver, a few dozen numbers a row; texts don't. usable: condition on `__id`."""
    spark = docs.sparkSession
    ship(spark)
    sample = labelled_sample(docs, labels, label, rows, usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(2)):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, len(x)) for i in (0, 1)] + [pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    found = map_in_arrow(sample, run, "doc_id long, label int, x array<double>").toPandas().sort_values(["doc_id", "label"], kind="stable")
    return fit(np.array(found["x"].tolist()).reshape(-1, len(FEATURES)), found["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score of 0 to 1. Null and empty texts are scored as texts without words. Columns stay; one of this name is replaced."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    place = kept.index(text)
    given = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [shared.value.score(features(data, offsets)) for _, data, offsets in text_slices(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(z) if z else np.empty(0))], names=[*batch.schema.names, name])

    from pyspark.sql import types as T

    return map_in_arrow(given, run, T.StructType([*given.schema.fields, T.StructField(name, T.DoubleType())]))
