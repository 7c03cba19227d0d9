"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed into buckets with a vector each; words
together are the mean of their vectors, and a linear softmax, trained jointly with them, tells the
label. A misspelling that was never seen shares most n-grams, and so vectors, with the word. Two such
models are trained: the bags of the first are whole texts; those of the second are windows of words,
the ones that the first finds worst and some others. Both are linear in the buckets, so their sum is
one table. A mean over a whole text dilutes one insult in a thousand words, so a text is as toxic as
its worst window; a logistic curve over that and the text's length, fitted on documents that the
vectors were not fitted on, makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import map_in_arrow, materialize, ship
from .common import mix
from .gam import labelled_sample

BUCKETS = 1 << 18
DIMENSIONS = 12
SIZES = (3, 4, 5)
WINDOW = 8
STRIDE = 4
#: Labelled documents learnt from at most, of each label, by a hash of their ids, and characters of them all: whole texts up to it.
SAMPLE_ROWS = 1_500
SAMPLE_CHARS = 16_000_000
#: Windows of a document that the second model gets: the worst ones, and of clean documents some others.
POSITIVE_WINDOWS = 2
NEGATIVE_WINDOWS = 4
OTHER_WINDOWS = 4
#: Grams that training on whole texts goes over, in so many rounds at least and at most.
GRAM_VISITS = 60_000_000
EPOCHS = (5, 25)
#: Documents that a gram must be in to have a vector; others say nothing about new texts.
LEAST_DOCUMENTS = 2

_SEPARATORS = np.zeros(0x250, bool)
_SEPARATORS[[i for i in range(0x250) if not (chr(i).isalnum() or chr(i) in "@$'")]] = True
_K = np.uint64(0x9E3779B97F4A7C15)


class Bags:
    """n-grams of the words of some texts: the bucket of each gram, and the word it belongs to."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        joined = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])  # of the separator before each text
        low = joined < len(_SEPARATORS)
        gap = np.zeros(len(joined), bool)
        gap[low] = _SEPARATORS[joined[low]]
        # letters between single separators: runs of separators are one
        keep = np.ones(len(joined), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        code = np.where(gap, 0, joined)[keep].astype(np.uint64)
        owner = (np.searchsorted(starts, np.flatnonzero(keep), "right") - 1)[: len(code)]
        zero = code == 0
        number = np.cumsum(zero) - 1  # of the word after the last separator
        begin = np.flatnonzero(zero)[:-1] + 1
        self.n_words = len(begin)
        self.doc = owner[begin]
        grams, words = [], []
        h = code + np.uint64(1)
        zeros = np.concatenate([[0], np.cumsum(zero)])
        for n in range(2, max(SIZES) + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = h[:m] * _K + code[n - 1 :] + np.uint64(1)
            if n not in SIZES:
                continue
            # separators at the ends only: they mark where a word begins and ends
            inner = zeros[n - 1 : n - 1 + m] - zeros[1 : 1 + m]
            ok = np.flatnonzero(inner == 0)
            word = number[ok]
            grams.append(mix(h[ok] + np.uint64(n)) & np.uint64(BUCKETS - 1))
            words.append(word)
        if self.n_words:
            ends = np.append(begin[1:] - 1, len(code) - 1)
            place = (np.arange(len(code)) - np.append(begin, len(code))[number] + 1).astype(np.uint64)
            value = mix(code * np.uint64(0x10001) + place)
            value[zero] = 0
            sums = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
            grams.append(mix(sums[ends] - sums[begin] + np.uint64(0xABCDEF)) & np.uint64(BUCKETS - 1))
            words.append(np.arange(self.n_words))
        self.gram = np.concatenate(grams).astype(np.int32) if grams else np.empty(0, np.int32)
        self.word = np.concatenate(words) if words else np.empty(0, np.int64)
        # a gram that starts at the last separator belongs to no word
        if len(self.word) and self.word.max() >= self.n_words:
            ok = self.word < self.n_words
            self.gram, self.word = self.gram[ok], self.word[ok]

    def windows(self, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean value of the grams of each window, its first word and its text. value: by bucket."""
        total = np.bincount(self.word, weights=value[self.gram], minlength=self.n_words)
        count = np.bincount(self.word, minlength=self.n_words)
        ct, cc = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(count)])
        first = np.searchsorted(self.doc, np.arange(n_docs + 1))
        n = np.diff(first)
        windows = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
        doc = np.repeat(np.arange(n_docs), windows)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        a = first[doc] + step * STRIDE
        b = np.minimum(a + WINDOW, first[doc + 1])
        return (ct[b] - ct[a]) / np.maximum(cc[b] - cc[a], 1), a, doc


@dataclass
class Model:
    """value: logit that a bucket's vector gives a mean; bias; curve: of the worst window, the log of windows, and a constant."""

    value: np.ndarray
    bias: float
    curve: tuple[float, float, float]

    def worst(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each text's worst window, and how many windows it has. A text without words has the bias."""
        bags = Bags(texts)
        logit, _, doc = bags.windows(self.value, len(texts))
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, doc, logit)
        out[np.isneginf(out)] = 0
        return out + self.bias, np.bincount(doc, minlength=len(texts))

    def score(self, texts: list[str]) -> np.ndarray:
        logit, n = self.worst(texts)
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * logit + b * np.log1p(n) + c, -30, 30)))


def text_groups(column: pa.Array, max_chars: int = 400_000) -> Iterator[list[str]]:
    """Texts of an Arrow column in lists of about max_chars; nulls are empty."""
    held, size = [], 0
    for t in column:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= max_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def fit_vectors(bags: list[np.ndarray], label: np.ndarray, seed: int = 5, epochs: int = 6, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Vectors and softmax, trained jointly by AdaGrad; given back as the logit of each bucket, and the bias.

    bags: grams of each window. Of two classes only the difference of the softmax's rows matters.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights = rng.normal(0, 0.5, DIMENSIONS).astype(np.float32)
    bias = 0.0
    seen_v, seen_w = np.full(BUCKETS, 1e-4, np.float32), np.full(DIMENSIONS, 1e-4, np.float32)
    share = np.array([0.5 / max(1, (label == 0).sum()), 0.5 / max(1, (label == 1).sum())])[label.astype(int)] * len(label)
    sizes = np.array([len(b) for b in bags])
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            pick = pick[sizes[pick] > 0]
            if not len(pick):
                continue
            grams = np.concatenate([bags[i] for i in pick])
            n = sizes[pick]
            row = np.repeat(np.arange(len(pick)), n)
            mean = np.add.reduceat(vectors[grams], np.cumsum(n) - n, axis=0) / n[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ weights + bias, -30, 30)))
            err = ((p - label[pick]) * share[pick]).astype(np.float32)
            g_w = err @ mean / len(pick)
            used, code = np.unique(grams, return_inverse=True)
            amount = np.bincount(code, weights=(err / n)[row])
            g_v = amount[:, None].astype(np.float32) * weights
            seen_v[used] += (g_v * g_v).mean(1)
            vectors[used] -= (rate / np.sqrt(seen_v[used]))[:, None] * g_v * 0.1
            seen_w += g_w * g_w
            weights -= rate / np.sqrt(seen_w) * g_w * 0.1
            bias -= 0.05 * float(err.mean())
    return (vectors @ weights).astype(np.float64), bias


def fit_curve(logit: np.ndarray, windows: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, weakly held to zero."""
    x = np.stack([logit, np.log1p(windows), np.ones(len(logit))], axis=1)
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag([1e-3, 1e-1, 1e-6]), x.T @ (label - p) - np.array([1e-3, 1e-1, 1e-6]) * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1]), float(beta[2])


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Learns from at most `rows` documents of each label, and of these from as many as have `chars` characters.

    usable: condition on `__id`. The buckets of sampled texts come to the driver, four bytes a gram; texts
    don't. Without documents of both labels every score is the rate of the label.
    """
    spark = docs.sparkSession
    ship(spark)
    both = [labelled_sample(docs, labels.where(F.col(label) == y), label, rows, usable) for y in (0, 1)]
    sample = materialize(both[0].union(both[1]), "toxicity-sample")
    sizes = sample.select("doc_id", "label", F.length("text").alias("n")).collect()  # 2 * rows at most
    kept, held = [], 0
    for r in sorted(sizes, key=lambda r: (hash_of(r["doc_id"]), r["label"])):
        if held and held + r["n"] > chars:
            break
        kept.append((r["doc_id"], r["label"]))
        held += r["n"]
    # shares of the sample are not those of the labels
    counts = {r[0]: r[1] for r in labels.select(F.col(label).cast("int").alias("y"), F.col("doc_id").alias("__id")).where(F.col("y").isin(0, 1) & usable).groupBy("y").count().collect()}
    if len({y for _, y in kept}) < 2:
        rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(np.zeros(BUCKETS), 0.0, (0.0, 0.0, float(np.log(rate / (1 - rate)))))
    sample = sample.join(F.broadcast(spark.createDataFrame(kept, "doc_id long, label int")), ["doc_id", "label"]).select("doc_id", "label", "text")

    def bags_of(make) -> tuple[list[np.ndarray], np.ndarray]:
        found = map_in_arrow(sample, make, "doc_id long, label int, part int, grams binary").toPandas().sort_values(["doc_id", "label", "part"], kind="stable")
        found = found[found["doc_id"].map(lambda i: hash_of(i) % 4 != 0)]
        return [np.frombuffer(b, np.int32) for b in found["grams"]], found["label"].to_numpy(float)

    bags, y = bags_of(_whole_texts)
    if len(set(y)) < 2:
        rate = counts[1] / (counts[0] + counts[1])
        return Model(np.zeros(BUCKETS), 0.0, (0.0, 0.0, float(np.log(rate / (1 - rate)))))
    seen = np.zeros(BUCKETS, np.int32)
    for b in bags:
        seen[np.unique(b)] += 1
    known = seen >= LEAST_DOCUMENTS
    visits = sum(len(b) for b in bags)
    value, _ = fit_vectors([b[known[b]] for b in bags], y, epochs=int(np.clip(GRAM_VISITS // max(1, visits), *EPOCHS)), rate=4.0)
    value = _scaled(value * known, bags, y)
    del bags
    shared = spark.sparkContext.broadcast(value)
    windows, z = bags_of(_windows_of(shared))
    again, _ = fit_vectors([b[known[b]] for b in windows], z, seed=6, rate=1.0)
    value = value + _scaled(again * known, windows, z)
    model = Model(value, 0.0, (1.0, 0.0, 0.0))
    shared = spark.sparkContext.broadcast(model)

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_groups(batch.column(2)):
                logit, n = shared.value.worst(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(logit), pa.array(n.astype(np.int64))], names=["doc_id", "label", "logit", "n"])
                at += len(texts)

    judged = map_in_arrow(sample, worst, "doc_id long, label int, logit double, n long").toPandas().sort_values(["doc_id", "label", "logit"], kind="stable")
    other = judged[judged["doc_id"].map(lambda i: hash_of(i) % 4 == 0)]
    if other["label"].nunique() < 2:
        other = judged
    curve = fit_curve(other["logit"].to_numpy(), other["n"].to_numpy(), other["label"].to_numpy(float))
    shift = np.log(counts[1] / counts[0]) - np.log(max(1, (other["label"] == 1).sum()) / max(1, (other["label"] == 0).sum()))
    model.curve = (curve[0], curve[1], curve[2] + float(shift))
    return model


def _scaled(value: np.ndarray, bags: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """value, so that means of the bags deviate by 1 in either label."""
    mean = np.array([value[b].mean() if len(b) else 0.0 for b in bags])
    spread = np.sqrt(np.mean([mean[label == y].var() for y in (0, 1)]))
    return value / spread if spread > 0 else value


def hash_of(doc_id: int | None) -> int:
    return int(mix(np.array([doc_id or 0], np.int64).view(np.uint64))[0] >> np.uint64(8))


def _bag_rows(ids: list, labels: list, doc: np.ndarray, part: np.ndarray, grams: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([ids[d] for d in doc], pa.int64()), pa.array([labels[d] for d in doc], pa.int32()), pa.array(part, pa.int32()), pa.array(grams, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "part", "grams"])


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram buckets of each text."""
    for batch in batches:
        at = 0
        for texts in text_groups(batch.column(2)):
            ids, labels = batch.column(0).slice(at, len(texts)).to_pylist(), batch.column(1).slice(at, len(texts)).to_pylist()
            at += len(texts)
            bags = Bags(texts)
            doc = bags.doc[bags.word]
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(len(texts) + 1))
            gram = bags.gram[order]
            yield _bag_rows(ids, labels, np.arange(len(texts)), np.zeros(len(texts), np.int32), [gram[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)])


def _windows_of(shared):
    """Windows of each document to train on, as gram buckets: the worst by the shared values, and others of clean ones by a seeded order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_groups(batch.column(2)):
                ids, labels = batch.column(0).slice(at, len(texts)).to_pylist(), batch.column(1).slice(at, len(texts)).to_pylist()
                at += len(texts)
                bags = Bags(texts)
                logit, first, doc = bags.windows(shared.value, len(texts))
                toxic = np.array(labels)[doc] == 1
                picked = []
                for by, limit in ((-logit, np.where(toxic, POSITIVE_WINDOWS, NEGATIVE_WINDOWS)), (mix(first.astype(np.uint64)), np.where(toxic, 0, OTHER_WINDOWS))):
                    order = np.lexsort((by, doc))
                    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
                    picked.append(order[rank < limit[order]])
                picked = np.unique(np.concatenate(picked))
                by_word = np.argsort(bags.word, kind="stable")
                gram, word = bags.gram[by_word], bags.word[by_word]
                ends = np.minimum(first[picked] + WINDOW, np.searchsorted(bags.doc, doc[picked], "right"))
                lo, hi = np.searchsorted(word, first[picked]), np.searchsorted(word, ends)
                yield _bag_rows(ids, labels, doc[picked], np.arange(len(picked)), [gram[a:b].tobytes() for a, b in zip(lo, hi, strict=True)])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score of 0 to 1. Null and empty texts are scored as texts without words. Columns stay; one of this name is replaced."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    given = docs.select(*[c for c in docs.columns if c != name])
    place = given.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [shared.value.score(texts) for texts in text_groups(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(z) if z else np.empty(0))], names=[*batch.schema.names, name])

    return map_in_arrow(given, run, T.StructType([*given.schema.fields, T.StructField(name, T.DoubleType())]))
