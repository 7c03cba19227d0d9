"""N-gram Jaccard self-join by chosen paths.

Texts become sets of word-shingle hashes, and equal sets one class. A class is embedded by minwise
values, so that any coordinate of two classes agrees with the probability of their similarity. From
a root for each run, every node of the path tree picks BRANCHES coordinates at random, the same for
all sets at the node, and sends a set on by its values there: sets split on sampled shared tokens.
Buckets of a few sets are brute-forced. Larger ones are split on, and those that hardly shrink are
dense: dense buckets that share a set join into a group, which is compared block by block once, so
no group's pairs are emitted. Runs repeat until the target recall at the threshold is reached; every
link found is verified on the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_in_arrow, materialize, release, ship
from .common import Words, grams, join_hot, mix, small, text_slices

COORDINATES = 64
BRANCHES = 2
DEPTH = 3
#: Further levels that large buckets are split by.
MAX_DEPTH = 7
#: Buckets of so many classes at most are brute-forced as they are.
SMALL = 40
#: A bucket that keeps this part of the one above it is dense.
KEEPS = 0.6
#: Classes of a block of a dense group; a task compares two blocks.
BLOCK = 1024
#: Columns of the matrix of sets that a comparison multiplies at a time.
VOCABULARY = 2048
PARTS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
#: Bytes kept of a shingle's hash in stored sets.
HASH_BYTES = 6

_MULTIPLIERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def runs_for(recall: float, threshold: float, depth: int = MAX_DEPTH) -> int:
    """Runs after which a pair at the threshold has met in a bucket with probability recall, however deep buckets lie."""
    miss = 0.0
    for _ in range(depth):
        miss = (1 - threshold * (1 - miss)) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other, and how many each has.

    A text of fewer than n words has its word run as its one shingle; one without words has none.
    """
    words = Words(data, offsets)
    h, first = words.hashes(), words.first
    count = np.diff(first)
    g = grams(h, n)
    doc = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
    start = np.repeat(first[:-1], np.maximum(count - n + 1, 0)) + (np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(count - n + 1, 0)) - np.maximum(count - n + 1, 0), np.maximum(count - n + 1, 0)))
    value = g[start] if len(start) else np.empty(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        alone = np.array([int(grams(h[first[i] : first[i + 1]], int(count[i]))[0]) ^ int(count[i]) for i in short], np.uint64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, alone])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=len(count))


def signatures(value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each non-empty set, and its minwise values as uint32 rows."""
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1][sizes > 0]
    key = mix(np.add.reduceat(mix(value), at) + sizes[sizes > 0].astype(np.uint64))
    rows = np.empty((len(at), COORDINATES), np.uint32)
    for i in range(COORDINATES):
        rows[:, i] = np.minimum.reduceat(value * _MULTIPLIERS[i], at) >> np.uint64(32)
    return key, rows


def descend(path: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Paths of the next level: BRANCHES columns. The node alone decides which coordinates."""
    out = np.empty((len(path), BRANCHES), np.uint64)
    pick = mix(path ^ np.uint64(0x5851F42D4C957F2D))
    a = (pick % np.uint64(COORDINATES)).astype(np.int64)
    b = (a + 1 + ((pick >> np.uint64(20)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    for j, c in enumerate((a, b)):
        out[:, j] = mix(mix(path + np.uint64(j + 1)) ^ rows[np.arange(len(path)), c].astype(np.uint64))
    return out


def _first_paths(rows: np.ndarray, runs: int) -> np.ndarray:
    found = []
    for r in range(runs):
        paths = np.full((len(rows), 1), mix(np.array([r + 1], np.uint64))[0], np.uint64)
        for _ in range(DEPTH):
            paths = np.concatenate([descend(paths[:, j], rows) for j in range(paths.shape[1])], axis=1)
        found.append(paths)
    return np.concatenate(found, axis=1)


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _sketch(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, class (hash of the set; null without words), size, set and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(1)):
                value, sizes = shingle_sets(data, offsets, n)
                full = sizes > 0
                key, rows = signatures(value, sizes) if full.any() else (np.empty(0, np.uint64), np.empty((0, COORDINATES), np.uint32))
                every = np.zeros(len(sizes), np.int64)
                every[full] = key.view(np.int64)
                raw = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
                bounds = np.concatenate([[0], np.cumsum(sizes)]) * HASH_BYTES
                marks = np.concatenate([[0], np.cumsum(full)]) * COORDINATES * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sizes)), pa.array(every, mask=~full), pa.array(sizes, pa.int32()), _binary(raw, bounds), _binary(rows.view(np.uint8), marks)],
                    names=["doc_id", "class", "size", "shingles", "signature"],
                )

    return map_in_arrow(docs, run, "doc_id long, class long, size int, shingles binary, signature binary")


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _paths(classes: DataFrame, runs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = _first_paths(_rows(batch.column(1)), runs)
            k = paths.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), k)), pa.array(np.repeat(batch.column(2).to_numpy(), k)), pa.array(paths.reshape(-1).view(np.int64))], names=["class", "size", "path"]
            )

    return map_in_arrow(classes.select("class", "signature", "size"), run, "class long, size int, path long")


def _split(large: DataFrame) -> DataFrame:
    """large: class, size, path, signature. Each row goes on to the children of its node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column(2).to_numpy().view(np.uint64)
            below = descend(path, _rows(batch.column(3)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), BRANCHES)), pa.array(np.repeat(batch.column(1).to_numpy(), BRANCHES)), pa.array(below.reshape(-1).view(np.int64)), pa.array(np.repeat(path.view(np.int64), BRANCHES))],
                names=["class", "size", "path", "above"],
            )

    return map_in_arrow(large.select("class", "size", "path", "signature"), run, "class long, size int, path long, above long")


def _pairs_in_small(buckets: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a bucket of SMALL classes at most that their sizes allow, from rows sorted by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            path, own, size, group = cols
            for k in range(1, min(SMALL, len(path))):
                # the rows kept from the last batch have been paired with each other already
                old = len(rest[0]) if rest is not None else 0
                i = np.flatnonzero(path[:-k] == path[k:])
                i = i[i + k >= old]
                least, great = np.minimum(size[i], size[i + k]), np.maximum(size[i], size[i + k])
                i = i[(least >= threshold * great - 1e-9) & ((group[i] != group[i + k]) | (group[i] == 0)) & (own[i] != own[i + k])]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[i], own[i + k])), pa.array(np.maximum(own[i], own[i + k]))], names=["a", "b"])
            last = max(0, len(path) - SMALL)
            rest = [x[last:] for x in cols]

    return map_in_arrow(buckets.select("path", "class", "size", "group"), run, "a long, b long")


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs: a, b, sets_a, sets_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(len(left), bool)
            for i in range(len(left)):
                x, y = _set(left[i].as_py()), _set(right[i].as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = similar(shared, len(x), len(y), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return map_in_arrow(pairs.select("a", "b", "set_a", "set_b"), run, "a long, b long")


def similar(shared, x, y, threshold: float):
    return shared >= threshold * (x + y - shared) - 1e-9


def _set(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return wide.view("<u8").reshape(-1)


def linked_parts(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Least node of the component of each of n nodes. left, right: node of each row and column of the matrix."""
    label = np.arange(n, dtype=np.int32)
    while True:
        new = label.copy()
        for matrix, mine, theirs in ((linked, left, right), (linked.T, right, left)):
            some = np.flatnonzero(matrix.any(1))
            if len(some):
                np.minimum.at(new, mine[some], np.where(matrix[some], new[theirs][None, :], np.int32(n)).min(1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """table: x, y, block, class, part, shingles; the rows of blocks x and y of a group. See _dense_links."""
    x, block = table["x"][0].as_py(), table["block"].to_numpy()
    own, part = table["class"].to_numpy(), table["part"].to_numpy()
    if table["y"][0].as_py() == x:
        left = right = np.arange(len(own))
    else:
        left, right = np.flatnonzero(block == x), np.flatnonzero(block != x)
    if not len(left) or not len(right):
        return PARTS.empty_table()
    sets = [_set(s) for s in table["shingles"].to_pylist()]
    lens = np.array([len(s) for s in sets])
    value, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), lens)
    # a shingle of one set is shared by none
    again = np.flatnonzero(np.bincount(code, minlength=len(value))[code] > 1)
    value, code = np.unique(code[again], return_inverse=True)
    row = row[again]
    by_code = np.argsort(code, kind="stable")
    row, code = row[by_code], code[by_code]
    shared = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(value), VOCABULARY):  # shared shingles, a slice of the vocabulary at a time
        hit = slice(*np.searchsorted(code, [lo, lo + VOCABULARY]))
        dense = np.zeros((len(sets), min(VOCABULARY, len(value) - lo)), np.float32)
        dense[row[hit], code[hit] - lo] = 1
        shared += dense[left] @ (dense if left is right else dense[right]).T
    linked = similar(shared, lens[left][:, None], lens[right][None, :], threshold) & (own[left][:, None] != own[right][None, :])
    links = np.zeros(len(own), np.int64)
    links[left] += linked.sum(1)
    if left is not right:
        links[right] += linked.sum(0)
    node, place = np.unique(part, return_inverse=True)
    label = linked_parts(linked, place[left], place[right], len(node))
    some, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(node)))
    empty = np.zeros(len(joined), bool)
    return pa.table([pa.array(np.concatenate([own[some], node[joined]])), pa.array(np.concatenate([own[some], node[label[joined]]])), pa.array(np.concatenate([links[some], empty]))], schema=PARTS)


def _dense_links(members: DataFrame, threshold: float, edges: DataFrame | None) -> DataFrame:
    """members: group, n, class, shingles. Rows (a, b, links): class a links to so many in one pair of blocks (a = b); parts a and b are connected (links 0).

    A group is cut into blocks of BLOCK classes, and each pair of blocks is a task of its own. A part is what
    the edges known already make of a class; so comparisons with a first block, by which most of a group is
    joined, leave next to no edges to the rest. Without edges: that first round, in which parts are classes
    and every block is compared with the first one; else all other pairs.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    if edges is None:
        placed = placed.withColumn("part", F.col("class"))
        others = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    else:
        placed = placed.where("blocks > 1 AND block > 0").join(small(edges.select(F.col("node").alias("class"), "label")), "class", "left").withColumn("part", F.coalesce("label", "class"))
        others = F.sequence(F.lit(1), F.col("blocks") - 1)
    spread = placed.withColumn("other", F.explode(others))
    keyed = spread.select("group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "class", "part", "shingles")

    def run(table: pa.Table) -> pa.Table:
        out = _compare(table, threshold)
        release()
        return out

    return keyed.groupBy("group", "x", "y").applyInArrow(run, "a long, b long, links long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges: a, b. node and its component's smallest node, by rounds of least neighbour label and pointer jump."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = step.join(step.select(F.col("node").alias("to"), F.col("to").alias("far")), "to", "left")
        new = materialize(jump.select("node", F.least("to", F.coalesce("far", "to")).alias("label"), (F.least("to", F.coalesce("far", "to")) != F.col("label")).alias("moved")), f"{name}-labels")
        moved = new.where("moved").limit(1).count()
        labels = new.drop("moved")
        if not moved:
            return labels


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership, links, dense): the Jaccard self-join of texts on word n-grams.

    membership: doc_id, class, group_class, class_id, n_links, n_copies: one row for each row of docs.
    class: hash of the shingle set, null for texts without words, which link with nothing. Rows with equal
    sets are one class; n_copies counts them. n_links: other classes with a similarity of threshold or
    more. group_class: label of the connected component; class_id: its least doc_id. links: (a, b) pairs
    of classes, a < b, each once, but for those inside dense groups. dense: (a, b, links) there: for a
    class a, to how many it links in a pair of blocks; with 0 links, that a and b are in one component. Null texts count as empty; null ids and repeated ids are rows
    like others; an empty table gives empty results; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    sketch = materialize(_sketch(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), n), "jaccard-sketch")
    known = sketch.where("class IS NOT NULL")
    # any row of a class may stand for it: its set is the same
    per_class = known.groupBy("class").agg(F.min_by(F.struct("signature", "size"), F.hash("doc_id")).alias("s"), F.count("*").alias("n_copies"), F.min("doc_id").alias("first_id"))
    first = materialize(per_class.select("class", "s.signature", "s.size", "n_copies", "first_id"), "jaccard-classes")
    runs = runs_for(recall, threshold)

    brute, dense = [], []
    level = _paths(first, runs).withColumn("above_n", F.lit(None).cast("long"))
    for depth in range(DEPTH, MAX_DEPTH + 1):
        level = materialize(level, "jaccard-paths")
        counts = level.groupBy("path").agg(F.count("*").alias("n"), F.max("above_n").alias("above_n")).where("n > 1")
        counts = materialize(counts, "jaccard-counts")
        buckets = materialize(level.drop("above_n").join(small(counts), "path"), "jaccard-buckets")
        is_dense = (F.col("n") > SMALL) & (F.lit(depth == MAX_DEPTH) | (F.coalesce(F.col("n") >= KEEPS * F.col("above_n"), F.lit(False))))
        brute.append(buckets.where(F.col("n") <= SMALL).select("path", "class", "size"))
        dense.append(buckets.where(is_dense).select("path", "class"))
        if depth == MAX_DEPTH or not counts.where(F.col("n") > SMALL).limit(1).count():
            break
        large = first.select("class", "signature").join(small(buckets.where((F.col("n") > SMALL) & ~is_dense)), "class")
        above = counts.select(F.col("path").alias("above"), F.col("n").alias("above_n"))
        level = _split(large).join(small(above), "above").drop("above")

    grouped = _dense_groups(dense)
    sets = known.select("class", "shingles", "doc_id")
    dense_links = spark.createDataFrame([], "a long, b long, links long")
    if grouped is not None:
        total = grouped.groupBy("group").agg(F.count("*").alias("n"))
        inside = _one_set(sets.join(small(grouped), "class")).join(small(grouped), "class").join(small(materialize(total, "jaccard-totals")), "group")
        inside = materialize(inside, "jaccard-dense-sets")
        dense_links = materialize(_dense_links(inside, threshold, None), "jaccard-dense")
        if inside.where(F.col("n") > BLOCK).limit(1).count():
            joined = components(dense_links.where("links = 0"), "jaccard-dense")
            dense_links = dense_links.unionByName(materialize(_dense_links(inside, threshold, joined), "jaccard-dense"))
    rows = brute[0]
    for s in brute[1:]:
        rows = rows.unionByName(s)
    rows = rows.join(small(grouped), "class", "left").withColumn("group", F.coalesce("group", F.lit(0))) if grouped is not None else rows.withColumn("group", F.lit(0).cast("long"))
    found = materialize(_pairs_in_small(rows.repartition(F.col("path")).sortWithinPartitions("path"), threshold).distinct(), "jaccard-candidates")
    wanted = found.select(F.col("a").alias("class")).union(found.select(F.col("b").alias("class"))).distinct()
    some = materialize(_one_set(sets.join(small(materialize(wanted, "jaccard-wanted")), "class")), "jaccard-sets")
    full = found.join(some.select(F.col("class").alias("a"), F.col("shingles").alias("set_a")), "a").join(some.select(F.col("class").alias("b"), F.col("shingles").alias("set_b")), "b")
    links = materialize(_verify(full, threshold), "jaccard-links")

    labels = components(links.select("a", "b").union(dense_links.where("links = 0").select("a", "b")), "jaccard")
    one = F.lit(1).cast("long").alias("links")
    each = links.select(F.col("a").alias("class"), one).union(links.select("b", one)).union(dense_links.where("links > 0").select("a", "links"))
    degree = each.groupBy("class").agg(F.sum("links").alias("n_links"))
    table = first.select("class", "n_copies", "first_id").join(degree, "class", "left").join(labels.select(F.col("node").alias("class"), "label"), "class", "left")
    table = materialize(table.select("class", F.coalesce("label", "class").alias("group_class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies", "first_id"), "jaccard-table")
    heads = table.groupBy("group_class").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n"))
    heads = materialize(heads.where("n > 1"), "jaccard-heads")
    alone = F.coalesce("class_id", "first_id").alias("class_id")
    table = materialize(join_hot(table, heads, ["group_class"]).select("class", "group_class", alone, "n_links", "n_copies"), "jaccard-table")
    return join_hot(sketch.select("doc_id", "class"), table.withColumn("n", F.col("n_copies")), ["class"]), links, dense_links


def _one_set(rows: DataFrame) -> DataFrame:
    """One stored set for each class."""
    return rows.groupBy("class").agg(F.min_by("shingles", F.hash("doc_id")).alias("shingles"))


def _dense_groups(dense: list[DataFrame]) -> DataFrame | None:
    """class and group: dense buckets that share a class are one group. Buckets are joined, not their classes, of which there are many more."""
    rows = dense[0]
    for d in dense[1:]:
        rows = rows.unionByName(d)
    rows = materialize(rows, "jaccard-dense-rows")
    if not rows.limit(1).count():
        return None
    # the buckets of a class are BRANCHES ** MAX_DEPTH a run at most
    paths = materialize(rows.groupBy("class").agg(F.min("path").alias("root"), F.collect_set("path").alias("paths")), "jaccard-dense-paths")
    edges = paths.select(F.col("root").alias("a"), F.explode("paths").alias("b")).where("a != b")
    labels = components(edges, "jaccard-groups")
    found = paths.select("class", "root").join(small(labels.select(F.col("node").alias("root"), "label")), "root", "left")
    group = F.coalesce("label", "root")
    return materialize(found.select("class", F.when(group == 0, 1).otherwise(group).alias("group")), "jaccard-groups")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (least doc_id of its component), n_links, n_copies.

    Texts without words have their own id as class_id. See join for links, nulls and ties.
    """
    membership, _, _ = join(docs, doc_id, text, n, threshold, recall)
    return membership.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the near-duplicates: of each component the least id stays. All columns and rows of kept ids stay, and rows with a null id."""
    kept = near_duplicates(docs, doc_id, text, **options).where("class_id = doc_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    # beyond the checked size the texts travel to the ids instead
    kept = small(materialize(kept, "jaccard-kept"))
    return docs.join(kept, F.col(doc_id) == F.col("__kept_id"), "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))
