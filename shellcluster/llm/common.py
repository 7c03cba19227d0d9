"""Words, splits and vectorised hashing shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import at_release

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that make it a hot one, which is joined by broadcast.
HOT_ROWS = 1000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % modulus


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bijection on uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def order_of(key: np.ndarray) -> np.ndarray:
    """An order in which equal uint64 keys stand together, each by place. Mixed keys only: their last bits give way to places.

    One sort of integers, much faster than one of places by key. Two keys equal in all bits but those
    may stand interleaved, so whoever counts runs compares whole keys, and may meet a key twice.
    """
    bits = np.uint64(max(1, (len(key) - 1).bit_length() if len(key) else 1))
    packed = (key >> bits << bits) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    return (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}
at_release.append(_powers.clear)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for key, base in (("p", _BASE), ("q", _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["p"], _powers["q"]


class Words:
    """Words of some texts: byte buffer, word starts and ends in it, and the first word of each text."""

    __slots__ = ("data", "ends", "first", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~_IS_SPACE[data]
        before = np.empty_like(solid)
        before[1:] = solid[:-1]
        after = np.empty_like(solid)
        after[:-1] = solid[1:]
        if len(solid):
            before[0] = after[-1] = False
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner] = False
        after[inner - 1] = False
        self.data = data
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        p, q = _power_table(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUE[self.data] * p[: len(self.data)], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * q[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; runs across texts are the caller's to skip."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += h[i : i + m]
    return mix(out)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has BROADCAST_ROWS narrow rows at most; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def join_hot(rows: DataFrame, values: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """rows joined to values, which has each key once and in n how many rows it has here. how: left or inner.

    Keys of HOT_ROWS and more don't meet in one task: they are at most a HOT_ROWS-th of the rows, and are
    broadcast if their number is BROADCAST_ROWS or less.
    """
    given = [c for c in values.columns if c != "n"]
    hot = small(values.where(F.col("n") >= HOT_ROWS).select(*given))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(values.where(F.col("n") < HOT_ROWS).select(*given), keys, how)
    return rest.unionByName(rows.join(hot, keys))


def text_slices(column: pa.Array, max_bytes: int = (2 << 20) - 1):
    """(first row, data, offsets) of runs of rows of about max_bytes; a longer text comes alone. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = int(max(at + 1, np.searchsorted(offsets, offsets[at] + max_bytes, "right") - 1))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
