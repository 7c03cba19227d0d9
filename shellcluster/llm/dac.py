"""Token ids as directly addressable codes.

An id is split into chunks of fixed widths, lowest first. Level l holds the l-th chunk of all ids that
reach it, a continuation bitmap (does the id go on at level l + 1?) and a rank directory (set bits
before each block of 512). The place of an id at the next level is the rank of its bit, so any token
is read with one lookup at each of its levels, without decoding a block.

A file is one shard: magic, header length, JSON header, then 8-byte aligned sections. It also holds
the ids of its documents and where each starts. Shards in order of (part, sequence) hold the
documents in ascending order.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import map_in_arrow, materialize, scratch_path, ship
from .common import text_slices

MAGIC = b"DACODES1"
RANK_BLOCK = 512
#: Ids a task gathers before it writes a file; a longer document stays whole.
SHARD_IDS = 4_000_000
WIDTHS = (8, 8, 16)
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


# --- the format -----------------------------------------------------------------------------


def encode(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray, widths: Sequence[int] = WIDTHS) -> bytes:
    """A file's bytes. ids: unsigned 32-bit; doc_ids: int64, meaningful where known; starts: of each document, and the end."""
    if any(w not in (8, 16, 32) for w in widths) or sum(widths) < 32:
        raise ValueError("widths are 8, 16 or 32, and add up to 32 at least")
    rest = np.ascontiguousarray(ids, np.uint32)
    sections: list[bytes] = [np.asarray(doc_ids, np.int64).tobytes(), np.packbits(known, bitorder="little").tobytes(), np.asarray(starts, np.uint64).tobytes()]
    levels = []
    for width in widths:
        if not len(rest) and levels:
            break
        chunk = (rest & np.uint32((1 << width) - 1)).astype(f"<u{width // 8}")
        rest = (rest >> np.uint32(width)) if width < 32 else np.zeros_like(rest)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) // (RANK_BLOCK // 8)) * (RANK_BLOCK // 8), np.uint8)
        padded[: len(bits)] = bits
        counts = _POP[padded].reshape(-1, RANK_BLOCK // 8).sum(1, dtype=np.uint64)
        ranks = np.zeros(len(counts) + 1, "<u4")
        ranks[1:] = np.cumsum(counts)
        levels.append({"width": width, "n": len(chunk)})
        sections += [chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more]
    sizes = [len(x) for x in sections]
    head = json.dumps({"n_ids": len(ids), "n_docs": len(doc_ids), "levels": levels, "sizes": sizes}).encode()
    out = [MAGIC, len(head).to_bytes(8, "little"), head, b"\0" * (-len(head) % 8)]
    for x in sections:
        out += [x, b"\0" * (-len(x) % 8)]
    return b"".join(out)


class Reader:
    """Random access to one file's bytes."""

    def __init__(self, buffer):
        view = memoryview(buffer)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n = int.from_bytes(view[8:16], "little")
        head = json.loads(bytes(view[16 : 16 + n]))
        at = 16 + n + -n % 8
        parts = []
        for size in head["sizes"]:
            parts.append(view[at : at + size])
            at += size + -size % 8
        self.n_ids, self.n_docs = head["n_ids"], head["n_docs"]
        self.doc_ids = np.frombuffer(parts[0], "<i8")
        self.known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=self.n_docs, bitorder="little").astype(bool)
        self.starts = np.frombuffer(parts[2], "<u8").astype(np.int64)
        self.levels = [
            (x["width"], np.frombuffer(parts[3 + 3 * i], f"<u{x['width'] // 8}"), np.frombuffer(parts[4 + 3 * i], np.uint8), np.frombuffer(parts[5 + 3 * i], "<u4"))
            for i, x in enumerate(head["levels"])
        ]

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block, byte = i // RANK_BLOCK, i // 8
        return int(ranks[block]) + int(_POP[bits[block * RANK_BLOCK // 8 : byte]].sum()) + (int(_POP[bits[byte] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        """The i-th id: one lookup a level."""
        value = shift = 0
        for width, chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += width
            if not bits[i // 8] >> i % 8 & 1:
                return value
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b. Those that go on are next to each other at the next level too."""
        out = np.zeros(b - a, np.uint32)
        where, shift = np.arange(b - a), 0
        for width, chunks, bits, ranks in self.levels:
            if a >= b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            shift += width
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where = where[more]
            a = self._rank(bits, ranks, a)
            b = a + len(where)
        return out

    def document(self, d: int) -> np.ndarray:
        return self.slice(int(self.starts[d]), int(self.starts[d + 1]))


# --- tokens ---------------------------------------------------------------------------------


class WordIds(dict):
    """Ids of white-space separated chunks, as little-endian bytes; of bounded size, the least recent half goes.

    Right for tokenizers whose pre-tokenizer never joins text across ASCII white space and drops it.
    """

    def __init__(self, tokenizer, limit: int = 250_000):
        super().__init__()
        self.tokenizer, self.limit, self.old = tokenizer, limit, {}
        self.letters_alone = all(self._by_model(w) == self._whole(w) for w in _PROBES)

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _by_model(self, word: bytes) -> bytes:
        """One run of letters that the normaliser leaves as it is: the tokenizer's model without the steps around it."""
        return np.array([t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(_BYTE_LETTERS))], "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            # a full stop or comma after a letter is a piece of its own
            if len(word) > 1 and word[-1] in b".," and chr(word[-2]).isalpha() and word[-2] < 128:
                found = self[word[:-1]] + self[word[-1:]]
            elif self.letters_alone and _plain_letters(word):
                found = self._by_model(word)
            else:
                found = self._whole(word)
        self[word] = found
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        return found


def _plain_letters(word: bytes) -> bool:
    if word.isalpha():  # ASCII
        return word.islower()
    try:
        text = word.decode()
    except UnicodeDecodeError:
        return False
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


#: Byte-level alphabet: printable bytes are themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: (b if b in _PRINTABLE else 256 + b - sum(p < b for p in _PRINTABLE)) for b in range(256)}
#: Words on which both ways must agree before the short one is used.
_PROBES = [w.encode() for w in ("the", "tokenization", "übung", "naïve", "ciónes", "ßheit", "日本語", "жизнь", "x", "ñandúes")]


class Encoder:
    """Whole texts to ids with a tokenizer of the tokenizers library, given as its JSON."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        self.by_word = _splits_at_space(spec)
        self.lower = self.by_word and any(n.get("type") == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"] or {}]))
        self.words = WordIds(self.tokenizer)

    def __call__(self, text: bytes) -> bytes:
        if not self.by_word:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        # lower-casing A-Z beforehand is what the normaliser does, unless marks could compose or a special token be spelt
        if self.lower and b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.split()))


def _splits_at_space(spec: dict) -> bool:
    """Whether chunks between ASCII white space can be encoded one by one: the pre-tokenizer keeps only runs without it."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    return bool(drops) and not re.search(r"(?<!\^)\\s", pattern) and " " not in pattern and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))


_encoders: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


# --- writing and reading --------------------------------------------------------------------


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^(file:)?/+", "file:///", uri))


def write(docs: DataFrame, target: str, tokenizer_json: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", widths: Sequence[int] = WIDTHS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes every whole text and writes the files under target; returns their index.

    docs: doc_id long, text string. Null texts are empty and have the end id alone; null ids come first;
    rows of one id stand in the order of a hash of their texts, then of the texts. An empty table gives
    no files. Other columns are ignored. Index: part int, sequence int, path string, n_docs long, n_ids
    long, start long (ids of all files before). A file appears under its name when it is complete, and a
    task that runs again writes the same name and content.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("d", "h").sortWithinPartitions("d", "h", "t").select("d", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = _open(target)
        fs.create_dir(folder, recursive=True)
        ids_of, part, sequence = encoder(shared.value), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        names: list[np.ndarray] = []
        known: list[np.ndarray] = []
        sizes: list[int] = []
        n = 0

        def flush():
            nonlocal held, names, known, sizes, n, sequence
            starts = np.zeros(len(sizes) + 1, np.uint64)
            np.cumsum(sizes, out=starts[1:])
            body = encode(np.frombuffer(b"".join(held), "<u4"), np.concatenate(names), np.concatenate(known), starts, widths)
            name = f"{folder}/part-{part:06d}-{sequence:06d}.dac"
            with fs.open_output_stream(draft := f"{name}.{uuid.uuid4().hex}") as out:
                out.write(body)
            fs.move(draft, name)
            found = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sequence": pa.array([sequence], pa.int32()), "path": [name], "n_docs": pa.array([len(sizes)], pa.int64()), "n_ids": pa.array([n], pa.int64())})
            held, names, known, sizes, n, sequence = [], [], [], [], 0, sequence + 1
            return found

        for batch in batches:
            d = batch.column(0)
            for at, data, offsets in text_slices(batch.column(1)):
                raw = data.tobytes()
                for i in range(len(offsets) - 1):
                    ids = ids_of(raw[offsets[i] : offsets[i + 1]]) + end
                    held.append(ids)
                    sizes.append(len(ids) // 4)
                    n += sizes[-1]
                own = d.slice(at, len(offsets) - 1)
                names.append(own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                known.append(own.is_valid().to_numpy(zero_copy_only=False))
                if n >= shard_ids:
                    yield flush()
        if sizes:
            yield flush()

    index = materialize(map_in_arrow(ordered, run, "part int, sequence int, path string, n_docs long, n_ids long"), "dac-index")
    # one total for each part of the shuffle, so that files are counted before no single task
    totals = {r[0]: int(r[1]) for r in index.groupBy("part").agg(F.sum("n_ids")).collect()}
    base, at = [], 0
    for p in sorted(totals):
        base.append((p, at))
        at += totals[p]
    before = Window.partitionBy("part").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    bases = spark.createDataFrame(base, "part int, base long")
    return index.join(bases, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("base")


def read(spark: SparkSession, index: DataFrame, target: str) -> DataFrame:
    """A row for each document of the files, from their bytes: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(target)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(row["path"]) as f:
                    file = Reader(f.read())
                crc = [zlib.crc32(file.document(i).astype("<u4").tobytes()) for i in range(file.n_docs)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(file.doc_ids, pa.int64(), mask=~file.known), "start": pa.array(file.starts[:-1] + row["start"], pa.int64()), "n_tokens": pa.array(np.diff(file.starts), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                )

    # a fixed number, else the few small rows of the index are read by one task
    tasks = max(1, min(index.count(), 4 * spark.sparkContext.defaultParallelism))
    files = index.select("path", "start").repartition(tasks, "path")
    return map_in_arrow(files, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, target: str | None = None) -> DataFrame:
    """Writes docs to files and gives what the files hold."""
    spark = docs.sparkSession
    target = target or scratch_path(spark, "dac")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    return read(spark, write(docs, target, definition, end_id), target)
