"""Token-ID output with Elias-Fano document boundaries.

The corpus is range-partitioned by document id; each task encodes its documents in
order and writes blocks.  A block holds the concatenated ids of its documents in the
narrowest fixed width and the documents' boundaries as an Elias-Fano list: the low
bits of every boundary packed side by side, the high bits in unary, and a sampled
directory for constant-time ``select``.  About 2 + log2(ids / documents) bits per
document replace a table of 64-bit offsets.

File format: a Parquet dataset, so any file system Spark writes to will do, one row
per block: ``shard int, block int, start long`` (ids of the shard before the block),
``n_ids long, width int`` (bytes per id), ``doc_ids array<long>, bounds binary``
(Elias-Fano), ``ids binary`` (little endian).

Cases: a null text is an empty text and yields the end id alone; null doc_ids come
first; equal doc_ids are ordered by text; an empty table gives no block and no rows;
further columns are ignored."""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlens.llm.common import frees, only, scratch_path

END_ID = 1
#: A block is closed when it holds this many ids.
BLOCK_IDS = 1_000_000
#: Pieces kept with their ids by each Python worker (about 170 bytes each); half go when it is full.
CACHE_PIECES = 1_000_000


# ---- Elias-Fano ----------------------------------------------------------------
class EliasFano:
    """A non-decreasing list of integers in near-minimal space, with ``select``."""

    SAMPLE = 64

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._ones = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.int64)
        n = len(v)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, int(int(v[-1] + 1) // n).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (v >> low_bits) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1, dtype=np.uint8)
        unary[at] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits or not len(i):
            return np.zeros(len(i), dtype=np.int64)
        at = np.asarray(i, dtype=np.int64)[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7)) & 1
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def decode(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((at - np.arange(self.n)) << self.low_bits) + self._low(np.arange(self.n))

    def _directory(self) -> np.ndarray:
        """Byte of ``high`` that holds each SAMPLE-th one, and the ones before that byte."""
        if self._ones is None:
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high).astype(np.int64))])
            byte = np.searchsorted(before, np.arange(0, self.n, self.SAMPLE), side="right") - 1
            self._ones = np.stack([byte, before[byte]])
        return self._ones

    def select(self, i: int) -> int:
        """The i-th value, without decoding the list."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, seen = (int(x) for x in self._directory()[:, i // self.SAMPLE])
        while seen + (k := int(self.high[byte]).bit_count()) <= i:
            seen, byte = seen + k, byte + 1
        x = int(self.high[byte])
        for _ in range(i - seen):
            x &= x - 1
        at = 8 * byte + (x & -x).bit_length() - 1
        return ((at - i) << self.low_bits) + int(self._low(np.array([i]))[0])

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQ", self.n, self.low_bits, len(self.low)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, size = struct.unpack_from("<QBQ", raw)
        head = struct.calcsize("<QBQ")
        body = np.frombuffer(raw, dtype=np.uint8, offset=head)
        return cls(n, low_bits, body[:size], body[size:])


# ---- encoding --------------------------------------------------------------------
class Encoder:
    """A tokenizer's ids for whole texts.

    For a tokenizer that lower-cases, splits by its pattern and merges inside each piece, a text's ids are those of its
    pieces in turn.  Texts of Latin letters, digits and ASCII marks are split here by that pattern; pieces met before
    are looked up, and new ones are encoded together, without being normalised and split again.  In other texts,
    the parts between ASCII white space, which no piece crosses, are encoded by the tokenizer.  A tokenizer of another
    kind is called on whole texts."""

    _PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ž]*")
    _PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\t\n\r a-z0-9ß-öø-ž]+")
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_piece = kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and \
            steps[0]["pattern"].get("Regex") == self._PATTERN and spec.get("post_processor") is None
        if self.by_piece:
            lean = spec | {"normalizer": None, "pre_tokenizer": steps[1], "added_tokens": []}
            self.merge = Tokenizer.from_str(json.dumps(lean))
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) + len(pieces) > CACHE_PIECES:  # what was met first is met most often
            for p in list(itertools.islice(reversed(self.known), len(self.known) // 2)):
                del self.known[p]
        found = self.merge.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(found.ids, dtype=self.dtype).tobytes()
        cuts = (self.width * np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(pieces) + 1))).tolist()
        self.known.update((p, raw[a:b]) for p, a, b in zip(pieces, cuts, cuts[1:], strict=False))

    def _pieces(self, text: str) -> list[str] | None:
        return self._PIECES.findall(text.lower()) if self._PLAIN.fullmatch(text) and "<|" not in text else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, ``width`` bytes each."""
        if not self.by_piece:
            return self._whole(texts)
        split = [self._pieces(t) for t in texts]
        known = self.known
        found = [None if s is None else list(map(known.get, s)) for s in split]
        new = list({p for s, f in zip(split, found, strict=True) if f and None in f for p, x in zip(s, f, strict=True) if x is None})
        if new:
            self._learn(new)
        return [self._odd(t) if f is None else b"".join(f if None not in f else [known[p] if x is None else x for p, x in zip(s, f, strict=True)])
                for t, s, f in zip(texts, split, found, strict=True)]

    def _odd(self, text: str) -> bytes:
        parts = re.split("[ \t\n\r]+", text)
        ids = dict(zip(seen := list(set(parts)), self._whole(seen), strict=True))
        return b"".join(map(ids.__getitem__, parts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and tokenizer."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- writing and reading ------------------------------------------------------------
BLOCK_SCHEMA = ("shard int, block int, start long, n_ids long, width int, doc_ids array<long>, "
                "bounds binary, ids binary")


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> str:
    """Encodes ``docs`` (doc_id, text) and writes blocks in ascending doc_id order to ``path``.
    Every document ends with ``end_id``.  Memory in a task is bounded by one block and one Arrow batch."""

    @frees
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        doc_ids, parts, sizes, block, start = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                "start": pa.array([start], pa.int64()), "n_ids": pa.array([int(bounds[-1])], pa.int64()),
                "width": pa.array([enc.width], pa.int32()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "bounds": pa.array([EliasFano.encode(bounds).to_bytes()], pa.binary()),
                "ids": pa.array([b"".join(parts)], pa.binary())})

        held = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 64):
                chunk = [t or "" for t in texts.slice(at, 64).to_pylist()]
                for doc, raw in zip(ids[at: at + 64], enc.encode(chunk), strict=True):
                    doc_ids.append(doc)
                    parts += (raw, end)
                    sizes.append(len(raw) // enc.width + 1)
                    held += sizes[-1]
                    if held >= BLOCK_IDS:
                        yield close()
                        doc_ids, parts, sizes, block, start, held = [], [], [], block + 1, start + held, 0
        if doc_ids:
            yield close()

    ordered = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text") \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.mode("overwrite").parquet(path)
    return path


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a written dataset: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row per shard: there are at most as many as shuffle partitions at writing
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before, total = {}, 0
    for shard, n in totals:
        before[shard], total = total, total + n

    @frees
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds = EliasFano.from_bytes(row["bounds"]).decode()
                wide = np.frombuffer(row["ids"], dtype="<u2" if row["width"] == 2 else "<u4").astype("<u4")
                first = before[row["shard"]] + row["start"]
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(first + bounds[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return blocks.select("shard", "start", "width", "doc_ids", "bounds", "ids") \
        .mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_output(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` to a fresh folder in the shared checkpoint folder and reads them back."""
    spark = docs.sparkSession
    return read_token_ids(spark, write_token_ids(docs, scratch_path(spark, "token-ids"), tokenizer, end_id))
