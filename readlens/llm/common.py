"""Shared helpers of the training-text operators: table access, scratch storage
and vectorised word hashing over Arrow string batches.

Word hashing works on the UTF-8 bytes of a whole batch at once.  A word's hash is a
polynomial over random byte values modulo 2**64, read off a running sum, so the
cost is a few numpy passes per byte and no Python object per word."""

from __future__ import annotations

import ctypes
import functools
import gc
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlens.plans.materialize import materialize, on_end, scratch_path

__all__ = ["U", "read", "only", "fresh", "materialize", "scratch_path", "mix", "string_batch", "row_slices", "Words", "SPACE_SEPARATED",
           "ALNUM_WORDS", "LOWER", "frees", "fixed_size_sum", "packed_slices", "stored", "drop_shuffles", "broadcast_value", "range_hashes", "membership", "maybe_in", "within"]

U = np.uint64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


# ---- byte classes -------------------------------------------------------------
_CODES = np.arange(256)
LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)
#: True where a byte belongs to a word ``[^\x20\x09-\x0D]+``.
SPACE_SEPARATED = ~((_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D)))
#: True where a (lower-cased) byte belongs to a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM_WORDS = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)

_BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=U)
    return _POWERS["up"], _POWERS["down"]


def string_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that aren't empty."""
    n = len(data)
    up, down = _powers(n + 1)
    run = np.cumsum(_BYTE_VALUE[data] * up[:n], dtype=U)
    total = run[ends - 1]
    total -= np.where(starts > 0, run[starts - 1], U(0))
    return mix(total * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class Words:
    """The words of some texts: byte ranges, 64-bit hashes and first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        inside = word_bytes[self.data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:n]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.hashes = range_hashes(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)  # of each text; one more entry than texts

    def text(self, a: int, b: int) -> bytes:
        """Words a..b-1, lower-cased, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; entries crossing a text's end are for the caller to skip."""
        w = self.hashes
        out = np.zeros(max(0, len(w) - k + 1), dtype=U)
        for j in range(k):
            out += w[j: j + len(out)] * mix(np.array([j + 1], dtype=U))[0]
        return mix(out + U(k))

    def sequence(self, a: int, b: int) -> np.uint64:
        """Hash of words a..b-1 as one sequence (equals ``grams(b - a)[a]``)."""
        w = self.hashes[a:b]
        total = (w * mix(np.arange(1, len(w) + 1, dtype=U))).sum(dtype=U)
        return mix(np.array([total + U(b - a)], dtype=U))[0]

    def shingle_set(self, i: int, k: int, grams: np.ndarray) -> np.ndarray:
        """Sorted distinct k-word shingles of text i; fewer words: the whole sequence; none: empty."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        if b - a >= k:
            return np.unique(grams[a: b - k + 1])
        return np.array([self.sequence(a, b)], dtype=U) if b > a else np.zeros(0, dtype=U)


# ---- memory of Python workers ------------------------------------------------------
def _trim() -> None:
    """Returns freed memory to the system where the C library can (glibc)."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def frees(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that gives back at its end what it has freed.  Spark's workers live on from task to
    task, and allocators keep freed pages, so without this each stage of a job would add its largest batch to the
    memory of all later ones."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return run


# ---- arrays of a fixed size, filled by all tasks --------------------------------
def fixed_size_sum(partials: DataFrame, dtype: type, slices: int, how: str = "sum") -> np.ndarray:
    """Adds (``sum``: unsigned 32-bit counters that stop at their maximum; ``or``: bit tables) zlib-packed partial
    arrays ``(slice int, packed binary)`` slice by slice in Spark and returns the joined array.  Its size is fixed by
    the caller, whatever the input."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                part = np.frombuffer(zlib.decompress(packed), dtype=dtype)
                if total is None:
                    total = part.copy()
                elif how == "or":
                    total |= part
                else:
                    total = np.minimum(total.astype(np.uint64) + part, np.iinfo(dtype).max).astype(dtype)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()),
                                          "packed": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = partials.groupBy("slice").applyInArrow(add, "slice int, packed binary").collect()  # `slices` rows at most
    out = None
    for r in rows:
        part = np.frombuffer(zlib.decompress(r["packed"]), dtype=dtype)
        if out is None:
            out = np.zeros(len(part) * slices, dtype=dtype)
        out[r["slice"] * len(part): (r["slice"] + 1) * len(part)] = part
    return np.zeros(0, dtype=dtype) if out is None else out


def packed_slices(total: np.ndarray, slices: int) -> pa.RecordBatch:
    """The rows ``fixed_size_sum`` adds up."""
    parts = np.split(total, slices)
    keep = [i for i, p in enumerate(parts) if p.any()]
    return pa.RecordBatch.from_pydict({"slice": pa.array(keep, pa.int32()),
                                       "packed": pa.array([zlib.compress(parts[i].tobytes(), 1) for i in keep], pa.binary())})


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: for texts, smaller than a checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that nothing refers to any more.  It does so when the driver's JVM has
    collected the plans that made them, which a driver with memory to spare puts off; a long job asks for it after
    a step whose result is stored, so that its steps don't add up on the executors' disks.  The first collection frees
    what Python held on to, the second what that had referred to."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def broadcast_value(spark: SparkSession, value):
    """A broadcast variable; within a ``lifetime`` it is destroyed when that ends."""
    shared = spark.sparkContext.broadcast(value)
    on_end(shared.destroy)
    return shared


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that a caller's further columns can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or as much of it with underscores as the columns of ``df`` don't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# ---- bit tables: a fixed-size filter for ids that some rows have -------------------
MEMBER_BITS, MEMBER_SLICES = 1 << 26, 64


def _bit(values: np.ndarray, bits: int = MEMBER_BITS) -> np.ndarray:
    return (mix(values.astype(U)) & U(bits - 1)).astype(np.int64)


def membership(ids: DataFrame, column: str, bits: int = MEMBER_BITS) -> np.ndarray:
    """A bit for each hashed value of a long column (8 MB).  Others may share a bit; no value is missing."""

    @frees
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits >> 3, dtype=np.uint8)
        for batch in batches:
            at = np.sort(_bit(batch.column(0).drop_null().to_numpy(), bits))
            if len(at):
                first = np.flatnonzero(np.concatenate([[True], at[1:] >> 3 != at[:-1] >> 3]))
                seen[at[first] >> 3] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first)
        yield packed_slices(seen, MEMBER_SLICES)

    return fixed_size_sum(only(ids, column).mapInArrow(mark, "slice int, packed binary"), np.uint8, MEMBER_SLICES, "or")


def maybe_in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = _bit(values, 8 * len(table))
    return (table[at >> 3] >> (at & 7) & 1).astype(bool)


def within(df: DataFrame, column: str, table: np.ndarray) -> DataFrame:
    """The rows whose long ``column`` may be among those the table was made from."""
    shared = broadcast_value(df.sparkSession, table)

    @frees
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index(column))
            mask = maybe_in(shared.value, at.fill_null(0).to_numpy())
            yield batch.filter(pa.array(mask & ~at.is_null().to_numpy(zero_copy_only=False)))

    return df.mapInArrow(keep, df.schema)
