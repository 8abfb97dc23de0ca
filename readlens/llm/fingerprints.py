"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Every paragraph (line) is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo a power of two.  So the order of paragraphs doesn't matter, and inserting or deleting
a paragraph adds or subtracts one vector, without the rest of the text (``add``, ``subtract``).

A vector has two parts.  ``EXACT`` lanes modulo 2**64 are uniformly random for each paragraph: two documents
with equal lanes have the same paragraphs.  ``SKETCH`` lanes modulo 2**32 add +1 or -1 for each run of three
words of the paragraph, in a lane and with a sign given by its hash: their inner products estimate those of the
documents' word-run counts, so the cosine of two fingerprints tells how alike the documents are (standard
error about 1 / sqrt(SKETCH)), and it is exactly 1 for equal fingerprints.

Fingerprints are base64 strings.  Cases: null text is an empty text, whose fingerprint is all zeros; two
fingerprints without any word run are alike (1) if equal and else not (0); rows with equal doc_id are ordered
by their text's hash; null doc_ids come last in the descending order; one row alone is its own next document;
a text of any length is one sum, computed whole in the task that reads it; further columns are ignored; an empty
table gives no rows."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlens.llm.common import SPACE_SEPARATED, Words, mix, only

EXACT, SKETCH, RUN_WORDS = 16, 256, 3
_LANES = mix(np.arange(1, EXACT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SIZE = 8 * EXACT + 4 * SKETCH


# ---- vectors --------------------------------------------------------------------
def vector(text: str | bytes) -> tuple[np.ndarray, np.ndarray]:
    """(exact lanes, sketch lanes) of a text: the sum over its lines."""
    raw = text.encode() if isinstance(text, str) else text
    exact, sketch = np.zeros(EXACT, dtype=np.uint64), np.zeros(SKETCH, dtype=np.uint32)
    if not raw:
        return exact, sketch
    lines = raw.split(b"\n")
    keys = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in lines], dtype=np.uint64)
    exact += mix(keys[:, None] + _LANES).sum(axis=0, dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
    offsets[-1] -= 1
    w = Words(np.frombuffer(raw, dtype=np.uint8), offsets, SPACE_SEPARATED, lower=False)
    grams = w.grams(RUN_WORDS)
    inside = np.ones(len(grams), dtype=bool)
    for back in range(1, RUN_WORDS):  # runs over a line's end
        at = w.first[1:-1] - back
        inside[at[(at >= 0) & (at < len(grams))]] = False
    runs = grams[inside]
    short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < RUN_WORDS))
    if len(short):
        runs = np.concatenate([runs, np.array([w.sequence(int(w.first[i]), int(w.first[i + 1])) for i in short], dtype=np.uint64)])
    sign = np.where(runs >> np.uint64(63), 1, -1)
    sketch += np.bincount((runs & np.uint64(SKETCH - 1)).astype(np.int64), weights=sign, minlength=SKETCH).astype(np.int64).astype(np.uint32)
    return exact, sketch


def to_text(v: tuple[np.ndarray, np.ndarray]) -> str:
    return base64.b64encode(v[0].astype("<u8").tobytes() + v[1].astype("<u4").tobytes()).decode()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw, "<u8", EXACT), np.frombuffer(raw, "<u4", SKETCH, 8 * EXACT)


def add(fingerprint: str, paragraph: str) -> str:
    """The fingerprint with one paragraph (line) more, wherever it stands.  A line of its own, also an empty one,
    counts; only the empty document has none."""
    a, b = from_text(fingerprint), _line(paragraph)
    return to_text((a[0] + b[0], a[1] + b[1]))


def subtract(fingerprint: str, paragraph: str) -> str:
    a, b = from_text(fingerprint), _line(paragraph)
    return to_text((a[0] - b[0], a[1] - b[1]))


def _line(paragraph: str) -> tuple[np.ndarray, np.ndarray]:
    if "\n" in paragraph:
        raise ValueError("a paragraph is one line")
    both, empty = vector(paragraph + "\n"), hashlib.blake2b(b"", digest_size=8).digest()
    rest = mix(np.array([int.from_bytes(empty, "little")], dtype=np.uint64)[:, None] + _LANES)[0]
    return both[0] - rest, both[1]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Cosine of the sketches, 0 to 1; 1 for equal fingerprints."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = (v[1].astype(np.int32).astype(np.float64) for v in (a, b))
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


# ---- neighbours in descending doc_id order ------------------------------------------
def _ranges(rows: DataFrame, parts: int) -> tuple[list, list]:
    """Cuts of the key into about ``parts`` ranges of equal row counts, and each range's first row.

    Both lists have one entry per range: a bounded number of values on the driver."""
    marks = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 100 * parts).alias("c")).first()["c"] if parts > 1 else []
    cuts = sorted(set(marks or []))
    heads = rows.withColumn("bucket", _bucket(F.col("k"), cuts)).groupBy("bucket") \
        .agg(F.max(F.struct("k", "h")).alias("head")).orderBy(F.col("bucket").desc()).collect()
    return cuts, heads


def _bucket(key: Column, cuts: list) -> Column:
    """Number of cuts at or below the key, by binary search."""
    if not cuts:
        return F.lit(0)
    table, steps = F.lit(cuts), [1 << i for i in reversed(range(len(cuts).bit_length()))]
    found = F.lit(0)
    return F.aggregate(F.lit(steps), found, lambda at, step: F.when(
        (at + step <= len(cuts)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (bucket, k, h, copied, doc_id, text) sorted within partitions so that every document that isn't a copy is
    followed, in its bucket, by the next one in descending doc_id order.  Each range of ids is a bucket; the
    first document of every range is copied to the end of the range before it, and the very first to the very end."""
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keyed = only(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h"), "doc_id", "text")
    cuts, heads = _ranges(keyed.select("k", "h"), parts)
    placed = keyed.withColumn("bucket", _bucket(F.col("k"), cuts))
    # destinations of copies: (k, h) of a head -> the range before it; ranges without rows don't occur
    to = {}
    for i, r in enumerate(heads):
        to.setdefault((r["head"]["k"], r["head"]["h"]), []).append(heads[i - 1]["bucket"] if i else heads[-1]["bucket"])
    table = spark.createDataFrame([(k, h, b) for (k, h), bs in to.items() for b in bs], "k long, h long, dest int")
    copies = placed.join(F.broadcast(table), ["k", "h"]).select(F.col("dest").alias("bucket"), "k", "h", "doc_id", "text")
    copies = copies.dropDuplicates(["bucket", "k", "h"]).withColumn("copied", F.lit(1))  # a row per range
    rows = placed.select("bucket", "k", "h", "doc_id", "text", F.lit(0).alias("copied")).unionByName(copies)
    return rows.repartition("bucket").sortWithinPartitions(
        "bucket", F.col("copied"), F.col("k").desc(), F.col("h").desc())


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the next document
    (all, if it has fewer)."""
    rows = with_next(docs, parts)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text, vector
        for batch in batches:
            out = []
            for bucket, doc, text, copied in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                v = vector(text)
                if held and held[0] == bucket:
                    _, before, mine, mv = held
                    half = len(mine) // 2
                    edited = mine[: len(mine) - half] + text[:half]
                    ev = vector(edited)
                    out.append((before, len(mine), hashlib.sha256(edited.encode()).hexdigest(), to_text(mv), to_text(ev),
                                likeness(mv, ev), likeness(mv, v)))
                held = None if copied else (bucket, doc, text, v)
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.select("bucket", F.col("doc_id").cast("long"), "text", "copied").mapInArrow(
        compute, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double")
