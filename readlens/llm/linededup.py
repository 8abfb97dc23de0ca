"""Line dedup by a suffix array over line-ID sequences.

The corpus is the sequence of its lines' ids, document after document.  Its suffixes are grouped by distributed prefix
doubling: in round k every suffix is named by its first 2**k lines, which are two names of the round before, and only
suffixes whose name occurs more than once go on, because all others are settled.  Suffixes with equal names are
neighbours in the suffix array; a group of equal names is an interval whose common prefix is at least 2**k lines long.
The names stand for the ranks of those intervals: which of two different intervals comes first has no bearing on what
repeats, so they are never put in order.

A run of lines is a repeat if it has ``MIN_WORDS`` words or more and occurs before, in an earlier document (by doc_id)
or earlier in the same one.  Each line start, and each line end, gives the shortest run with so many words; a run of
any length is named by the two names of length 2**k that cover it.  A maximal repeated run is the union of its
shortest ones, so marking their lines marks it whole.  All but the first occurrence are deleted.

Names are 64-bit hashes and rounds move only candidates; texts are read once for the names and once for the result,
joined through one small row per document that loses lines.

Cases: null text has no lines, loses none and stays null; blank lines have an id but no words; in equal doc_ids the
text's hash decides what comes first; rows equal in doc_id and text are one document and get one result; a null
doc_id comes last; a text of any length is one row of lines, of which only ids travel; further columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlens.llm.common import materialize, mix, only

MIN_WORDS = 50


def line_ids(lines: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in lines], dtype=np.uint64)


def double(left: Column, right: Column) -> Column:
    """Name of a run from the names of its two halves."""
    return F.xxhash64(left, right)


def shortest_runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """[start, length] of the shortest runs of ``least`` words or more that begin at, or end with, some line."""
    total = np.concatenate([[0], np.cumsum(words)])
    out = set()
    stop = np.searchsorted(total, total[:-1] + least, side="left")  # from each start
    out.update((i, int(j) - i) for i, j in enumerate(stop) if j < len(total))
    start = np.searchsorted(total, total[1:] - least, side="right") - 1  # to each end
    out.update((int(i), j + 1 - int(i)) for j, i in enumerate(start) if total[j + 1] >= least)
    return sorted(out)


def suffix_names(docs: DataFrame) -> DataFrame:
    """(doc, at, name): every suffix by its first line (round 0)."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, name = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                ids = line_ids(text.split("\n")).astype(np.int64)
                doc += [key] * len(ids)
                at += range(len(ids))
                name.append(ids)
            yield pa.RecordBatch.from_pydict({"doc": pa.array(doc, pa.int64()), "at": pa.array(at, pa.int32()),
                                              "name": pa.array(np.concatenate(name) if name else [], pa.int64())})

    return docs.select("doc", "text").mapInArrow(lines, "doc long, at int, name long").distinct()


def repeated(names: DataFrame) -> DataFrame:
    """The suffixes whose name occurs more than once."""
    often = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    return names.join(often, "name", "left_semi").select("doc", "at", "name")


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc, start, length) of the shortest repeated runs that occurred before.  ``docs``: doc (a number for each row),
    place (a sortable struct: earlier documents first), text."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, length = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, n in shortest_runs([len(x.split()) for x in text.split("\n")], least) if text is not None else ():
                    doc.append(key)
                    start.append(a)
                    length.append(n)
            yield pa.RecordBatch.from_pydict({"doc": pa.array(doc, pa.int64()), "at": pa.array(start, pa.int32()), "length": pa.array(length, pa.int32())})

    level = materialize(repeated(suffix_names(docs)))  # k = 0: lines that occur more than once
    todo = docs.select("doc", "text").mapInArrow(runs, "doc long, at int, length int")
    # only runs that begin with a repeated line can be repeated; later levels filter further
    todo = materialize(todo.join(level.select("doc", "at"), ["doc", "at"], "left_semi").distinct())
    named, k = None, 0
    while True:
        size = 1 << k
        here = todo.where((F.col("length") >= size) & (F.col("length") < 2 * size)) \
            .join(level.withColumnRenamed("name", "head"), ["doc", "at"]) \
            .withColumn("back", F.col("at") + F.col("length") - size) \
            .join(level.select("doc", F.col("at").alias("back"), F.col("name").alias("tail")), ["doc", "back"]) \
            .select("doc", "at", "length", F.xxhash64("head", "tail", "length").alias("run"))
        named = here if named is None else named.unionByName(here)
        todo = todo.where(F.col("length") >= 2 * size)
        if todo.isEmpty():
            break
        half = level.select("doc", (F.col("at") - size).alias("at"), F.col("name").alias("right"))
        longer = level.join(half, ["doc", "at"]).select("doc", "at", double(F.col("name"), F.col("right")).alias("name"))
        level = materialize(repeated(longer))
        todo = materialize(todo.join(level.select("doc", "at"), ["doc", "at"], "left_semi"))
        k += 1
    placed = named.join(docs.select("doc", "place").dropDuplicates(["doc"]), "doc").withColumn("occurs", F.struct("place", "at"))
    first = placed.groupBy("run").agg(F.min("occurs").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("run", "first")
    return placed.join(first, "run").where(F.col("occurs") > F.col("first")).select("doc", F.col("at").alias("start"), "length")


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with a key and their place.  Rows equal in doc_id and text are one document."""
    return only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.xxhash64("doc_id", "text").alias("doc"),
        F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h")).alias("place"))


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, text without the lines of later copies, n_lines, n_deleted."""
    rows = _numbered(docs)
    cut = repeated_runs(rows, least).groupBy("doc").agg(F.collect_set(F.struct("start", "length")).alias("runs"))  # of one document

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_deleted = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                gone = np.zeros(len(lines) + 1, dtype=np.int64)
                for r in found or ():
                    gone[r["start"]] += 1
                    gone[r["start"] + r["length"]] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                texts.append("\n".join(x for x, k in zip(lines, keep, strict=True) if k) if text is not None else None)
                n_lines.append(len(lines))
                n_deleted.append(int(len(lines) - keep.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_deleted, pa.int64())],
                                             names=["doc_id", "text", "n_lines", "n_deleted"])

    return rows.join(cut, "doc", "left").select("doc_id", "text", "runs") \
        .mapInArrow(delete, "doc_id long, text string, n_lines long, n_deleted long")
