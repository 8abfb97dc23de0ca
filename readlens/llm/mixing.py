"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times for
sure and once more with probability r - floor(r).  Which documents get the extra
copy is drawn by balanced (cube) sampling: the vector of inclusion probabilities
walks through the null space of the balancing equations (number of documents, number
of words) until coordinates reach 0 or 1, so both totals stay where the target puts
them.  The walk needs only as many open units as there are equations plus one, so
documents of a source are dealt into blocks; each block walks alone, leaves at most
two open units, and those meet in the next round's fewer blocks, until one block per
source is left.  There a few documents wait for the end: the landing phase settles them and what the walk
left open, over all their combinations, with the least change of the word total.

Sources are ranked by code point, null last, in one small aggregate (one row per
source).  Draws depend on row contents alone, so reruns agree.

Cases: null text has size 0 and takes 0; a null source is a source of its own; equal
rows are interchangeable; a text of any length counts with its whole size and is never carried through the rounds; an
empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlens.llm.common import fresh, materialize, only

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: No source is asked for more than this many times its size, nor a document taken more often.
MAX_REPEATS = 3.0
#: Documents that walk together in one block.
BLOCK_DOCS = 4096
#: Documents of a source, of all lengths, that wait for the landing phase, where two more join them.
LANDING_DOCS = 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS,
                   share: float = 1.0) -> DataFrame:
    """(source, source_size, n_docs, target): targets share ``share`` of all words by weight, none above
    ``max_repeats`` times its source; what a full source can't take goes to the others by weight.

    The level L of that filling solves sum(min(cap, L * weight)) = total: with the sources in the order in
    which they fill up (cap / weight), running sums give it in one pass over the one-row-per-source table."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share))) \
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        .withColumn("open", F.sum("weight").over(onward)) \
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # the first source that its level doesn't fill: all before it are full, it and the rest get level * weight
    level = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(every)
    return per.withColumn("at", level).select(
        "source", "source_size", "n_docs",
        F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def _walk(p: list[float], x: list[float], draws: list[float], order: list[int]) -> list[int]:
    """Flight phase in place over the units ``order`` of the probabilities ``p`` with balancing rows (1, x);
    returns the units still open, two at most."""
    eps = 1e-9
    open_units, at, k = [], 0, 0
    while True:
        while len(open_units) < 3 and at < len(order):
            if eps < p[order[at]] < 1 - eps:
                open_units.append(order[at])
            at += 1
        if len(open_units) < 3:
            return open_units
        a, b, c = open_units
        u = [x[b] - x[c], x[c] - x[a], x[a] - x[b]]  # orthogonal to (1, 1, 1) and to the sizes
        if u == [0, 0, 0]:
            u = [1.0, -1.0, 0.0]
        up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(open_units, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(open_units, u, strict=True) if d)
        step = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        for i, d in zip(open_units, u, strict=True):
            p[i] += step * d
            p[i] = 0.0 if p[i] <= eps else 1.0 if p[i] >= 1 - eps else p[i]
        open_units = [i for i in open_units if 0 < p[i] < 1]


def _land(p: list[float], x: list[float], units: list[int]) -> None:
    """Landing phase: settles the last open units in the way that moves the word total least, then the
    document total least."""
    if not units:
        return
    bits = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    off = bits - np.array([p[i] for i in units])
    words, count = np.abs(off @ np.array([x[i] for i in units])), np.abs(off.sum(axis=1))
    for i, bit in zip(units, bits[np.lexsort((count, words.round(6)))[0]].tolist(), strict=True):
        p[i] = float(bit)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS,
                share: float = 1.0, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken): how often each document enters the mix and the
    words it brings.  ``docs`` has doc_id, text and source."""
    sized = only(docs, "doc_id", "text", "source").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        _row_key(seed).alias("h"))
    sized = materialize(sized)  # a few numbers per document; every round and the source totals start here
    targets = source_targets(sized, weights, max_repeats, share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "doc_id", F.col("d.source").alias("source"), "size", "h", "source_size", "target",
        F.floor(rate + 1e-12).cast("int").alias("sure"),
        F.greatest(rate - F.floor(rate + 1e-12), F.lit(0.0)).alias("p"),
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK_DOCS)).cast("long").alias("blocks"))
    done = None
    for turn in range(64):  # blocks shrink more than a thousandfold each time
        pending = materialize(_walk_blocks(rows, seed + turn))
        last = (pending.agg(F.max("blocks")).first()[0] or 1) <= 1
        closed = pending if last else pending.where(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        rows = pending.where("open").drop("open").withColumn(
            "blocks", F.greatest(F.lit(1), F.ceil(F.col("blocks") * 2 / BLOCK_DOCS)).cast("long"))
    copies = (F.col("sure") + F.round("p")).cast("long")
    return done.select("doc_id", "size", "source_size", "target", copies.alias("copies"),
                       (F.col("size") * copies).alias("taken"), F.col("h").alias("row_key"))


def _row_key(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"), F.lit(seed))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS,
              share: float = 1.0, seed: int = 7) -> DataFrame:
    """``docs`` as the mix takes them, same columns: every row as often as it is taken, 0 to ``max_repeats`` times.
    Rows equal in doc_id, source and text share out the copies taken of them."""
    key, total, n, rank = (fresh(docs, x) for x in ("mix_key", "mix_total", "mix_rows", "mix_rank"))
    taken = mix_sources(docs, weights, max_repeats, share, seed).groupBy(F.col("row_key").alias(key)) \
        .agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(n))
    rows = docs.withColumn(key, _row_key(seed)).join(taken, key) \
        .withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    copies = F.floor(F.col(total) / F.col(n)) + F.when(F.col(rank) <= F.col(total) % F.col(n), 1).otherwise(0)
    return rows.withColumn(rank, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])


def _walk_blocks(rows: DataFrame, seed: int) -> DataFrame:
    """One round: every block walks; ``p`` is what it came to, ``open`` marks what the next round goes on with."""
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.col("blocks")))
    fields = keyed.schema.fieldNames()

    def walk(table: pa.Table) -> pa.Table:
        pdf: pd.DataFrame = table.select(["size", "p", "doc_id", "h", "blocks"]).to_pandas()
        # long documents are settled first, so that what lands last is short; the order depends on the rows alone
        order = pdf.sort_values(["size", "h", "doc_id"], ascending=False, kind="stable").index.to_numpy()
        p = pdf["p"].to_numpy()[order].tolist()
        x = pdf["size"].to_numpy()[order].astype(float).tolist()
        draws = (pd.util.hash_pandas_object(pdf[["h", "doc_id"]], index=False).to_numpy()[order] / 2**64).tolist()
        units = [i for i, v in enumerate(p) if 0 < v < 1]
        last = bool(pdf["blocks"].iloc[0] <= 1)
        kept = units[:: max(1, -(-len(units) // LANDING_DOCS))] if last else []  # of all lengths
        left = _walk(p, x, draws, sorted(set(units) - set(kept)))
        if last:
            _land(p, x, left + kept)
        out = pdf["p"].to_numpy().copy()
        out[order] = p
        is_open = (out > 0) & (out < 1)
        table = table.set_column(table.schema.get_field_index("p"), "p", pa.array(out, pa.float64()))
        return table.append_column("open", pa.array(is_open)).drop_columns(["block"])

    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in fields if n != "block") + ", open boolean"
    return keyed.groupBy("source", "block").applyInArrow(walk, schema)
