"""Exact discrete percentiles with bounded work per task, at every input size.

The definition is ``percentile_disc``: the smallest value whose running weight reaches ``ceil(n * p)``.  Sorting a
group, or keeping a map of all its values, would put the group in one task.  Here the value range of each group
is cut into ``BUCKETS`` parts instead, whose weights are summed in parallel (partial sums before the shuffle); a
running total over that bounded table names the bucket that holds the rank, and the next level cuts this
bucket's own range, from its least to its greatest value, again.  After ``LEVELS`` levels only the few values of
one bucket are left to be ranked.  A value's bucket is a monotone function of the value, so rounding can
only move a cut, never the order, and the result is exact.

``sketch_percentiles`` trades exactness for one pass: a rank-error sketch whose parts are merged in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 4096
LEVELS = 2


def _rank(n: Column, p: float) -> Column:
    return F.greatest(F.lit(1.0), F.ceil(n.cast("double") * float(p)))


def exact_percentiles(
    dist: DataFrame, groups: Sequence[str], value: str, weight: str, probs: Mapping[str, float]
) -> DataFrame:
    """(*groups, one column per name in ``probs``): ``dist`` has one row per (group, value) with its weight.

    Groups without a value have no row.  Per level, ``dist`` meets a table of one row per group and percentile;
    it is broadcast, so use this for groups known to be few (classes, ratings, columns)."""
    dist = dist.where(F.col(value).isNotNull()).select(
        *groups, F.col(value).cast("double").alias("_v"), F.col(weight).alias("_w")
    )
    # state: for each group and percentile, the range that holds it and the weight below the range
    state = dist.groupBy(*groups).agg(
        F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    asked = F.array(*[F.struct(F.lit(k).alias("_p"), _rank(F.col("_n"), p).alias("_rank")) for k, p in probs.items()])
    state = state.select(*groups, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.explode(asked).alias("_a")) \
        .select(*groups, "_a._p", "_a._rank", "_lo", "_hi", "_below")
    keys = [*groups, "_p"]
    for _ in range(LEVELS):
        inside = _inside(dist, state, groups)
        part = F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * BUCKETS
        hist = (
            inside.withColumn("_b", F.least(F.lit(BUCKETS - 1), F.coalesce(F.floor(part), F.lit(0))))
            .groupBy(*keys, "_rank", "_below", "_b")
            .agg(F.sum("_w").alias("_w"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        )
        state = (
            _reached(hist, keys, "_b")
            .select(*keys, "_rank", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"),
                    (F.col("_cum") - F.col("_w")).alias("_below"))
        )
    left = _inside(dist, state, groups).groupBy(*keys, "_rank", "_below", "_v").agg(F.sum("_w").alias("_w"))
    found = _reached(left, keys, "_v")
    return found.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_p") == k, F.col("_v"))).alias(k) for k in probs]
    )


def _inside(dist: DataFrame, state: DataFrame, groups: Sequence[str]) -> DataFrame:
    return dist.join(F.broadcast(state), on=list(groups)).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _reached(hist: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key at which the running weight reaches the rank."""
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_cum", F.col("_below") + F.sum("_w").over(running))
    return cum.where((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("_w") < F.col("_rank")))


#: Summaries merged in one task, as a power of two, and rounds of merging: 2**(7 * 3) tasks and more.
FAN_IN_BITS, ROUNDS = 7, 3


def sketch_percentiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float], relative_error: float
) -> DataFrame:
    """(*groups, one column per name in ``probs``): values whose rank is off by at most ``relative_error`` of the group's rows.

    Each task keeps a sketch of its own rows and hands on ``8 / relative_error`` points of it, evenly spaced by rank
    and each standing for the same number of rows.  Points of up to 128 tasks are merged by one task, in order of
    value, and thinned to as many evenly spaced points again; three rounds of that cover two million tasks.  So
    no task sees more than 128 summaries, whatever the input, where a plain sketch aggregate merges all of them
    in one.  The error is at most 3/8 of the bound in the tasks and 1/8 for each round of merging.  Equal input partitions give equal
    results: nothing is random.  Groups without a value have no row."""
    size = math.ceil(8 / relative_error)
    ranks = F.expr("cast(split('" + ",".join(repr((i + 0.5) / size) for i in range(size)) + "', ',') as array<double>)")
    points = (
        df.where(F.col(value).isNotNull())
        .select(*groups, F.col(value).cast("double").alias("_v"), F.spark_partition_id().alias("_slot"))
        .groupBy(*groups, "_slot")
        .agg(F.percentile_approx("_v", ranks, math.ceil(4 / relative_error)).alias("_points"), F.count("_v").alias("_rows"))
        # weights count rows times ``size``: whole numbers throughout
        .select(*groups, "_slot", F.explode("_points").alias("_v"), F.col("_rows").alias("_w"))
    )
    for k in range(ROUNDS):
        slot = F.lit(0) if k == ROUNDS - 1 else F.shiftright("_slot", FAN_IN_BITS)
        points = _thinned(points.withColumn("_slot", slot), [*groups, "_slot"], size)
    running = Window.partitionBy(*groups, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups, "_slot")
    cum = points.withColumn("_cum", F.sum("_w").over(running)).withColumn("_n", F.sum("_w").over(whole))
    found = [
        F.min(F.when(F.col("_cum") >= F.greatest(F.lit(1.0), F.ceil(F.col("_n").cast("double") * float(p))), F.col("_v"))).alias(k)
        for k, p in probs.items()
    ]
    return cum.groupBy(*groups, "_slot").agg(*found).drop("_slot")


def _thinned(points: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """The points of each key, in order of value, thinned to ``size`` at most: a point stays where the running weight passes
    a multiple of the total's ``size``-th part, and stands for the parts it passes."""
    running = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    wide = lambda c: c.cast("decimal(38,0)")
    cum = points.withColumn("_cum", F.sum("_w").over(running)).withColumn("_n", F.sum("_w").over(Window.partitionBy(*keys)))
    passed = cum.withColumn("_hi", wide(F.col("_cum")) * size).withColumn("_lo", wide(F.col("_cum") - F.col("_w")) * size) \
        .withColumn("_parts", F.expr("(_hi div _n) - (_lo div _n)"))
    return passed.where(F.col("_parts") > 0).select(*keys, "_v", F.expr(f"_parts * (_n div {size})").alias("_w"))
