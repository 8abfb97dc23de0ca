"""Series shaping for result tables (P01-P08): top genres by mean share, aligned
year series, cropping, unit scaling, error bars, support floors.

These run on already-aggregated results (one row per year and genre/class),
so they are small — but they stay lazy DataFrame operations: no collect, no job
while a query is built, and the year axis is bounded by the year range given as
a parameter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlens.functions.expr import settled


def fold_series(df: DataFrame, year_col: str, value_col: str, genre_col: str = "genre") -> DataFrame:
    """genre, points: one row per genre with its (year, value) points in order of year.

    A genre has at most one point per year, so a row is small.  Year ranges are cut out of the folded points, not
    pushed below the fold: operators over the same table then share one fold, and with it one pass over what
    the table is computed from."""
    point = F.struct(F.col(year_col).alias("year"), F.col(value_col).alias("value"))
    return df.groupBy(genre_col).agg(F.array_sort(F.collect_list(point)).alias("points"))


def _between(ymin: int, ymax: int) -> Column:
    return F.filter("points", lambda p: p["year"].between(ymin, ymax))


def top_k_by_mean_share(
    df: DataFrame,
    year_col: str,
    share_col: str,
    ymin: int,
    ymax: int,
    k: int = 5,
    genre_col: str = "genre",
) -> DataFrame:
    """genre, mean_share: the k genres with the highest mean share over the years present
    in [ymin, ymax]; ties broken by genre name descending."""
    shares = F.filter(F.transform(_between(ymin, ymax), lambda p: p["value"]), lambda v: v.isNotNull())
    total = F.aggregate(shares, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return (
        fold_series(df, year_col, share_col, genre_col)
        .select(genre_col, F.try_divide(total, F.size(shares)).alias("mean_share"))
        .where(F.col("mean_share").isNotNull())
        .orderBy(F.col("mean_share").desc(), F.col(genre_col).desc())
        .limit(k)
    )


def with_highlight(top: DataFrame, highlight: str, genre_col: str = "genre") -> DataFrame:
    """genre: the top genres plus one named genre that must always be shown."""
    extra = top.sparkSession.range(1).select(F.lit(highlight).alias(genre_col))
    return top.select(genre_col).unionByName(extra).distinct()


def align_series_null(
    df: DataFrame,
    year_col: str,
    value_col: str,
    genres: DataFrame,
    ymin: int,
    ymax: int,
    genre_col: str = "genre",
) -> DataFrame:
    """genre, year, value: one row per kept genre and every year that any kept genre has
    in [ymin, ymax]; a missing point is NULL.

    The points of a genre come as one folded row, so every branch shares one pass over ``df``.  The year axis has
    at most ymax - ymin + 1 entries (a bound set by the parameters): it enters as one array-valued scalar
    subquery, exploded per kept genre, so no cross join is planned."""
    keep = genres.select(genre_col).distinct()
    cropped = fold_series(df, year_col, value_col, genre_col).withColumn("points", _between(ymin, ymax))
    kept = keep.join(cropped, on=genre_col, how="left")
    years = kept.select(F.explode(F.transform("points", lambda p: p["year"])).alias("year"))
    axis = years.agg(F.array_sort(F.collect_set("year"))).scalar()
    grid = kept.select(genre_col, F.explode(axis).alias(year_col), F.col("points").alias("_points"))
    here = F.filter(F.coalesce("_points", F.array().cast(cropped.schema["points"].dataType)), lambda p: p["year"] == F.col(year_col))
    return grid.select(genre_col, year_col, F.explode_outer(F.transform(here, lambda p: p["value"])).alias(value_col)) \
        .orderBy(genre_col, year_col)


def align_series_zero(
    df: DataFrame, year_col: str, value_cols: Sequence[str], ymin: int, ymax: int
) -> DataFrame:
    """year, *value_cols as double, missing or unparseable values as 0.0, years cropped.

    The years are cut out of the finished rows: pushed below the aggregate that made them, the range would parse every
    date of the log once more."""
    y = F.col(year_col).try_cast("int")
    return (
        settled(df.select(year_col, *value_cols))
        .where(y.between(ymin, ymax))
        .select(
            y.alias(year_col),
            *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in value_cols],
        )
        .orderBy(year_col)
    )


def crop_years(
    df: DataFrame, year_col: str, ymin: int, ymax: int, require_rows: bool = True
) -> DataFrame:
    """Rows with year in [ymin, ymax], sorted by year.  With ``require_rows`` an
    empty result raises when it is computed.

    The check is part of the plan: a one-row aggregate that is filtered out unless there are no rows.  It takes the
    maximum over all columns, so it reads the same exchange as the rows themselves.  The range is applied to the
    finished rows, not to what they were computed from."""
    out = settled(df).where(F.col(year_col).between(ymin, ymax))
    if require_rows:
        message = F.lit(f"No rows with {year_col} in [{ymin}, {ymax}]")
        none = out.agg(F.max(F.struct(*[F.col(f"`{c}`") for c in out.columns])).alias("any")).where(F.col("any").isNull())
        out = out.unionByName(none.select(*[F.raise_error(message).cast(f.dataType).alias(f.name) for f in out.schema.fields]))
    return out.orderBy(year_col)


def scale_units(df: DataFrame, cols: Mapping[str, float], suffix: str) -> DataFrame:
    """Adds ``<col>_<suffix>`` = col / factor for each (col, factor)."""
    return df.select(
        "*", *[(F.col(c) / F.lit(float(f))).alias(f"{c}_{suffix}") for c, f in cols.items()]
    )


def error_bars(
    df: DataFrame,
    mean_col: str = "avg_sentiment",
    low_col: str = "p05_sentiment",
    high_col: str = "p95_sentiment",
) -> DataFrame:
    """Adds err_low = mean - low and err_high = high - mean."""
    return df.withColumn("err_low", F.col(mean_col) - F.col(low_col)).withColumn(
        "err_high", F.col(high_col) - F.col(mean_col)
    )


def min_support(
    df: DataFrame,
    n_col: str,
    min_n: int,
    keep: Mapping[str, Sequence] | None = None,
    ranges: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Rows with n >= min_n, values listed in ``keep`` and inside ``ranges``."""
    out = df.where(F.col(n_col) >= min_n)
    for c, values in (keep or {}).items():
        out = out.where(F.col(c).isin(list(values)))
    for c, (lo, hi) in (ranges or {}).items():
        out = out.where(F.col(c).between(lo, hi))
    return out
