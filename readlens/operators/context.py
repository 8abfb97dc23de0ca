"""Dataset context: rows per calendar year (Q01-Q03).

Each operator is one scan -> project -> partial/final aggregate on the year,
parsing the text once per row.
The shuffle carries at most one row per (map task, year), so it stays tiny no
matter how large or skewed the input is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlens.functions.expr import four_digit_year, has_text, non_empty, trailing_year

YEAR_MIN = 1900
YEAR_MAX = 2026


def _in_range(year: Column, ymin: int, ymax: int) -> Column:
    """The year when inside [ymin, ymax], else NULL.  Out-of-range rows fall into the
    NULL group, which the operators drop after aggregating (see functions.expr)."""
    return F.when(year.between(ymin, ymax), year)


def interactions_per_year(
    df: DataFrame, date_col: str = "date_added", ymin: int = YEAR_MIN, ymax: int = YEAR_MAX
) -> DataFrame:
    """year, n_interactions — rows per trailing year of ``date_col`` within [ymin, ymax]."""
    return (
        df.where(non_empty(date_col))
        .select(_in_range(trailing_year(date_col), ymin, ymax).alias("year"))
        .groupBy("year")
        .agg(F.count("year").alias("n_interactions"))
        .where(F.col("n_interactions") > 0)
        .orderBy("year")
    )


def publications_per_year(
    df: DataFrame, year_col: str = "publication_year", ymin: int = YEAR_MIN, ymax: int = YEAR_MAX
) -> DataFrame:
    """year, n_published_books — rows whose ``year_col`` is exactly four digits."""
    return (
        df.select(_in_range(four_digit_year(year_col), ymin, ymax).alias("year"))
        .groupBy("year")
        .agg(F.count("year").alias("n_published_books"))
        .where(F.col("n_published_books") > 0)
        .orderBy("year")
    )


def reviews_per_year(
    df: DataFrame,
    date_col: str = "date_added",
    rating_col: str = "rating",
    text_col: str = "review_text",
    ymin: int = YEAR_MIN,
    ymax: int = YEAR_MAX,
) -> DataFrame:
    """year, n_reviews_total, n_reviews_rating_only, n_reviews_with_text.

    One pass with conditional counts (a year without such rows gets 0), instead
    of three aggregates joined back together."""
    text = has_text(text_col)
    return (
        df.where(non_empty(date_col))
        .select(
            _in_range(trailing_year(date_col), ymin, ymax).alias("year"),
            (F.col(rating_col).isNotNull() & ~text).alias("_rating_only"),
            text.alias("_with_text"),
        )
        .groupBy("year")
        .agg(
            F.count("year").alias("n_reviews_total"),
            F.count_if("_rating_only").alias("n_reviews_rating_only"),
            F.count_if("_with_text").alias("n_reviews_with_text"),
        )
        .where(F.col("n_reviews_total") > 0)
        .orderBy("year")
    )
