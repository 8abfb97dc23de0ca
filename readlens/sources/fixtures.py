"""Domain tables derived from the driver's TPC-H-like tables.

The library's operators expect a book-catalogue data model (interactions,
reviews, books, genre votes, sentiment scores).  These functions derive such
tables from ``/root/testdata/sf*/`` with plain column arithmetic, so the same
definitions can be written in DuckDB SQL for the oracle (``readlens.oracle``).

Everything here is a lazy DataFrame over the given tables: the work grows
with the input, nothing is generated on the driver.  A stored table would hold
its date text; the derived ones build it once per row (``settled``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlens.functions.expr import settled

# ---------------------------------------------------------------------------
# Fixed values of the fixture mapping (kept equal to the DuckDB oracle)
# ---------------------------------------------------------------------------
# Text date layout of the source data, with a literal UTC offset.
DATE_TEXT_FORMAT = "Www Mmm dd HH:mm:ss +0000 yyyy"
# Genre slots: one vote column per customer market segment, in this order.
GENRE_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
# Hybrid-genre parameters that give non-trivial sets on the driver data.
HYBRID_KEY_A = "BUILDING"
HYBRID_KEY_B = "MACHINERY"
HYBRID_THRESH = 6
HYBRID_RATIO = 0.6
# Attention-class parameters that give non-empty classes on the driver data.
MIN_TOTAL = 20
QUANTILE = 0.7


def _read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)


def _date_text(ts: str) -> Column:
    """``Www Mmm dd HH:mm:ss +0000 yyyy`` from a timestamp_ntz, independent of the
    session time zone: calendar parts come from the date, clock parts from the
    wall-clock fields, and the offset is a literal."""
    day = F.to_date(F.col(ts))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(
        F.date_format(day, "EEE MMM dd"), F.lit(" "),
        two(F.hour(ts)), F.lit(":"), two(F.minute(ts)), F.lit(":"), two(F.second(ts)),
        F.lit(" +0000 "), F.date_format(day, "yyyy"),
    )


def interactions(spark: SparkSession, sf_dir: str, clean: bool = False) -> DataFrame:
    """(book_id, user_id, rating, date_added): one row per line item.

    ``clean=False`` adds the junk the real dump has: NULL dates (orderkey % 97),
    empty dates (% 89) and a junk year ``0101`` (% 499), tested in that order."""
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    od = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    d = _date_text("l_shipdate")
    if not clean:
        k = F.col("l_orderkey")
        d = (
            F.when(k % 97 == 0, F.lit(None).cast("string"))
            .when(k % 89 == 0, F.lit(""))
            .when(k % 499 == 0, F.regexp_replace(d, r"\d{4}$", "0101"))
            .otherwise(d)
        )
    rows = li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("l_partkey").cast("string").alias("book_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        (F.col("l_quantity").cast("long") % 6).alias("rating"),
        d.alias("date_added"),
    )
    return settled(rows, "date_added")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, title, publication_year) with NULL, '' and 'n/a' years mixed in."""
    k = F.col("p_partkey")
    year = (
        F.when(k % 19 == 0, F.lit(None).cast("string"))
        .when(k % 17 == 0, F.lit(""))
        .when(k % 23 == 0, F.lit("n/a"))
        .otherwise((F.lit(1955) + F.col("p_size")).cast("string"))
    )
    return _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select(
        k.cast("string").alias("book_id"),
        F.col("p_name").alias("title"),
        year.alias("publication_year"),
    )


def genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, genres struct<segment: bigint ...>): votes = lines per (part, segment),
    NULL where a segment never bought the part."""
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    od = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    cu = _read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    j = li.join(od, li.l_orderkey == od.o_orderkey).join(cu, od.o_custkey == cu.c_custkey)
    votes = [
        F.nullif(F.count_if(F.col("c_mktsegment") == seg), F.lit(0)).alias(seg)
        for seg in GENRE_SEGMENTS
    ]
    return (
        j.groupBy("l_partkey")
        .agg(F.struct(*votes).alias("genres"))
        .select(F.col("l_partkey").cast("string").alias("book_id"), "genres")
    )


#: Vote keys of the map form: a comma and a space inside, as in the source catalogue.
MAP_KEYS = {"AUTOMOBILE": "history, historical fiction, biography", "BUILDING": "fantasy, paranormal", "FURNITURE": "young-adult",
            "HOUSEHOLD": "mystery, thriller, crime", "MACHINERY": "romance"}
#: Votes of books whose number divides by this are beyond the int range.
HUGE_EVERY, HUGE_FACTOR = 7, 1 << 33


def genres_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``genres`` with the source catalogue's vote keys, and votes above the int range for some books."""
    g = genres(spark, sf_dir)
    factor = F.when(F.col("book_id").cast("long") % HUGE_EVERY == 0, F.lit(HUGE_FACTOR)).otherwise(F.lit(1))
    votes = [(F.col("genres").getField(seg) * factor).alias(MAP_KEYS[seg]) for seg in GENRE_SEGMENTS]
    return g.select("book_id", F.struct(*votes).alias("genres"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, date_added, rating, review_text) one per line item."""
    k = F.col("l_orderkey")
    text = (
        F.when(k % 5 == 0, F.lit(""))
        .when(k % 5 == 1, F.lit("   "))
        .when(k % 5 == 2, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("order "), k.cast("string")))
    )
    rating = F.when(F.col("l_suppkey") % 11 != 0, F.col("l_quantity").cast("long") % 6)
    rows = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").select(
        F.col("l_partkey").cast("string").alias("book_id"),
        _date_text("l_shipdate").alias("date_added"),
        rating.alias("rating"),
        text.alias("review_text"),
    )
    return settled(rows, "date_added")


def sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, rating 0..6, sentiment_score in -1..1): ratings 0 and 6 must be dropped
    by the cleaning step, and about a tenth of the scores are exactly 0."""
    return _read(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_discount").select(
        F.col("l_partkey").cast("string").alias("book_id"),
        (F.col("l_quantity").cast("long") % 7).alias("rating"),
        F.round((F.col("l_discount") - 0.05) * 20, 2).alias("sentiment_score"),
    )


DERIVATIONS = {
    "interactions": lambda s, d: interactions(s, d),
    "interactions_clean": lambda s, d: interactions(s, d, clean=True),
    "books": books,
    "genres": genres,
    "genres_named": genres_named,
    "reviews": reviews,
    "sentiment_scores": sentiment_scores,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The domain table ``name``, derived lazily from the driver tables: nothing is written, and a query's own
    column pruning and shared exchanges reach down to the scans."""
    return DERIVATIONS[name](spark, sf_dir)
