"""The registered queries: each callable takes (spark, sf_dir) and returns a
DataFrame computed over the whole driver tables in ``sf_dir`` (via the fixture
mapping in ``readlens.sources.fixtures``) with the fixture parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readlens.functions.expr import settled
from readlens.operators import attention as at
from readlens.operators import context as cx
from readlens.operators import genres as gn
from readlens.operators import sentiment as se
from readlens.operators import series as sr
from readlens.plans.materialize import lifetime, materialize, scratch_path
from readlens.sources import fixtures as fx
from readlens.sources.readers import DAMAGED, dataset_report, preview, read_result_csv, read_table, tagged_path, write_result

# Parameters of the registered queries (see FIXTURES.md)
WINDOW_START, WINDOW_END, WINDOW_K = 1996, 1998, 50
TOP_K = 10
SKETCH_ERROR = 0.001
DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# ------------------------------------------------------------------ helpers
def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return at.monthly_counts(fx.table(spark, sf, "interactions_clean"))


def _feats(spark: SparkSession, sf: str) -> DataFrame:
    return at.attention_features(_monthly(spark, sf), fx.MIN_TOTAL)


def _kept_feats(spark: SparkSession, sf: str) -> DataFrame:
    """One row per book, read several times: cut here, as the jobs do, so that percentiles and classes read a stored
    table instead of repeating the interaction pass in every branch of the plan."""
    return materialize(_feats(spark, sf))


def _labeled(spark: SparkSession, sf: str) -> DataFrame:
    feats = _kept_feats(spark, sf)
    return materialize(at.classify_attention(feats, _thresholds(feats)))


def _thresholds(feats: DataFrame) -> DataFrame:
    return at.quantile_thresholds(feats, fx.QUANTILE)


def _sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return se.clean_sentiment(fx.table(spark, sf, "sentiment_scores"))


def _hybrid_args() -> dict:
    return dict(key_a=fx.HYBRID_KEY_A, key_b=fx.HYBRID_KEY_B, thresh=fx.HYBRID_THRESH)


def _membership(spark: SparkSession, sf: str) -> DataFrame:
    return gn.all_membership(fx.table(spark, sf, "genres"), ratio=fx.HYBRID_RATIO, **_hybrid_args())


def _membership_union(spark: SparkSession, sf: str) -> DataFrame:
    g = fx.table(spark, sf, "genres")
    book_genre = gn.genre_membership(gn.genre_votes(g), fx.HYBRID_THRESH)
    hybrid = gn.hybrid_membership(g, ratio=fx.HYBRID_RATIO, **_hybrid_args())
    return gn.membership_with_hybrid(book_genre, hybrid)


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    return gn.hybrid_flags(fx.table(spark, sf, "genres"), **_hybrid_args())


def _hybrid_ids(spark: SparkSession, sf: str) -> DataFrame:
    return gn.hybrid_ids(fx.table(spark, sf, "genres"), ratio=fx.HYBRID_RATIO, **_hybrid_args())


def _supply(spark: SparkSession, sf: str) -> DataFrame:
    return gn.supply_share(fx.table(spark, sf, "books"), _membership(spark, sf))


def _demand(spark: SparkSession, sf: str) -> DataFrame:
    return gn.demand_share(fx.table(spark, sf, "interactions"), _membership(spark, sf))


def _adoption(spark: SparkSession, sf: str) -> DataFrame:
    return gn.hybrid_adoption_trend(fx.table(spark, sf, "interactions"), _flags(spark, sf))


def _decay(spark: SparkSession, sf: str) -> DataFrame:
    return at.rating_decay(fx.table(spark, sf, "reviews"), _labeled(spark, sf))


def _top3_demand(spark: SparkSession, sf: str) -> DataFrame:
    return sr.top_k_by_mean_share(_demand(spark, sf), "added_year", "share_interactions_genre", 1996, 2000, k=3)


def _align_null(spark: SparkSession, sf: str) -> DataFrame:
    supply = _supply(spark, sf)
    top = sr.top_k_by_mean_share(supply, "pub_year", "share_books_genre", 1960, 2019, k=3)
    keep = sr.with_highlight(top, gn.HYBRID_LABEL)
    return sr.align_series_null(supply, "pub_year", "share_books_genre", keep, 1960, 2005)


def _align_months(spark: SparkSession, sf: str) -> DataFrame:
    decay = sr.min_support(_decay(spark, sf), "n_ratings", 5)
    classes = spark.range(1).select(F.explode(F.array(F.lit(at.CLASS_VIRAL), F.lit(at.CLASS_TRADITIONAL))).alias("class"))
    return sr.align_series_null(decay, "months_since_peak", "avg_rating", classes, -6, 24, genre_col="class")


def _files(spark: SparkSession) -> int:
    return max(4, spark.sparkContext.defaultParallelism)


def _csv_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Result files as different runs leave them: the even years as the sink writes them; the odd years with the columns in
    another order, one more column, counts written as decimals and some lines that are no result."""
    path = scratch_path(spark, "result-csv")
    with lifetime():
        result = materialize(cx.interactions_per_year(fx.table(spark, sf, "interactions")))
        write_result(result.where("year % 2 = 0"), path, order_by=["year"], parts=2)
        odd = result.where("year % 2 = 1").select(
            F.concat("n_interactions", F.lit(".0")).alias("n_interactions"), F.lit("a, \"b\"").alias("note"), F.col("year").cast("string").alias("year"))
        junk = odd.select(F.lit("many").alias("n_interactions"), "note", "year").unionByName(odd.withColumn("year", F.lit("n/a")))
        odd.unionByName(junk).repartition(2).write.mode("append").option("header", True).csv(path)
    return read_result_csv(spark, path, {"year": "int", "n_interactions": "long"})


BOOK_SCHEMA = "book_id string, title string, publication_year string"
#: One book in so many has a second line that is cut off.
DAMAGED_EVERY = 50


def _json_books(spark: SparkSession, sf: str) -> str:
    """The books as a JSON dataset of several files, with cut-off lines."""
    books = fx.table(spark, sf, "books")
    line = F.to_json(F.struct(*books.columns))
    cut = F.when(F.col("book_id").cast("long") % DAMAGED_EVERY == 0, F.expr("substring(line, 1, length(line) - 2)"))
    path = scratch_path(spark, "books-json")
    lines = books.select("book_id", line.alias("line")).select(F.explode(F.array(F.col("line"), cut)).alias("value")).where("value is not null")
    lines.repartition(_files(spark)).write.text(path)
    return path


def _json_scan(spark: SparkSession, sf: str) -> DataFrame:
    return cx.publications_per_year(read_table(spark, _json_books(spark, sf), "json", ["publication_year"], schema=BOOK_SCHEMA))


def _json_damaged(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, _json_books(spark, sf), "json", schema=BOOK_SCHEMA, on_damaged="keep")
    return rows.agg(
        F.count(F.lit(1)).alias("n_lines"), F.count(DAMAGED).alias("n_damaged"), F.count("book_id").alias("n_books"),
        F.sum(F.length(DAMAGED)).alias("damaged_chars"),
    )


def _csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly counts written over an older output as ordered part files, and read back: each row, and whether its file
    begins after the one before it ends."""
    path = tagged_path(scratch_path(spark, "csv-sink"), "monthly_min{min_total}_q{q}", min_total=fx.MIN_TOTAL, q=fx.QUANTILE)
    write_result(spark.range(3), path)
    monthly = _monthly(spark, sf)
    write_result(monthly, path, order_by=["book_id", "yyyymm"], parts=6)
    back = settled(spark.read.schema(monthly.schema).option("header", True).csv(path)
                   .select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part")), "part")
    key = F.struct("book_id", "yyyymm")
    ends = back.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))  # a row for each of the 6 files
    ends = ends.withColumn("before", F.lag("last").over(Window.partitionBy(F.lit(1)).orderBy("part")))
    ends = ends.select("part", F.coalesce(F.col("first") > F.col("before"), F.lit(True)).alias("in_order"))
    return back.join(F.broadcast(ends), "part").select("book_id", "yyyymm", "n_month", "in_order")


def _sketch_errors(spark: SparkSession, sf: str) -> DataFrame:
    feats = _kept_feats(spark, sf)
    sketch = at.quantile_thresholds(feats, fx.QUANTILE, SKETCH_ERROR)
    errors = at.threshold_rank_errors(feats, sketch, fx.QUANTILE)
    return errors.select("threshold", "n", (F.col("rank_error") <= SKETCH_ERROR).alias("within"))


def _map_votes(spark: SparkSession, sf: str) -> DataFrame:
    return gn.votes_as_map(fx.table(spark, sf, "genres_named"))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    items = [(t, "parquet", os.path.join(sf, f"{t}.parquet")) for t in DRIVER_TABLES]
    return dataset_report(spark, items).drop("path", "error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # context
        "interactions_per_year": lambda s, sf: cx.interactions_per_year(fx.table(s, sf, "interactions")),
        "publications_per_year": lambda s, sf: cx.publications_per_year(fx.table(s, sf, "books")),
        "reviews_per_year": lambda s, sf: cx.reviews_per_year(fx.table(s, sf, "reviews")),
        # attention
        "monthly_counts": lambda s, sf: at.monthly_counts(fx.table(s, sf, "interactions")),
        "entity_totals": lambda s, sf: at.entity_totals(_monthly(s, sf), fx.MIN_TOTAL),
        "peak_month": lambda s, sf: at.peak_month(
            _monthly(s, sf), at.entity_totals(_monthly(s, sf), fx.MIN_TOTAL)
        ),
        "top_months": lambda s, sf: at.top_months(_monthly(s, sf), 3),
        "top_months_with_ties": lambda s, sf: at.top_months(_monthly(s, sf), 3, ties="all"),
        "attention_features": _feats,
        "quantile_thresholds": lambda s, sf: _thresholds(_kept_feats(s, sf)),
        "quantile_sketch": _sketch_errors,
        "classify_attention": _labeled,
        "class_counts": lambda s, sf: at.class_counts(_labeled(s, sf)),
        "top_viral": lambda s, sf: at.top_viral(_labeled(s, sf), fx.table(s, sf, "books"), TOP_K),
        "top_traditional": lambda s, sf: at.top_traditional(_labeled(s, sf), fx.table(s, sf, "books"), TOP_K),
        "rating_decay": _decay,
        # sentiment
        "clean_sentiment": _sentiment,
        "sentiment_by_class_rating": lambda s, sf: se.sentiment_by_class_rating(_sentiment(s, sf), _labeled(s, sf)),
        "sentiment_by_class_rating_sketch": lambda s, sf: se.sentiment_by_class_rating(
            _sentiment(s, sf), _labeled(s, sf), accuracy=10000
        ),
        "corr_by_class": lambda s, sf: se.corr_by_class(_sentiment(s, sf), _labeled(s, sf)),
        # genres
        "genre_votes": lambda s, sf: gn.genre_votes(fx.table(s, sf, "genres")),
        "named_votes": lambda s, sf: gn.genre_votes(fx.table(s, sf, "genres_named")),
        "map_votes": lambda s, sf: gn.genre_votes(_map_votes(s, sf)),
        "map_votes_lookup": lambda s, sf: gn.hybrid_flags(_map_votes(s, sf), thresh=fx.HYBRID_THRESH),
        "genre_membership": lambda s, sf: gn.genre_membership(gn.genre_votes(fx.table(s, sf, "genres")), fx.HYBRID_THRESH),
        "hybrid_membership": lambda s, sf: gn.hybrid_membership(
            fx.table(s, sf, "genres"), ratio=fx.HYBRID_RATIO, **_hybrid_args()
        ),
        "hybrid_flags": _flags,
        "membership_with_hybrid": _membership_union,
        "all_membership": _membership,
        "supply_share": _supply,
        "demand_share": _demand,
        "latest_year_slice": lambda s, sf: gn.latest_year_slice(_demand(s, sf), gn.HYBRID_LABEL),
        "hybrid_publication_trend": lambda s, sf: gn.hybrid_publication_trend(fx.table(s, sf, "books"), _flags(s, sf)),
        "hybrid_adoption_trend": _adoption,
        "window_totals": lambda s, sf: gn.window_totals(
            fx.table(s, sf, "interactions"), _hybrid_ids(s, sf), WINDOW_START, WINDOW_END
        ),
        "spike_culprits": lambda s, sf: gn.spike_culprits(
            fx.table(s, sf, "interactions"), _hybrid_ids(s, sf), fx.table(s, sf, "books"), WINDOW_START, WINDOW_END, WINDOW_K
        ),
        "dataset_report": _catalog,
        # series shaping over result tables
        "top_k_by_mean_share": _top3_demand,
        "with_highlight": lambda s, sf: sr.with_highlight(_top3_demand(s, sf), gn.HYBRID_LABEL),
        "align_series_null": _align_null,
        "align_series_zero": lambda s, sf: sr.align_series_zero(
            cx.reviews_per_year(fx.table(s, sf, "reviews")), "year",
            ["n_reviews_total", "n_reviews_rating_only", "n_reviews_with_text"], 1990, 2017,
        ),
        "crop_years": lambda s, sf: sr.crop_years(_adoption(s, sf), "added_year", 1996, 2000),
        "scale_units": lambda s, sf: sr.scale_units(
            sr.scale_units(cx.interactions_per_year(fx.table(s, sf, "interactions")), {"n_interactions": 1_000}, "k"),
            {"n_interactions": 1_000_000}, "m",
        ),
        "error_bars": lambda s, sf: sr.error_bars(
            se.sentiment_by_class_rating(_sentiment(s, sf), _labeled(s, sf))
        ),
        "min_support": lambda s, sf: sr.min_support(
            _decay(s, sf), "n_ratings", 5,
            keep={"class": ["viral", "traditional"]}, ranges={"months_since_peak": (-6, 24)},
        ),
        "align_months_by_class": _align_months,
        # scans, sinks and previews
        "read_result_csv": _csv_parts,
        "read_table_json": _json_scan,
        "json_damaged_lines": _json_damaged,
        "csv_sink_ordered": _csv_sink,
        "preview_last_years": lambda s, sf: preview(
            cx.interactions_per_year(fx.table(s, sf, "interactions")), "year", 3
        ),
    }
