"""End-to-end jobs: read the datasets, run the operators, write small CSV results.

Each job mirrors one analysis of the original project, with paths and
thresholds as arguments.  Intermediate tables that several outputs share
(class labels, genre membership, hybrid ids — all catalogue-sized, one row
per book or per (book, genre)) are cut with ``materialize`` into the shared
checkpoint folder, so every output reads them back instead of recomputing the
interaction scans, and a lost executor does not lose them.  The last output
that reads such a table frees it.  Interaction-sized data is never cached.

Run from the command line, e.g.::

    python -m readlens context --interactions I.parquet --books B.parquet \
        --reviews R.parquet --out ./context_out
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readlens.operators import attention as at
from readlens.operators import context as cx
from readlens.operators import genres as gn
from readlens.operators import sentiment as se
from readlens.plans.materialize import Shared, materialize
from readlens.sources.readers import dataset_report, read_table, tagged_path, write_result


def _pq(spark: SparkSession, path: str, *cols: str) -> DataFrame:
    return read_table(spark, path, "parquet", list(cols) or None)


def _written(df: DataFrame, path: str) -> DataFrame:
    """Writes a small result and returns it as read back, so nothing a job returns is computed again or depends on a
    table that has been freed."""
    write_result(df, path, single_file=True)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def context_job(spark, interactions: str, books: str, reviews: str, out: str) -> dict[str, DataFrame]:
    res = {
        "interactions_per_year": cx.interactions_per_year(_pq(spark, interactions, "date_added")),
        "publications_per_year": cx.publications_per_year(_pq(spark, books, "publication_year")),
        "reviews_per_year": cx.reviews_per_year(_pq(spark, reviews, "date_added", "rating", "review_text")),
    }
    return {name: _written(df, f"{out}/{name}") for name, df in res.items()}


def _labels(
    spark, interactions: str, min_total: int, q: float, relative_error: float | None
) -> DataFrame:
    monthly = at.monthly_counts(_pq(spark, interactions, "book_id", "date_added"))
    feats = at.attention_features(monthly, min_total)
    return at.classify_attention(feats, at.quantile_thresholds(feats, q, relative_error))


def attention_labels(
    spark, interactions: str, min_total: int = 1000, q: float = 0.90,
    relative_error: float | None = None, persist: str = "checkpoint",
) -> DataFrame:
    """Per book: features, peak month and class; materialised for reuse.  The caller frees it with ``release``, or by
    calling this within a ``lifetime``."""
    return materialize(_labels(spark, interactions, min_total, q, relative_error), persist)


def virality_job(
    spark, interactions: str, books: str, min_total: int = 1000, q: float = 0.90, k: int = 10,
    relative_error: float | None = None, persist: str = "checkpoint",
) -> dict[str, DataFrame]:
    """``labels`` is handed to the caller materialised (see ``attention_labels``); both lists read it."""
    labels = attention_labels(spark, interactions, min_total, q, relative_error, persist)
    titles = _pq(spark, books, "book_id", "title")
    return {
        "labels": labels,
        "top_viral": at.top_viral(labels, titles, k),
        "top_traditional": at.top_traditional(labels, titles, k),
    }


def rating_decay_job(
    spark, interactions: str, reviews: str, out: str, min_total: int = 1000, q: float = 0.90,
    lo: int = -6, hi: int = 36, relative_error: float | None = None, persist: str = "checkpoint",
) -> DataFrame:
    shared = Shared(_labels(spark, interactions, min_total, q, relative_error), 1, persist)
    with shared.reading() as labels:
        decay = at.rating_decay(_pq(spark, reviews, "book_id", "date_added", "rating"), labels, lo, hi)
        return _written(decay, f"{out}/rating_decay_by_class")


def sentiment_job(
    spark, interactions: str, sentiment: str, out: str, min_total: int = 1000, q: float = 0.90,
    accuracy: int | None = None, relative_error: float | None = None, persist: str = "checkpoint",
) -> dict[str, DataFrame]:
    shared = Shared(_labels(spark, interactions, min_total, q, relative_error), 3, persist)
    sent = se.clean_sentiment(_pq(spark, sentiment, "book_id", "rating", "sentiment_score"))
    with shared.reading() as labels:
        counts = _written(at.class_counts(labels), tagged_path(out, "class_counts_min{m}_q{q}", m=min_total, q=q))
    with shared.reading() as labels:
        by_rating = _written(se.sentiment_by_class_rating(sent, labels, accuracy),
                             tagged_path(out, "sentiment_by_class_rating_min{m}_q{q}", m=min_total, q=q))
    with shared.reading() as labels:
        corr = _written(se.corr_by_class(sent, labels), tagged_path(out, "corr_by_class_min{m}_q{q}", m=min_total, q=q))
    return {"class_counts": counts, "by_rating": by_rating, "corr": corr}


def genre_trends_job(
    spark, genres: str, books: str, interactions: str, out: str, thresh: int = 10, ratio: float = 0.2,
    key_a: str = gn.FANTASY_KEY, key_b: str = gn.ROMANCE_KEY, persist: str = "checkpoint",
) -> dict[str, DataFrame]:
    g = _pq(spark, genres, "book_id", "genres")
    shared = Shared(gn.all_membership(g, key_a, key_b, thresh, ratio), 2, persist)
    with shared.reading() as membership:
        supply = _written(gn.supply_share(_pq(spark, books, "book_id", "publication_year"), membership),
                          tagged_path(out, "pub_year_genre_shares_thresh_{t}", t=thresh))
    with shared.reading() as membership:
        demand = _written(gn.demand_share(_pq(spark, interactions, "book_id", "date_added"), membership),
                          tagged_path(out, "interaction_year_genre_shares_thresh_{t}", t=thresh))
    return {"supply": supply, "demand": demand, "latest": gn.latest_year_slice(demand)}


def hybrid_trends_job(
    spark, genres: str, books: str, interactions: str, out: str, thresh: int = 10,
    key_a: str = gn.FANTASY_KEY, key_b: str = gn.ROMANCE_KEY, persist: str = "checkpoint",
) -> dict[str, DataFrame]:
    shared = Shared(gn.hybrid_flags(_pq(spark, genres, "book_id", "genres"), key_a, key_b, thresh), 2, persist)
    with shared.reading() as flags:
        pub = _written(gn.hybrid_publication_trend(_pq(spark, books, "book_id", "publication_year"), flags),
                       tagged_path(out, "pub_year_trend_thresh_{t}", t=thresh))
    with shared.reading() as flags:
        adopt = _written(gn.hybrid_adoption_trend(_pq(spark, interactions, "book_id", "date_added"), flags),
                         tagged_path(out, "interaction_year_trend_thresh_{t}", t=thresh))
    return {"publication": pub, "adoption": adopt}


def spike_culprits_job(
    spark, genres: str, books: str, interactions: str, out: str, thresh: int = 10, ratio: float = 0.2,
    start: int = 2001, end: int = 2004, k: int = 50,
    key_a: str = gn.FANTASY_KEY, key_b: str = gn.ROMANCE_KEY, persist: str = "checkpoint",
) -> DataFrame:
    shared = Shared(gn.hybrid_ids(_pq(spark, genres, "book_id", "genres"), key_a, key_b, thresh, ratio), 1, persist)
    with shared.reading() as ids:
        res = gn.spike_culprits(
            _pq(spark, interactions, "book_id", "date_added"), ids, _pq(spark, books, "book_id", "title"), start, end, k
        )
        return _written(res, tagged_path(out, "top_romantasy_books_{s}_{e}_THRESH_{t}", s=start, e=end, t=thresh))


def schema_report_job(spark, datasets: list[tuple[str, str, str]]) -> DataFrame:
    return dataset_report(spark, datasets)
