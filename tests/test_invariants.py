
import pytest
from pyspark.sql import functions as F

from paths import SF_MID, SF_SMALL
from readlens.operators import attention as at
from readlens.operators import context as cx
from readlens.operators import genres as gn
from readlens.operators import sentiment as se
from readlens.plans import registry as rg
from readlens.sources import fixtures as fx


@pytest.fixture(scope="module")
def q():
    return rg.queries()


def rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_demand_totals_equal_adoption_and_context(spark, q):
    demand = rows(q["demand_share"](spark, SF_MID).select("added_year", "n_interactions_total").distinct(), "added_year")
    adoption = rows(q["hybrid_adoption_trend"](spark, SF_MID), "added_year")
    context = rows(q["interactions_per_year"](spark, SF_MID), "year")
    assert set(demand) == set(adoption)
    for y, r in demand.items():
        assert r.n_interactions_total == adoption[y].n_interactions
        if 1900 <= y <= 2026:
            assert context[y].n_interactions == r.n_interactions_total
    # the unclamped demand keeps the junk year, the clamped context does not
    assert 101 in demand and 101 not in context


def test_reviews_total_bounds(spark, q):
    for r in q["reviews_per_year"](spark, SF_MID).collect():
        assert r.n_reviews_total >= r.n_reviews_rating_only + r.n_reviews_with_text


def test_sentiment_counts_add_up(spark, q):
    by_rating = q["sentiment_by_class_rating"](spark, SF_MID).groupBy("class").agg(F.sum("n").alias("n"))
    corr = rows(q["corr_by_class"](spark, SF_MID), "class")
    for r in by_rating.collect():
        assert corr[r["class"]].n == r.n


def test_culprit_shares_use_window_totals(spark, q):
    tot = q["window_totals"](spark, SF_MID).first()
    culprits = q["spike_culprits"](spark, SF_MID).collect()
    assert culprits
    for r in culprits:
        assert r.share_within_romantasy == pytest.approx(r.n_romantasy_interactions / tot.total_rom)
        assert r.share_of_total == pytest.approx(r.n_romantasy_interactions / tot.total_all)
    n = [r.n_romantasy_interactions for r in culprits]
    assert n == sorted(n, reverse=True)


def test_strict_hybrid_subset_of_loose(spark):
    g = fx.genres(spark, SF_MID)
    strict = gn.hybrid_ids(g, fx.HYBRID_KEY_A, fx.HYBRID_KEY_B, fx.HYBRID_THRESH, fx.HYBRID_RATIO)
    loose = gn.hybrid_flags(g, fx.HYBRID_KEY_A, fx.HYBRID_KEY_B, fx.HYBRID_THRESH).where("is_romantasy = 1")
    assert strict.join(loose, "book_id", "left_anti").count() == 0
    assert strict.count() == 582 and loose.count() == 617
    lower = gn.hybrid_flags(g, fx.HYBRID_KEY_A, fx.HYBRID_KEY_B, fx.HYBRID_THRESH - 2).where("is_romantasy = 1")
    assert loose.join(lower, "book_id", "left_anti").count() == 0


def test_decay_window_and_publication_denominators(spark, q):
    decay = q["rating_decay"](spark, SF_MID)
    lo, hi = decay.agg(F.min("months_since_peak"), F.max("months_since_peak")).first()
    assert -6 <= lo and hi <= 36
    pubs = rows(q["publications_per_year"](spark, SF_MID), "year")
    for r in q["hybrid_publication_trend"](spark, SF_MID).collect():
        assert r.n_books <= pubs[r.pub_year].n_published_books


def test_fixture_counts(spark):
    inter = fx.interactions(spark, SF_MID)
    no_year = inter.where(~(F.col("date_added").isNotNull() & (F.length("date_added") > 0))).count()
    assert no_year == 1215
    assert inter.where(F.col("date_added").endswith(" 0101")).count() == 117
    rv = fx.reviews(spark, SF_MID)
    for sf in (SF_SMALL, SF_MID):  # every line item is a review
        assert fx.reviews(spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert rv.where("rating IS NULL").count() > 0


def test_reused_labels_give_same_classes(spark):
    # the job path (labels checkpointed to the shared folder) equals the lazy path
    from readlens.plans.materialize import materialize

    monthly = at.monthly_counts(fx.interactions(spark, SF_MID, clean=True))
    feats = at.attention_features(monthly, fx.MIN_TOTAL)
    labels = at.classify_attention(feats, at.quantile_thresholds(feats, fx.QUANTILE))
    cut = materialize(labels)
    a = sorted(tuple(r) for r in at.class_counts(labels).collect())
    b = sorted(tuple(r) for r in at.class_counts(cut).collect())
    assert a == b
    sent = se.clean_sentiment(fx.sentiment_scores(spark, SF_MID))
    assert se.corr_by_class(sent, cut).count() == 3
    assert cx.interactions_per_year(fx.interactions(spark, SF_MID)).count() == 7
