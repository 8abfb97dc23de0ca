
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from readlens.operators import attention as at
from readlens.operators import context as cx
from readlens.operators import genres as gn
from readlens.operators import sentiment as se
from readlens.operators import series as sr
from readlens.sources import readers as rd

def joined(sent, labels):
    return sent.join(labels, "book_id").select("class", "rating", "sentiment_score")


def pearson(x, y):
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


D = "Tue {m} 03 08:19:07 -0800 {y}"


def inter(spark, rows):
    return spark.createDataFrame(rows, "book_id string, date_added string")


def test_peak_tie_takes_earliest_month(spark):
    rows = [("1", D.format(m="Jan", y=2015))] * 5 + [("1", D.format(m="Mar", y=2015))] * 5 + [
        ("1", D.format(m="Feb", y=2015))
    ]
    f = at.attention_features(at.monthly_counts(inter(spark, rows)), 1).first()
    assert f.peak_yyyymm == 201501 and f.peak_interactions == 5
    assert f.first_yyyymm == 201501 and f.time_to_peak_months == 0
    m = at.monthly_counts(inter(spark, rows))
    p = at.peak_month(m, at.entity_totals(m, 1)).first()
    assert (p.peak_yyyymm, p.peak_interactions) == (201501, 5)


def test_null_ids_form_a_total_group_but_no_feature(spark):
    rows = [(None, D.format(m="Jan", y=2015))] * 3 + [("x", D.format(m="Jan", y=2015))] * 3
    m = at.monthly_counts(inter(spark, rows))
    assert at.entity_totals(m, 1).count() == 1  # 'x' casts to NULL too: one NULL group of 6
    assert at.attention_features(m, 1).count() == 0


def test_quantile_empty_input(spark):
    empty = spark.createDataFrame([], "book_id long, peak_share double, time_to_peak_months int")
    thr = at.quantile_thresholds(empty, 0.9)
    assert thr.collect() == []
    assert at.classify_attention(empty, thr).collect() == []


def test_classify_without_thresholds_is_other(spark):
    feats = spark.createDataFrame([(1, 0.5, 3)], "book_id long, peak_share double, time_to_peak_months int")
    none = spark.createDataFrame([], "ps_low double, ps_high double, ttp_low double, ttp_high double")
    assert at.classify_attention(feats, none).first()["class"] == "other"


def test_quantile_approx_form(spark):
    feats = spark.createDataFrame(
        [(i, i / 100.0, i % 12) for i in range(1, 101)], "book_id long, peak_share double, time_to_peak_months int"
    )
    exact = at.quantile_thresholds(feats, 0.9).first()
    approx = at.quantile_thresholds(feats, 0.9, relative_error=0.001).first()
    assert exact == approx
    assert exact.ps_low == pytest.approx(0.1) and exact.ps_high == pytest.approx(0.9)


def test_genre_votes_nulls_and_big_counts(spark):
    schema = "book_id string, genres struct<`a, b`: bigint, c: bigint>"
    df = spark.createDataFrame(
        [("1", (None, None)), ("2", None), ("3", (3_000_000_000, 7))], schema
    )
    got = sorted(tuple(r) for r in gn.genre_votes(df).collect())
    assert got == [("3", "a, b", 3_000_000_000), ("3", "c", 7)]


def test_genre_votes_from_map(spark):
    df = spark.createDataFrame([("1", {"x": 4, "y": None})], "book_id string, genres map<string,bigint>")
    assert [tuple(r) for r in gn.genre_votes(df).collect()] == [("1", "x", 4)]


def test_strict_hybrid_ratio(spark):
    schema = "book_id string, genres struct<f: bigint, r: bigint>"
    df = spark.createDataFrame([("in", (50, 10)), ("out", (51, 10)), ("low", (9, 9)), ("none", None)], schema)
    got = gn.hybrid_membership(df, "f", "r", thresh=10, ratio=0.2)
    assert [tuple(r) for r in got.collect()] == [("in", "romantasy")]


def test_loose_flags_fill_missing_votes(spark):
    schema = "book_id string, genres struct<f: bigint, r: bigint>"
    df = spark.createDataFrame([("1", (12, None)), ("2", (12, 30)), ("3", None)], schema)
    got = {r.book_id: tuple(r)[1:] for r in gn.hybrid_flags(df, "f", "r", thresh=10).collect()}
    assert got == {"1": (12, 0, 0, 1, 0), "2": (12, 30, 1, 0, 0), "3": (0, 0, 0, 0, 0)}


def test_absent_hybrid_key_counts_as_zero(spark):
    df = spark.createDataFrame([("1", (12,))], "book_id string, genres struct<f: bigint>")
    assert gn.hybrid_flags(df, "f", "missing", thresh=10).first().romance_votes == 0


def test_correlation_edges(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "book_id long, class string")
    sent = spark.createDataFrame(
        [(1, 1, 2.0), (2, 3, 0.5), (2, 3, 0.7), (3, 1, 2.0), (3, 2, 3.0)],
        "book_id long, rating int, sentiment_score double",
    )
    got = {r["class"]: (r.n, r.pearson_corr) for r in se.corr_by_class(sent, labels).collect()}
    assert got["a"] == (1, None)
    assert got["b"] == (2, None)
    assert got["c"][0] == 2 and got["c"][1] == pytest.approx(1.0)


def test_clean_sentiment_rules(spark):
    df = spark.createDataFrame(
        [("1", 0, 0.5), ("1", 6, 0.5), ("1", 3, 0.0), ("1", 3, None), ("x", 3, 0.2), ("2", 5, -0.4)],
        "book_id string, rating long, sentiment_score double",
    )
    assert [tuple(r) for r in se.clean_sentiment(df).collect()] == [(2, 5, -0.4)]
    assert se.clean_sentiment(df, exclude_rating_0=False, exclude_sentiment_0=False).count() == 3


def test_reviews_per_year_conditional_counts(spark):
    rows = [
        (D.format(m="Jan", y=2015), 4, None),
        (D.format(m="Jan", y=2015), 4, "   "),
        (D.format(m="Jan", y=2015), None, "good"),
        (D.format(m="Jan", y=2015), 2, "ok"),
        (D.format(m="Jan", y=2016), None, None),
        ("", 5, "x"),
    ]
    df = spark.createDataFrame(rows, "date_added string, rating long, review_text string")
    got = [tuple(r) for r in cx.reviews_per_year(df).collect()]
    assert got == [(2015, 4, 2, 2), (2016, 1, 0, 0)]


def test_result_csv_skips_bad_rows(spark):
    d = tempfile.mkdtemp(prefix="readlens-csv-")
    p = os.path.join(d, "part.csv")
    with open(p, "w") as f:
        f.write("year,n\n2001,5\nabc,3\n2002,\n2003,7\n")
    got = [tuple(r) for r in rd.read_result_csv(spark, p, {"year": "int", "n": "long"}).collect()]
    assert got == [(2001, 5), (2003, 7)]
    with pytest.raises(Exception, match="not a value of type"):
        rd.read_result_csv(spark, p, {"year": "int", "n": "long"}, on_error="raise").collect()
    with pytest.raises(ValueError):
        rd.read_result_csv(spark, p, {"year": "int"}, on_error="?")


def test_result_rows_with_decimals(spark):
    raw = spark.createDataFrame([("5.0",), ("5",), ("5.5",), ("abc",), ("",), (None,), ("1e2",), ("-3.00",)], "n string")
    assert [r.n for r in rd.parse_result_rows(raw, {"n": "long"}).collect()] == [5, 5, 100, -3]
    assert [r.n for r in rd.parse_result_rows(raw.where("n in ('5.0', '-3.00')"), {"n": "int"}, "raise").collect()] == [5, -3]
    for bad in ("abc", "", "5.5"):
        with pytest.raises(Exception, match="not a value of type"):
            rd.parse_result_rows(raw.where(F.col("n") == bad), {"n": "int"}, "raise").collect()


def test_dataset_report_keeps_going(spark):
    good = "/root/testdata/sf0.001/region.parquet"
    rows = rd.dataset_report(
        spark, [("bad", "parquet", "/nonexistent/x.parquet"), ("odd", "avro", good), ("region", "parquet", good)]
    ).collect()
    st = {r.name: r for r in rows}
    assert st["bad"].status == "error" and st["odd"].status == "error"
    assert "Unsupported format" in st["odd"].error
    assert st["region"].status == "ok" and "r_regionkey" in st["region"].schema
    assert st["region"].sample.count("r_regionkey") == 5


def test_dataset_report_isolates_read_errors(spark, tmp_path):
    good, bad = str(tmp_path / "good.parquet"), str(tmp_path / "bad.parquet")
    spark.range(40).repartition(40).write.parquet(good)
    spark.range(2000).selectExpr("cast(id as string) as s").coalesce(1).write.parquet(bad)
    part = next(os.path.join(bad, f) for f in os.listdir(bad) if f.endswith(".parquet"))
    raw = bytearray(open(part, "rb").read())
    raw[20: len(raw) // 2] = b"\xff" * (len(raw) // 2 - 20)  # pages, not the footer
    open(part, "wb").write(bytes(raw))
    crc = os.path.join(bad, f".{os.path.basename(part)}.crc")
    if os.path.exists(crc):
        os.rename(crc, str(tmp_path / "old.crc"))
    st = {r.name: r for r in rd.dataset_report(spark, [("bad", "parquet", bad), ("good", "parquet", good)]).collect()}
    assert st["bad"].status == "error" and st["good"].status == "ok" and st["good"].sample.count("id") == 5


def test_read_table_rejects_unknown_format(spark):
    with pytest.raises(ValueError):
        rd.read_table(spark, "/root/testdata/sf0.001/region.parquet", "orc")


def test_series_helpers(spark):
    df = spark.createDataFrame(
        [(2001, "a", 0.5), (2002, "a", 0.7), (2001, "b", 0.6), (2003, "c", 0.9), (1990, "c", 0.1)],
        "y int, genre string, s double",
    )
    top = sr.top_k_by_mean_share(df, "y", "s", 2000, 2005, k=2)
    assert [r.genre for r in top.collect()] == ["c", "b"]
    keep = sr.with_highlight(top, "a")
    grid = sr.align_series_null(df, "y", "s", keep, 2000, 2005)
    got = {(r.genre, r.y): r.s for r in grid.collect()}
    assert len(got) == 9 and got[("b", 2002)] is None and got[("a", 2002)] == 0.7
    with pytest.raises(Exception, match="No rows with y"):
        sr.crop_years(df, "y", 1800, 1801).collect()
    assert sr.crop_years(df, "y", 1800, 1801, require_rows=False).count() == 0
    assert [r.y for r in sr.crop_years(df, "y", 2001, 2002).collect()] == [2001, 2001, 2002]
    z = sr.align_series_zero(
        spark.createDataFrame([("2001", "3"), ("2002", "x"), ("bad", "1")], "year string, v string"),
        "year", ["v"], 2000, 2005,
    )
    assert [tuple(r) for r in z.collect()] == [(2001, 3.0), (2002, 0.0)]


def test_weighted_percentiles_equal_percentile_disc(spark):
    import random

    rnd = random.Random(7)
    rows = [(rnd.randint(1, 40), rnd.randint(1, 5), round(rnd.choice([-1, 1]) * rnd.randint(0, 12) / 12, 4))
            for _ in range(3000)]
    rows += [(1, 5, 0.5)] * 900  # one hot book
    sent = spark.createDataFrame(rows, "book_id long, rating int, sentiment_score double")
    labels = spark.createDataFrame([(b, "c%d" % (b % 3)) for b in range(1, 41)], "book_id long, class string")
    got = {(r["class"], r.rating): r for r in se.sentiment_by_class_rating(sent, labels).collect()}
    raw = joined(sent, labels).groupBy("class", "rating").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("sentiment_score").alias("a"),
        F.expr("percentile_disc(0.05) WITHIN GROUP (ORDER BY sentiment_score)").alias("p05"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY sentiment_score)").alias("p95"),
    )
    for r in raw.collect():
        g = got[(r["class"], r.rating)]
        assert (g.n, g.p05_sentiment, g.p95_sentiment) == (r.n, r.p05, r.p95)
        assert g.avg_sentiment == pytest.approx(r.a, abs=1e-12)
    corr = {r["class"]: r.pearson_corr for r in se.corr_by_class(sent, labels).collect()}
    ref = joined(sent, labels).groupBy("class").agg(pearson("rating", "sentiment_score").alias("c"))
    for r in ref.collect():
        assert corr[r["class"]] == pytest.approx(r.c, abs=1e-12)
    approx = se.sentiment_by_class_rating(sent, labels, accuracy=10000).collect()
    assert {(r["class"], r.rating): tuple(r)[2:3] + tuple(r)[4:] for r in approx} == {k: tuple(r)[2:3] + tuple(r)[4:] for k, r in got.items()}


def test_duplicate_catalogue_ids(spark):
    # a duplicated id fans title joins out, n_books stays distinct, flags are summed over rows
    books = spark.createDataFrame(
        [("1", "A", "2001"), ("1", "A again", "2001"), ("2", "B", "2001"), ("3", "C", "2002")],
        "book_id string, title string, publication_year string",
    )
    schema = "book_id string, genres struct<f: bigint, r: bigint>"
    g = spark.createDataFrame([("1", (20, 20)), ("2", (20, 1)), ("3", (1, 1))], schema)
    flags = gn.hybrid_flags(g, "f", "r", thresh=10)
    trend = {r.pub_year: r for r in gn.hybrid_publication_trend(books, flags, 1960, 2019).collect()}
    assert trend[2001].n_books == 2 and trend[2001].n_romantasy == 2 and trend[2001].n_fantasy_only == 1
    labeled = spark.createDataFrame(
        [(1, 30, 201501, 201502, 10, 0.5, 1, "viral"), (2, 30, 201501, 201501, 5, 0.2, 0, "viral")],
        "book_id long, total_interactions long, first_yyyymm int, peak_yyyymm int, peak_interactions long, "
        "peak_share double, time_to_peak_months int, class string",
    )
    top = [tuple(r)[:2] for r in at.top_viral(labeled, books, k=10).collect()]
    assert top == [(1, "A"), (1, "A again"), (2, "B")]
    assert [tuple(r)[:2] for r in at.top_viral(labeled, books, k=2).collect()] == [(1, "A"), (1, "A again")]



def test_monthly_counts_optional_year_bounds(spark):
    rows = [("1", D.format(m="Jan", y=2015)), ("1", D.format(m="Feb", y="0101")), ("1", D.format(m="Mar", y=2030))]
    df = inter(spark, rows)
    assert sorted(r.yyyymm for r in at.monthly_counts(df).collect()) == [10102, 201501, 203003]
    assert [r.yyyymm for r in at.monthly_counts(df, ymin=1900, ymax=2026).collect()] == [201501]


def test_correlation_constant_fractional_score_is_null(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "book_id long, class string")
    sent = spark.createDataFrame(
        [(1, 1, 0.1), (2, 2, 0.1), (3, 5, 0.1), (4, 1, 0.1), (4, 3, 0.3), (4, 2, 0.3)],
        "book_id long, rating int, sentiment_score double",
    )
    got = {r["class"]: r.pearson_corr for r in se.corr_by_class(sent, labels).collect()}
    assert got["a"] is None
    ref = joined(sent, labels).where("class = 'b'").agg(pearson("rating", "sentiment_score")).first()[0]
    assert got["b"] == pytest.approx(ref, abs=1e-12)
