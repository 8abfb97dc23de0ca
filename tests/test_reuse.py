"""Lifetimes of reused tables, rankings that keep n, the merged sketch, map votes and settled columns."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from readlens.functions.expr import settled
from readlens.operators import attention as at
from readlens.operators import genres as gn
from readlens.operators import quantiles as qt
from readlens.operators import series as sr
from readlens.plans import jobs
from readlens.plans import materialize as mt
from readlens.sources import fixtures as fx


# ---- persist and unpersist ----------------------------------------------------------------
def folder(df):
    path = mt.checkpoint_folder(df)
    return path and path.removeprefix("file:")


def test_release_frees_checkpoints_and_caches(spark):
    df = mt.materialize(spark.range(100).repartition(3))
    assert os.listdir(folder(df)) and df.count() == 100
    mt.release(df)
    assert not os.path.exists(folder(df))
    cached = mt.materialize(spark.range(100).withColumn("x", F.rand(1)), "persist")
    cached.count()
    assert cached.is_cached and spark.sparkContext._jsc.getPersistentRDDs()
    mt.release(cached)
    assert not cached.is_cached
    assert mt.checkpoint_folder(spark.range(3)) is None


@pytest.mark.parametrize("mode", ["checkpoint", "persist"])
def test_the_last_reader_frees_a_shared_table(spark, mode):
    shared = mt.Shared(spark.range(50), 3, mode)
    with shared.reading() as one, shared.reading() as two:
        assert one.count() == two.count() == 50
        path = folder(one)
    assert shared.left == 1 and (path is None or os.path.exists(path))
    with pytest.raises(KeyError), shared.reading():
        raise KeyError  # a reader that fails has finished, too
    assert shared.left == 0 and (path is None) == (mode == "persist")
    assert path is None or not os.path.exists(path)
    with pytest.raises(RuntimeError), shared.reading():
        pass
    with pytest.raises(ValueError):
        mt.Shared(spark.range(1), 0)


def test_lifetimes_free_what_was_made_in_them(spark):
    outer_path = inner_path = None
    with mt.lifetime():
        outer = mt.materialize(spark.range(10))
        outer_path = mt.scratch_path(spark, "outer")
        outer.write.parquet(outer_path)
        with mt.lifetime():
            inner = mt.materialize(outer.where("id > 4"))
            inner_path = mt.scratch_path(spark, "inner")
            inner.write.parquet(inner_path)
            assert inner.count() == 5
        assert not os.path.exists(folder(inner)) and not os.path.exists(inner_path.removeprefix("file:"))
        assert outer.count() == 10 and os.path.exists(outer_path.removeprefix("file:"))
    assert not os.path.exists(folder(outer)) and not os.path.exists(outer_path.removeprefix("file:"))
    # outside of any, tables stay until they are released
    kept = mt.materialize(spark.range(4))
    assert os.path.exists(folder(kept))
    mt.release(kept)


def test_a_lifetime_ends_with_an_error(spark):
    with pytest.raises(ZeroDivisionError), mt.lifetime():
        df = mt.materialize(spark.range(10))
        _ = 1 / 0
    assert not os.path.exists(folder(df))


def test_jobs_leave_no_checkpoint(spark, tmp_path):
    g = str(tmp_path / "genres.parquet")
    b = str(tmp_path / "books.parquet")
    i = str(tmp_path / "interactions.parquet")
    fx.genres(spark, SF_SMALL).write.parquet(g)
    fx.books(spark, SF_SMALL).write.parquet(b)
    fx.interactions(spark, SF_SMALL).write.parquet(i)
    base = mt.checkpoint_dir(spark).removeprefix("file:")

    def checkpoints():
        return {f for f in os.listdir(base) if f.startswith("rdd-")}

    before = checkpoints()
    out = jobs.genre_trends_job(spark, g, b, i, str(tmp_path / "out"), fx.HYBRID_THRESH, fx.HYBRID_RATIO, fx.HYBRID_KEY_A, fx.HYBRID_KEY_B)
    assert checkpoints() == before
    # results are read back from the files, so they don't need the freed table
    want = gn.demand_share(fx.interactions(spark, SF_SMALL), gn.all_membership(fx.genres(spark, SF_SMALL), fx.HYBRID_KEY_A, fx.HYBRID_KEY_B, fx.HYBRID_THRESH, fx.HYBRID_RATIO))
    assert sorted(map(tuple, out["demand"].collect())) == sorted(map(tuple, want.collect()))
    assert out["latest"].count() == 1


# ---- row_number, keep n ---------------------------------------------------------------------
def brute_top(rows, n, ties):
    by = collections.defaultdict(list)
    for b, ym, k in rows:
        by[b].append((-k, ym))
    out = []
    for b, months in by.items():
        months.sort()
        counts = [k for k, _ in months]
        for i, (k, ym) in enumerate(months):
            rank = {"first": i + 1, "all": counts.index(k) + 1, "dense": len(set(counts[: i + 1]))}[ties]
            if rank <= n:
                out.append((b, ym, -k, rank))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ties", ["first", "all", "dense"])
@pytest.mark.parametrize("n", [1, 3])
def test_top_months_with_a_hot_entity(spark, n, ties):
    r = np.random.default_rng(n)
    rows = [(int(b), int(ym), int(k)) for b, ym, k in zip(r.integers(0, 40, 300), r.permutation(300), r.integers(1, 4, 300), strict=True)]
    rows += [(7, 1000 + i, int(k)) for i, k in enumerate(r.integers(1, 60, 3000))] + [(None, 5, 2), (None, 6, 2)]
    df = spark.createDataFrame(rows, "book_id long, yyyymm int, n_month long").repartition(8)
    got = at.top_months(df, n, ties)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_top(rows, n, ties)


def test_top_months_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("book_id"), F.col("id").cast("int").alias("yyyymm"), (F.col("id") % 7).alias("n_month"))
    plan = at.top_months(df, 3)._jdf.queryExecution().executedPlan().toString()
    partial, final = plan.index("WindowGroupLimit", plan.index("WindowGroupLimit") + 1), plan.index("WindowGroupLimit")
    assert final < plan.index("Exchange hashpartitioning(book_id") < partial
    with pytest.raises(ValueError):
        at.top_months(df, 3, "some")


# ---- sketch merged in a tree ------------------------------------------------------------------
def rank_errors(values, groups, found, probs):
    out = []
    for g, row in found.items():
        v = np.sort(values[groups == g])
        for p, x in zip(probs, row, strict=True):
            rank = max(1, int(np.ceil(len(v) * p)))
            lo, hi = np.searchsorted(v, x, "left") + 1, np.searchsorted(v, x, "right")
            out.append(max(lo - rank, rank - hi, 0) / len(v))
    return out


@pytest.mark.parametrize("error,parts", [(0.05, 7), (0.01, 40)])
def test_sketch_rank_error_over_many_tasks(spark, error, parts, monkeypatch):
    monkeypatch.setattr(qt, "FAN_IN_BITS", 2)  # all three rounds of merging have work
    r = np.random.default_rng(5)
    n = 60_000
    groups = np.where(r.random(n) < 0.9, "hot", "cold")
    values = np.where(r.random(n) < 0.3, np.round(r.normal(size=n), 1), r.lognormal(0, 3, n))
    df = spark.createDataFrame(list(zip(groups.tolist(), np.sort(values).tolist(), strict=True)), "g string, v double").repartition(parts)
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {x.g: tuple(x)[1:] for x in qt.sketch_percentiles(df, ["g"], "v", probs, error).collect()}
    assert set(got) == {"hot", "cold"}
    assert max(rank_errors(np.sort(values), groups, got, probs.values())) <= error


def test_sketch_of_few_values_and_of_none(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", None), ("y", 5.0), ("z", None)], "g string, v double")
    got = {r.g: (r.lo, r.hi) for r in qt.sketch_percentiles(df, ["g"], "v", {"lo": 0.1, "hi": 0.9}, 0.01).collect()}
    assert got == {"x": (1.0, 2.0), "y": (5.0, 5.0)}


def test_sketch_thresholds_against_the_exact_ones(spark):
    feats = spark.range(50_000, numPartitions=9).select(
        F.col("id").alias("book_id"), (F.pmod(F.xxhash64("id"), F.lit(99_991)) / 99_991.0).alias("peak_share"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300)).cast("int").alias("time_to_peak_months"))
    exact, sketch = at.quantile_thresholds(feats, 0.9), at.quantile_thresholds(feats, 0.9, 0.001)
    assert sketch.columns == exact.columns
    errors = {r.threshold: (r.n, r.rank_error) for r in at.threshold_rank_errors(feats, sketch, 0.9).collect()}
    assert set(errors) == set(exact.columns) and all(n == 50_000 and e <= 0.001 for n, e in errors.values())
    assert all(r.rank_error == 0 for r in at.threshold_rank_errors(feats, exact, 0.9).collect())
    assert at.quantile_thresholds(feats.limit(0), 0.9, 0.01).count() == 0


def test_sketch_merges_few_summaries_in_one_task(spark):
    df = spark.range(0, 1000, 1, 4).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    plan = qt.sketch_percentiles(df, ["g"], "v", {"p": 0.5}, 0.1)._jdf.queryExecution().executedPlan().toString()
    # the raw rows are folded where they are: the first exchange has one row per task and group
    assert "SinglePartition" not in plan and "partial_percentile_approx" in plan
    assert plan.count("Exchange hashpartitioning(g") >= qt.ROUNDS


# ---- map votes ------------------------------------------------------------------------------------
NAMED = "book_id string, genres struct<`fantasy, paranormal`: bigint, romance: bigint, `a.b`: bigint>"


def test_struct_and_map_votes_agree(spark):
    rows = [("1", (3, 4, None)), ("2", (None, 9_000_000_000, 1)), ("3", (None, None, None)), ("4", None)]
    g = spark.createDataFrame(rows, NAMED)
    m = gn.votes_as_map(g)
    assert dict(m.dtypes)["genres"] == "map<string,bigint>"
    want = {("1", "fantasy, paranormal", 3), ("1", "romance", 4), ("2", "romance", 9_000_000_000), ("2", "a.b", 1)}
    assert {tuple(r) for r in gn.genre_votes(m).collect()} == want == {tuple(r) for r in gn.genre_votes(g).collect()}
    for df in (g, m, gn.votes_as_map(m)):
        got = {(r.book_id, r.fantasy_votes, r.romance_votes, r.is_romantasy) for r in gn.hybrid_flags(df, thresh=3).collect()}
        assert got == {("1", 3, 4, 1), ("2", 0, 9_000_000_000, 0), ("3", 0, 0, 0), ("4", 0, 0, 0)}
        assert [r[0] for r in df.orderBy("book_id").select(gn.vote_of(df, "no such key", -1)).collect()] == [-1] * 4
    ints = spark.createDataFrame([("1", {"romance": 2})], "book_id string, genres map<string,int>")
    assert dict(gn.votes_as_map(ints).dtypes)["genres"] == "map<string,bigint>"
    with pytest.raises(TypeError):
        gn.votes_as_map(spark.createDataFrame([("1", "x")], "book_id string, genres string"))


# ---- settled columns --------------------------------------------------------------------------------
def test_settled_columns_are_computed_once(spark):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_partkey", "l_tax", F.regexp_extract(F.col("l_shipdate").cast("string"), r"(\d{4})", 1).alias("y"))
    out = settled(df, "y").where("y > '1995' and y < '1999'").select("l_partkey", "y")
    assert out.count() == df.where("y > '1995' and y < '1999'").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract(cast(") == 1
    assert "l_tax" not in plan.split("ReadSchema:")[1].splitlines()[0]
    assert settled(df).columns == df.columns


def test_zero_and_cropped_series_keep_their_rows(spark):
    df = spark.createDataFrame([("2001", "5", None), ("1999", "x", "2"), ("junk", "1", "1"), (None, "1", "1")], "y string, a string, b string")
    assert [tuple(r) for r in sr.align_series_zero(df, "y", ["a", "b"], 1990, 2010).collect()] == [(1999, 0.0, 2.0), (2001, 5.0, 0.0)]


def test_month_axis_by_class(spark):
    rows = [("viral", -1, 4.0), ("viral", 2, 3.5), ("traditional", 0, 4.1), ("traditional", 99, 1.0), ("other", 1, 2.0)]
    df = spark.createDataFrame(rows, "class string, m int, avg double")
    classes = spark.createDataFrame([("viral",), ("traditional",)], "class string")
    got = [tuple(r) for r in sr.align_series_null(df, "m", "avg", classes, -6, 24, genre_col="class").collect()]
    assert got == [("traditional", -1, None), ("traditional", 0, 4.1), ("traditional", 2, None), ("viral", -1, 4.0), ("viral", 0, None), ("viral", 2, 3.5)]
