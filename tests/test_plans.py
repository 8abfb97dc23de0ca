"""Plan-shape checks: built-in expressions only, pruned scans, pushed filters,
partial aggregation before shuffles, semi joins where promised."""

import pytest

from paths import SF_SMALL
from readlens.operators import attention as at
from readlens.operators import context as cx
from readlens.operators import genres as gn
from readlens.plans import registry as rg
from readlens.sources import fixtures as fx


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(rg.queries()))
def test_no_python_udf_in_any_query(spark, name):
    p = plan(rg.queries()[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct"):
        assert node not in p, (name, node)


def test_context_scan_reads_one_column(spark):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").selectExpr(
        "date_format(l_shipdate, 'EEE MMM dd HH:mm:ss') || ' +0000 1999' AS date_added", "l_partkey"
    )
    p = plan(cx.interactions_per_year(df))
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" in p


def test_attention_features_is_hash_aggregated_without_window(spark):
    monthly = at.monthly_counts(fx.interactions(spark, SF_SMALL, clean=True))
    p = plan(at.attention_features(monthly, 20))
    assert "SortAggregate" not in p and "Window" not in p
    assert p.count("Exchange hashpartitioning") == 2  # (book, month) then book
    assert "partial_count" in p and "partial_max" in p


def test_peak_month_uses_semi_join(spark):
    monthly = at.monthly_counts(fx.interactions(spark, SF_SMALL, clean=True))
    p = optimized(at.peak_month(monthly, at.entity_totals(monthly, 20)))
    assert "LeftSemi" in p


def test_demand_preaggregates_before_fan_out(spark):
    inter = fx.interactions(spark, SF_SMALL)
    g = fx.genres(spark, SF_SMALL)
    mem = gn.genre_membership(gn.genre_votes(g), 6)
    p = optimized(gn.demand_share(inter, mem))
    # the join's interaction side is an Aggregate on (book_id, added_year)
    join_at = p.index("Join Inner")
    assert "Aggregate [book_id" in p[join_at:]


def test_thresholds_enter_as_scalar_subquery(spark):
    feats = at.attention_features(at.monthly_counts(fx.interactions(spark, SF_SMALL, clean=True)), 20)
    p = plan(at.classify_attention(feats, at.quantile_thresholds(feats, 0.7)))
    assert "Subquery" in p and "NestedLoopJoin" not in p


def test_top_k_uses_take_ordered(spark):
    p = plan(rg.queries()["top_viral"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_filters_pushed_to_parquet(spark):
    books = spark.read.parquet(f"{SF_SMALL}/part.parquet").selectExpr(
        "CAST(p_partkey AS STRING) AS book_id", "CAST(1955 + p_size AS STRING) AS publication_year"
    )
    p = plan(cx.publications_per_year(books))
    assert "ReadSchema: struct<p_size:int>" in p


def _filters(p: str) -> list[str]:
    return [ln for ln in p.splitlines() if ln.lstrip(" :+-").startswith("Filter")]


@pytest.mark.parametrize("name", sorted(rg.queries()))
def test_text_is_not_parsed_or_built_in_filters(spark, name):
    # parsed values are filtered after the aggregate and derived dates are built once, so no Filter node does either
    p = plan(rg.queries()[name](spark, SF_SMALL))
    assert not [f for f in _filters(p) if "regexp_extract" in f or "date_format" in f], name


def test_monthly_counts_parses_each_value_once(spark):
    p = plan(at.monthly_counts(fx.table(spark, SF_SMALL, "interactions_clean")))
    assert p.count("regexp_extract") == 2  # one year parse, one month-token parse


def scans(spark, query, table, column="") -> int:
    """Scans of a driver table (reading ``column``) in the plans that ran, subqueries included; a reused exchange
    has no scan of its own."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()

    def executions():
        return {e.executionId() for e in (lambda x: (x.apply(i) for i in range(x.size())))(store.executionsList())}

    # by id: the store keeps the last thousand only
    before = max(executions(), default=-1)
    query(spark, SF_SMALL).collect()
    bus.waitUntilEmpty()
    found = 0
    for i in sorted(x for x in executions() if x > before):
        nodes = store.planGraph(i).allNodes()
        descs = [nodes.apply(j).desc() for j in range(nodes.size()) if nodes.apply(j).name().startswith("Scan parquet")]
        found += sum(f"/{table}.parquet" in d and column in d for d in descs)
    return found


@pytest.mark.parametrize("name", ["demand_share", "spike_culprits", "latest_year_slice", "top_k_by_mean_share"])
def test_interaction_pass_is_shared_between_branches(spark, name):
    # the ship date is read for interactions only
    assert scans(spark, rg.queries()[name], "lineitem", "l_shipdate") == 1


@pytest.mark.parametrize("name", ["supply_share", "align_series_null"])
def test_supply_reads_each_table_once(spark, name):
    assert scans(spark, rg.queries()[name], "part") == 1
    assert scans(spark, rg.queries()[name], "lineitem") == 1


def test_crop_and_correlation_are_one_pass(spark):
    q = rg.queries()
    assert scans(spark, q["crop_years"], "lineitem") == scans(spark, q["hybrid_adoption_trend"], "lineitem")
    # scores once, interactions once for the labels, the cuts included
    assert scans(spark, q["corr_by_class"], "lineitem", "l_shipdate") == 1
    assert scans(spark, q["corr_by_class"], "lineitem", "l_discount") == 1


#: Queries over files that are written for them when they run, and those that cut per-book features or classes.
OVER_FILES = {"read_result_csv", "read_table_json", "json_damaged_lines", "csv_sink_ordered"}
OVER_CUTS = {"quantile_thresholds", "quantile_sketch", "classify_attention", "class_counts", "top_viral", "top_traditional", "rating_decay",
             "sentiment_by_class_rating", "sentiment_by_class_rating_sketch", "corr_by_class", "error_bars", "min_support", "align_months_by_class"}


@pytest.mark.parametrize("name", sorted(set(rg.queries()) - OVER_FILES - OVER_CUTS))
def test_building_a_query_writes_nothing(spark, name, tmp_path):
    import os

    before = spark.sparkContext.getCheckpointDir()
    seen = set(os.listdir(before.removeprefix("file:"))) if before else set()
    rg.queries()[name](spark, SF_SMALL)
    after = set(os.listdir(before.removeprefix("file:"))) if before else set()
    assert after == seen


@pytest.mark.parametrize("name", ["sentiment_by_class_rating", "error_bars", "quantile_thresholds"])
def test_percentile_plans_stay_small(spark, name):
    p = plan(rg.queries()[name](spark, SF_SMALL))
    assert p.count("Scan ") <= 24 and p.count("Exchange") <= 100, (p.count("Scan "), p.count("Exchange"))


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from readlens.plans.materialize import checkpoint_dir

    def session(master, conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(
            master=master, getCheckpointDir=lambda: None, getConf=lambda: conf, setCheckpointDir=lambda d: None))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            checkpoint_dir(session(master, {}))
        assert checkpoint_dir(session(master, {"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
