"""Every registered query against its DuckDB oracle on the whole sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from readlens.sources.readers import dataset_report

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else ("n", round(v, 9))
    if isinstance(v, bool):
        return ("n", float(v))
    if isinstance(v, int):
        return ("n", float(v))
    return ("s", str(v))


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_listed():
    from readlens.plans.registry import queries

    assert set(queries()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _canon(df.columns, rows) == _canon(ocols, orows)


def test_dataset_report_rows(spark):
    rows = E.queries()["dataset_report"](spark, SF_SMALL).collect()
    assert len(rows) == len(TABLES) and all(r.status == "ok" for r in rows)
    full = dataset_report(spark, [(t, "parquet", f"{SF_SMALL}/{t}.parquet") for t in TABLES]).collect()
    assert all(r.schema.startswith("root") and r.error is None for r in full)


def test_entry_smoke(spark):
    df = E.entry(spark)
    counts = {r["class"]: r["count"] for r in df.groupBy("class").count().collect()}
    assert counts == {"viral": 11, "traditional": 10, "other": 174}
