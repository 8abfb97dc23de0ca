"""End-to-end jobs on fixture tables written as Parquet (sf0.001): outputs are
written as CSV, read back, and equal the lazily computed operators."""

import os
import tempfile

import pytest

from paths import SF_SMALL
from readlens.__main__ import main as cli
from readlens.operators import attention as at
from readlens.plans import jobs
from readlens.sources import fixtures as fx
from readlens.sources.readers import read_result_csv


@pytest.fixture(scope="module")
def paths(spark):
    d = tempfile.mkdtemp(prefix="readlens-jobs-")
    tables = {
        "interactions": fx.interactions(spark, SF_SMALL),
        "clean": fx.interactions(spark, SF_SMALL, clean=True),
        "books": fx.books(spark, SF_SMALL),
        "reviews": fx.reviews(spark, SF_SMALL),
        "genres": fx.genres(spark, SF_SMALL),
        "sentiment": fx.sentiment_scores(spark, SF_SMALL),
    }
    out = {}
    for name, df in tables.items():
        out[name] = os.path.join(d, f"{name}.parquet")
        df.write.parquet(out[name])
    out["out"] = os.path.join(d, "out")
    return out


def test_context_job_writes_csvs(spark, paths):
    res = jobs.context_job(spark, paths["interactions"], paths["books"], paths["reviews"], paths["out"])
    back = read_result_csv(spark, f"{paths['out']}/interactions_per_year", {"year": "int", "n_interactions": "long"})
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, res["interactions_per_year"].collect()))
    assert len([f for f in os.listdir(f"{paths['out']}/reviews_per_year") if f.startswith("part-")]) == 1


def test_virality_job_exact_classes(spark, paths):
    res = jobs.virality_job(spark, paths["clean"], paths["books"], fx.MIN_TOTAL, fx.QUANTILE, relative_error=None)
    counts = {r["class"]: r["count"] for r in at.class_counts(res["labels"]).collect()}
    assert counts == {"viral": 11, "traditional": 10, "other": 174}
    assert res["top_viral"].count() == 10 and res["top_viral"].where("title IS NULL").count() == 0


def test_sentiment_and_decay_jobs(spark, paths):
    res = jobs.sentiment_job(spark, paths["clean"], paths["sentiment"], paths["out"], fx.MIN_TOTAL, fx.QUANTILE)
    assert os.path.isdir(f"{paths['out']}/corr_by_class_min{fx.MIN_TOTAL}_q{fx.QUANTILE}")
    assert res["corr"].count() == 3
    decay = jobs.rating_decay_job(spark, paths["clean"], paths["reviews"], paths["out"], fx.MIN_TOTAL, fx.QUANTILE)
    assert decay.count() > 0


def test_genre_jobs(spark, paths):
    kw = dict(key_a=fx.HYBRID_KEY_A, key_b=fx.HYBRID_KEY_B)
    g = jobs.genre_trends_job(spark, paths["genres"], paths["books"], paths["interactions"], paths["out"],
                              fx.HYBRID_THRESH, fx.HYBRID_RATIO, **kw)
    assert g["supply"].count() > 0 and g["latest"].count() == 1
    h = jobs.hybrid_trends_job(spark, paths["genres"], paths["books"], paths["interactions"], paths["out"],
                               fx.HYBRID_THRESH, **kw)
    assert h["adoption"].count() > 0
    c = jobs.spike_culprits_job(spark, paths["genres"], paths["books"], paths["interactions"], paths["out"],
                                fx.HYBRID_THRESH, fx.HYBRID_RATIO, 1996, 1998, 50, **kw)
    assert 0 < c.count() <= 50
    assert os.path.isdir(f"{paths['out']}/top_romantasy_books_1996_1998_THRESH_{fx.HYBRID_THRESH}")


def test_cli_context(spark, paths):
    out = paths["out"] + "_cli"
    cli(["context", "--interactions", paths["interactions"], "--books", paths["books"],
         "--reviews", paths["reviews"], "--out", out])
    assert os.path.isdir(f"{out}/publications_per_year")


def test_cli_schemas(spark, paths):
    out = paths["out"] + "_schemas"
    with pytest.raises(SystemExit) as ex:
        cli(["schemas", "--dataset", f"books:parquet:{paths['books']}", "--dataset", "bad:parquet:/nonexistent",
             "--out", out])
    assert ex.value.code == 2  # one dataset failed, the other was still reported
    rows = {r.name: r.status for r in spark.read.json(out).collect()}
    assert rows == {"books": "ok", "bad": "error"}
