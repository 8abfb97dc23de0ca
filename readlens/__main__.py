"""Command line for the end-to-end jobs (``python -m readlens <job> ...``)."""

from __future__ import annotations

import argparse

from readlens.plans import jobs
from readlens.plans.session import configure


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="readlens")
    sub = ap.add_subparsers(dest="job", required=True)
    for name in ("context", "virality", "decay", "sentiment", "genres", "hybrid", "culprits"):
        p = sub.add_parser(name)
        for opt in ("interactions", "books", "reviews", "genres", "sentiment"):
            p.add_argument(f"--{opt}")
        p.add_argument("--out", default="./readlens_out")
        p.add_argument("--min_total", type=int, default=1000)
        p.add_argument("--q", type=float, default=0.90)
        p.add_argument("--k", type=int, default=None)
        p.add_argument("--thresh", type=int, default=10)
        p.add_argument("--ratio", type=float, default=0.2)
        p.add_argument("--start", type=int, default=2001)
        p.add_argument("--end", type=int, default=2004)
    p = sub.add_parser("schemas", help="schema tree and 5-row sample per dataset")
    p.add_argument("--dataset", action="append", default=[], metavar="NAME:FORMAT:PATH")
    p.add_argument("--out", default="./schemas")
    a = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    owned = SparkSession.getActiveSession() is None
    spark = configure(SparkSession.builder.appName(f"readlens_{a.job}").getOrCreate())
    if a.job == "schemas":
        items = [tuple(d.split(":", 2)) for d in a.dataset]
        report = jobs.schema_report_job(spark, items)
        report.coalesce(1).write.mode("overwrite").json(a.out)
        failed = report.where("status <> 'ok'").count()
        if owned:
            spark.stop()
        raise SystemExit(2 if failed else 0)
    if a.job == "context":
        jobs.context_job(spark, a.interactions, a.books, a.reviews, a.out)
    elif a.job == "virality":
        res = jobs.virality_job(spark, a.interactions, a.books, a.min_total, a.q, a.k or 10)
        res["top_viral"].show(truncate=False)
        res["top_traditional"].show(truncate=False)
    elif a.job == "decay":
        jobs.rating_decay_job(spark, a.interactions, a.reviews, a.out, a.min_total, a.q)
    elif a.job == "sentiment":
        jobs.sentiment_job(spark, a.interactions, a.sentiment, a.out, a.min_total, a.q)
    elif a.job == "genres":
        jobs.genre_trends_job(spark, a.genres, a.books, a.interactions, a.out, a.thresh, a.ratio)
    elif a.job == "hybrid":
        jobs.hybrid_trends_job(spark, a.genres, a.books, a.interactions, a.out, a.thresh)
    elif a.job == "culprits":
        jobs.spike_culprits_job(
            spark, a.genres, a.books, a.interactions, a.out, a.thresh, a.ratio, a.start, a.end, a.k or 50
        )
    if owned:
        spark.stop()


if __name__ == "__main__":
    main()
