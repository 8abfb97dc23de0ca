"""Rows per second of headline chains on a stored, replicated copy of the fixtures.

    python tools/throughput.py [/root/testdata/sf0.1] [replicas]

The interactions fixture is replicated ``replicas`` times (default 10) into a
stored Parquet table once; each chain then runs into the ``noop`` sink, best
of three.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from readlens.operators import attention as at  # noqa: E402
from readlens.operators import context as cx  # noqa: E402
from readlens.operators import genres as gn  # noqa: E402
from readlens.plans.materialize import lifetime, materialize, scratch_path  # noqa: E402
from readlens.plans.session import local_session  # noqa: E402
from readlens.sources import fixtures as fx  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    reps = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    spark = local_session(8, 8)
    path = scratch_path(spark, "throughput")
    (fx.table(spark, sf, "interactions")
     .select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("_rep")).drop("_rep")
     .repartition(32).write.parquet(path))
    inter = spark.read.parquet(path)
    n = inter.count()
    genres = fx.table(spark, sf, "genres")
    mem = gn.membership_with_hybrid(
        gn.genre_membership(gn.genre_votes(genres), fx.HYBRID_THRESH),
        gn.hybrid_membership(genres, fx.HYBRID_KEY_A, fx.HYBRID_KEY_B, fx.HYBRID_THRESH, fx.HYBRID_RATIO))

    def labels(relative_error=None):
        feats = materialize(at.attention_features(at.monthly_counts(inter), fx.MIN_TOTAL * reps))
        return at.classify_attention(feats, at.quantile_thresholds(feats, fx.QUANTILE, relative_error))

    chains = {
        "yearly counts (Q01)": lambda: cx.interactions_per_year(inter),
        "attention classes (Q04-Q09), exact thresholds": labels,
        "attention classes (Q04-Q09), thresholds to 0.001": lambda: labels(0.001),
        "demand shares (Q23)": lambda: gn.demand_share(inter, mem),
    }
    print(f"| chain | rows | sec (best of 3) | rows/s |\n| --- | --- | --- | --- |")
    for name, fn in chains.items():
        best = 1e9
        for _ in range(3):
            t0 = time.perf_counter()
            with lifetime():
                fn().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        print(f"| {name} | {n:,} | {best:.2f} | {n / best / 1e6:.2f} M |")


if __name__ == "__main__":
    main()
