"""Summarise the physical plans of the headline queries into PLANS.md.

    python tools/plans.py /root/testdata/sf0.1 > PLANS.md

For each query: the operator tree of the executed (adaptive, final) plan with
exchanges, joins, aggregates and scans, and each scan's pruned schema and
pushed filters.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from readlens.plans.registry import queries  # noqa: E402
from readlens.plans.session import local_session  # noqa: E402

HEADLINE = ["interactions_per_year", "reviews_per_year", "attention_features", "classify_attention",
            "top_viral", "rating_decay", "sentiment_by_class_rating", "corr_by_class", "supply_share",
            "demand_share", "hybrid_adoption_trend", "spike_culprits"]
KEEP = re.compile(r"(Exchange|Aggregate|Join|Scan|TakeOrdered|Window|Subquery|Filter|Generate|Union|Sort\b|AQEShuffleRead|BroadcastQueryStage|ShuffleQueryStage|Reused)")


def simplify(line: str) -> str:
    line = re.sub(r"#\d+L?", "", line)
    line = re.sub(r"\[plan_id=\d+\]", "", line)
    line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "", line)
    return line[:230]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 8)
    qs = queries()
    print("# Physical plans of the headline queries\n")
    print(f"Executed adaptive plans at `{sf}` on local[8], generated by `tools/plans.py`. Expression ids and")
    print("file locations are stripped and long lines cut. Domain tables are derived in the plan (see README).\n")
    for name in HEADLINE:
        df = qs[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [simplify(ln) for ln in plan.splitlines() if KEEP.search(ln)]
        print(f"## {name}\n\n```")
        print("\n".join(lines))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
