"""Dev tool: write the physical-plan skeleton of the headline queries to PLANS.md.

Usage: python tools/plans.py [sf_dir]
Keeps the operator lines of ``explain()`` (scans with their pushed filters and
read schema, exchanges, joins, aggregates, windows, Python steps).
"""

from __future__ import annotations

import re
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from webtext.plans import queries as Q  # noqa: E402
from webtext.session import build_session  # noqa: E402

KEYS = ["page_record", "extract_batch", "top_keywords", "extractive_summary", "session_turns",
        "validate_calls", "answer_requests", "extract_metrics", "extract_batch_as_of", "top_keywords_salted",
        "host_sketches", "extract_rollup", "snapshot_difference"]
KEEP = re.compile(r"Scan|Exchange|Join|Aggregate|Window|MapInArrow|ArrowEvalPython|Generate|Filter|PushedFilters|ReadSchema|Reused")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=16)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/plans.py` on `{sf}` (adaptive execution's initial plan; at run time it may",
           "turn a sort-merge join into a broadcast when a measured side is small, and split skewed partitions).", ""]
    for k in KEYS:
        df = Q.QUERIES[k](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [ln.rstrip() for ln in plan.split("\n") if KEEP.search(ln)]
        lines = [re.sub(r"#\d+L?", "", ln)[:200] for ln in lines]
        out += [f"## {k}", "", "```", *lines, "```", ""]
    open("PLANS.md", "w").write("\n".join(out))
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
