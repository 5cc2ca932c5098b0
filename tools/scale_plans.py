"""Print the physical plan shape of every registered query as it would be at
scale: Spark's size-checked auto-broadcast is kept but with a threshold so
low that only a fixed-size dimension (the 25-row nation table) qualifies -
at 100 TB no account-, subscription- or usage-sized side is small - and AQE
is off so the static plan is shown.

Per query: shuffle exchanges, sort-merge joins, broadcast exchanges,
nested-loop / cartesian joins (must be 0), windows without partitioning
(allowed only over month/segment-sized inputs), Python UDF nodes (must be 0).

usage: python tools/scale_plans.py [sf_dir] [name ...] [--show]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.plans.registry import QUERIES  # noqa: E402
from cohortlens.session import local_session  # noqa: E402

SCALE_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "8KB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "8KB",
    "spark.sql.adaptive.enabled": "false",
}


def shape(plan: str) -> dict:
    lines = plan.splitlines()
    own = [ln for ln in lines if "ReusedExchange" not in ln]
    shuffle = re.compile(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)")
    return {
        "shuffles": sum(bool(shuffle.search(ln)) for ln in own),
        "reused": sum("ReusedExchange" in ln for ln in lines),
        "smj": plan.count("SortMergeJoin"),
        "bcast": sum("BroadcastExchange" in ln for ln in own),
        "nlj_or_cartesian": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "single_partition_exchanges": sum("Exchange SinglePartition" in ln for ln in own),
        "python": len(re.findall(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas",
                                 plan)),
    }


def main():
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    markdown = "--markdown" in sys.argv
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = local_session(8, 8, extra=SCALE_CONF)
    for k, v in SCALE_CONF.items():
        spark.conf.set(k, v)
    if markdown:
        print("| query | shuffle exchanges | of which single-partition | reused exchanges | "
              "sort-merge joins | broadcasts | nested-loop / cartesian | Python nodes |")
        print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        sh = shape(plan)
        if markdown:
            print(f"| `{name}` | {sh['shuffles']} | {sh['single_partition_exchanges']} | {sh['reused']} | "
                  f"{sh['smj']} | "
                  f"{sh['bcast']} | {sh['nlj_or_cartesian']} | {sh['python']} |")
        else:
            print(f"{name:28s} {sh}")
        if "--show" in sys.argv:
            print(plan)


if __name__ == "__main__":
    main()
