"""Physical plans of all registered queries, scanned for joins and exchanges that would not scale."""

from __future__ import annotations

import re


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def findings(plan: str) -> list[str]:
    found = [name for name in ("CartesianProduct", "BroadcastNestedLoopJoin") if name in plan]
    # A window without keys gathers every row in one task; a single partition below an aggregate holds partial sums.
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"Exchange SinglePartition", line):
            above = [x for x in lines[max(0, i - 3):i] if "Window" in x]
            # Running totals over one row per partition are such a summary.
            if above and "sum(_rows#" not in above[-1]:
                found.append("single-task window: " + above[-1].strip()[:160])
    return found


def broadcast_rows(df) -> list[int]:
    """Rows of each broadcast that the plan of ``df`` made when it ran."""
    df.collect()

    def walk(node) -> list[int]:
        kind = node.nodeName()
        if kind.startswith("AdaptiveSparkPlan"):
            below = [node.executedPlan()]
        elif kind.endswith("QueryStage"):
            below = [node.plan()]
        else:
            below = [node.children().apply(i) for i in range(node.children().size())]
        own = [node.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchange" else []
        return own + [n for x in below for n in walk(x)]

    return walk(df._jdf.queryExecution().executedPlan())
