"""Physical-plan checks used by the tests (plan review, SURVEY §7.2 step 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame

_STAGE_WRAPPERS = ("ShuffleQueryStageExec", "BroadcastQueryStageExec",
                   "TableCacheQueryStageExec", "ResultQueryStageExec")


def _walk(node):
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _walk(node.executedPlan())
        return
    if name in _STAGE_WRAPPERS:
        yield from _walk(node.plan())
        return
    yield node
    kids = node.children()
    for i in range(kids.size()):
        yield from _walk(kids.apply(i))


def plan_nodes(df: DataFrame) -> list:
    """Physical operators of the (final, if executed) plan of ``df``."""
    return list(_walk(df._jdf.queryExecution().executedPlan()))


def plan_problems(df: DataFrame) -> list[str]:
    """Python evaluation nodes and windows without a partition spec."""
    out = []
    for node in plan_nodes(df):
        name = node.getClass().getSimpleName()
        if "Python" in name or "InPandas" in name:
            out.append(f"python operator {name}")
        if name == "WindowExec" and node.partitionSpec().isEmpty():
            out.append("window over one global partition")
    return out
