"""Sums a metric over the nodes of an executed plan."""


def _nodes(plan):
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def metric(df, node: str, name: str) -> int:
    """The metric's sum over plan nodes whose name holds ``node``, after ``df`` was run."""
    total = 0
    for p in _nodes(df._jdf.queryExecution().executedPlan()):
        label = p.nodeName().replace(" ", "").replace("Scanparquet", "FileScan")
        if node in label and p.metrics().contains(name):
            total += p.metrics().apply(name).value()
    return total
