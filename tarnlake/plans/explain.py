"""Plans as text, before and after a run."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tarnlake.plans.analyzer import Bound
from tarnlake.plans.ast import show
from tarnlake.plans.estimate import Estimates


def dialect_plan(b: Bound, guess: Estimates | None = None) -> str:
    """The operators of a statement, the last to run first, with estimated rows if given."""
    est = lambda x: "" if guess is None or x is None else f"  est={x:.0f}"
    lines = []
    if b.limit is not None:
        lines.append(f"Limit({b.limit}){est(guess and guess.result)}")
    if b.distinct:
        lines.append("Distinct")
    lines.append(f"Project({', '.join(b.names)})")
    if b.order_by:
        lines.append(f"Sort({', '.join(show(o.expr) + (' DESC' if o.descending else ' ASC') for o in b.order_by)})")
    if b.having:
        lines.append(f"Filter({show(b.having)}) [having]{est(guess and guess.having)}")
    if b.grouped:
        lines.append(f"Aggregate(keys=[{', '.join(map(show, b.keys))}], values=[{', '.join(map(show, b.aggregates()))}]){est(guess and guess.aggregate)}")
    if b.where:
        lines.append(f"Filter({show(b.where)}){est(guess and guess.filter)}")
    if b.join:
        lines.append(f"Join({show(b.join[0])} = {show(b.join[1])}){est(guess and guess.join)}")
    scans = [f"Scan({r.table}{f' AS {r.alias}' if r.alias else ''}: {', '.join(sorted({x.name for x in b.refs() if x.slot == i})) or 'no columns'}){est(guess and guess.scans[i])}" for i, r in enumerate(b.relations)]
    out = [f"{'  ' * depth}{line}" for depth, line in enumerate(lines)]
    return "\n".join(out + [f"{'  ' * len(lines)}{s}" for s in scans])


def explain(b: Bound, df: DataFrame, guess: Estimates | None = None) -> str:
    """The dialect's plan, Catalyst's optimized plan and the physical plan; nothing runs."""
    q = df._jdf.queryExecution()
    sections = (("Logical plan", dialect_plan(b, guess)), ("Optimized plan", q.optimizedPlan().toString()), ("Physical plan", q.executedPlan().toString()))
    return "\n".join(f"== {title} ==\n{text.rstrip()}\n" for title, text in sections)


@dataclass(frozen=True)
class Measured:
    """An operator as it ran; ``rows`` is None where Spark keeps no count."""

    depth: int
    name: str
    rows: int | None
    millis: float | None
    estimate: int | None


#: Spark's names for the time that an operator took itself, in milliseconds or nanoseconds.
_TIMES = {"scanTime": 1, "aggTime": 1, "sortTime": 1, "buildTime": 1, "broadcastTime": 1, "pipelineTime": 1, "shuffleWriteTime": 1e-6}


def measured(df: DataFrame) -> list[Measured]:
    """Operators of the plan that an action on ``df`` ran, with Spark's own metrics."""
    out: list[Measured] = []

    def visit(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return visit(node.executedPlan(), depth)
        if name.startswith(("WholeStageCodegen", "InputAdapter", "ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage")):
            inner = node.plan() if "QueryStage" in name else node.children().apply(0)
            return visit(inner, depth)
        metrics, found = node.metrics(), {}
        keys = metrics.keysIterator()
        while keys.hasNext():
            k = keys.next()
            found[k] = metrics.apply(k).value()
        times = [found[k] * scale for k, scale in _TIMES.items() if found.get(k, -1) >= 0]
        link = node.logicalLink()
        guess = link.get().stats().rowCount() if link.isDefined() else None
        estimate = int(str(guess.get())) if guess is not None and guess.isDefined() else None
        out.append(Measured(depth, name, found.get("numOutputRows"), sum(times) if times else None, estimate))
        below = node.children()
        for i in range(below.size()):
            visit(below.apply(i), depth + 1)

    visit(df._jdf.queryExecution().executedPlan(), 0)
    return out


def explain_analyze(df: DataFrame, parse_ms: float, plan_ms: float) -> tuple[int, str]:
    """Run ``df``; the number of its rows, which are not kept, and a line for each operator with rows out, estimate and own time."""
    began = time.perf_counter()
    rows = sum(1 for _ in df.toLocalIterator())
    took = (time.perf_counter() - began) * 1000
    nodes = measured(df)
    total = sum(n.millis or 0 for n in nodes) or 1.0
    lines = []
    for i, n in enumerate(nodes):
        below = [m.rows for m in nodes[i + 1 :] if m.rows is not None and m.depth > n.depth][:1]
        parts = [f"rows_in={below[0] if below else '-'}", f"rows_out={'-' if n.rows is None else n.rows}", f"est={'-' if n.estimate is None else n.estimate}"]
        parts.append("time=-" if n.millis is None else f"time={n.millis:.1f}ms ({100 * n.millis / total:.1f}%)")
        lines.append(f"{'  ' * n.depth}{n.name}  {' '.join(parts)}")
    return rows, "\n".join([*lines, f"parse={parse_ms:.1f}ms plan={plan_ms:.1f}ms execute={took:.1f}ms"])
