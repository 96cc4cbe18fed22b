"""Executing plans under settings and limits, and reading what Spark planned and measured."""

from __future__ import annotations

import contextlib
import hashlib
import re
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class PlanNode:
    """An operator of a physical plan: children, rows (None before execution) and other metrics."""

    name: str
    detail: str
    children: list[PlanNode] = field(default_factory=list)
    rows: int | None = None
    metrics: dict[str, int] = field(default_factory=dict)
    estimate: float | None = None

    def walk(self) -> Iterator[PlanNode]:
        yield self
        for c in self.children:
            yield from c.walk()

    @property
    def is_join(self) -> bool:
        return "Join" in self.name or "CartesianProduct" in self.name


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _unwrap(node):
    """Follows adaptive plans and finished query stages to the plan inside."""
    while True:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        elif kind.endswith("QueryStageExec"):
            node = node.plan()
        elif kind in ("InputAdapter", "WholeStageCodegenExec"):
            node = node.child()
        else:
            return node


def _read(node) -> PlanNode:
    node = _unwrap(node)
    metrics, it = {}, node.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        metrics[pair._1()] = int(pair._2().value())
    link = node.logicalLink()
    estimate = None
    if link.isDefined():
        rows = link.get().stats().rowCount()
        estimate = float(str(rows.get())) if rows.isDefined() else None
    out = PlanNode(node.nodeName(), node.simpleString(200), [_read(c) for c in _seq(node.children())], metrics.get("numOutputRows"), metrics, estimate)
    return out


def physical_plan(df: DataFrame) -> PlanNode:
    """The plan as it stands: initial before execution, final after."""
    return _read(df._jdf.queryExecution().executedPlan())


def plan_key(df: DataFrame) -> str:
    """Hash of the plan before adaptive execution, without expression numbers: equal plans have equal keys.

    Settings that change how a plan runs but not its text count as well: code
    generation, and filter pushdown where a scan has filters.
    """
    text = re.sub(r"#\d+L?|plan_id=\d+|\[id=.*?\]", "", df._jdf.queryExecution().sparkPlan().toString())
    conf = df.sparkSession.conf
    text += conf.get("spark.sql.codegen.wholeStage")
    if re.search(r"PushedFilters: \[[^\]]", text):
        text += conf.get("spark.sql.parquet.filterPushdown")
    return hashlib.sha256(text.encode()).hexdigest()


#: What a row costs by operator in the cost formula below; joins differ by what they must build.
ROW_COST = {"SortMergeJoin": 2.0, "ShuffledHashJoin": 1.5, "BroadcastHashJoin": 1.0, "CartesianProduct": 4.0, "BroadcastNestedLoopJoin": 4.0, "Exchange": 1.0, "Sort": 1.0}
BYTE_COST = 1e-3


def plan_cost(node: PlanNode) -> float:
    """Rows out of each operator times its weight, plus shuffled bytes: Spark has no cost of its own."""
    own = ROW_COST.get(node.name.split(" ")[0], 0.5) * (node.rows or 0) + BYTE_COST * node.metrics.get("shuffleBytesWritten", 0)
    return own + sum(plan_cost(c) for c in node.children)


STRATEGIES = {"hash": "SHUFFLE_HASH$", "merge": "SHUFFLE_MERGE$", "broadcast": "BROADCAST$"}
SMALL_SIDE = 10 << 20  # bytes up to which a side may be broadcast by choice


def with_joins(df: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """The query with a hint on each equi-join: one of ``allowed``, in order of preference.

    A join is broadcast if that is allowed and the planner's estimate of a side
    is at most ``SMALL_SIDE`` bytes, or if nothing else is allowed; otherwise
    the first of the others is taken.  Hints that are written in the query stay.
    """
    spark = df.sparkSession
    jvm, logical = spark._jvm, "org.apache.spark.sql.catalyst.plans.logical."
    others = [a for a in allowed if a != "broadcast"]

    def module(name: str):
        return getattr(jvm.java.lang.Class.forName(logical + name, True, jvm.java.lang.Thread.currentThread().getContextClassLoader()).getField("MODULE$"), "get")(None)

    def size(plan) -> int:
        return int(str(plan.stats().sizeInBytes()))

    def hint(name: str, left: bool, right: bool):
        info = jvm.scala.Some(getattr(jvm, logical + "HintInfo")(jvm.scala.Some(module(STRATEGIES[name]))))
        none = getattr(jvm.scala, "None$").__getattr__("MODULE$")
        return getattr(jvm, logical + "JoinHint")(info if left else none, info if right else none)

    def chosen(join):
        sizes = size(join.left()), size(join.right())
        if "broadcast" in allowed and (min(sizes) <= SMALL_SIDE or not others):
            return hint("broadcast", sizes[0] < sizes[1], sizes[0] >= sizes[1])
        return hint(others[0], True, True)

    def rewrite(plan):
        children = plan.children()
        if children.size():
            new = [rewrite(children.apply(i)) for i in range(children.size())]
            plan = plan.withNewChildren(jvm.scala.jdk.javaapi.CollectionConverters.asScala(new).toSeq())
        if plan.getClass().getSimpleName() == "Join" and plan.condition().isDefined() and not plan.hint().leftHint().isDefined() and not plan.hint().rightHint().isDefined():
            plan = plan.copy(plan.left(), plan.right(), plan.joinType(), plan.condition(), chosen(plan))
        return plan

    plan = rewrite(df._jdf.queryExecution().analyzed())
    return DataFrame(getattr(jvm, "org.apache.spark.sql.classic.Dataset").ofRows(spark._jsparkSession, plan), spark)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass
class Execution:
    rows: list | None
    seconds: float
    timed_out: bool
    plan: PlanNode | None


def _small(df: DataFrame) -> bool:
    """Whether the result has one row by its shape: an aggregate without groups."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.maxRows().isDefined() and int(str(plan.maxRows().get())) <= MOST_ROWS


MOST_ROWS = 10_000  # of a result that come to the driver


def execute(df: DataFrame, *, timeout: float | None = None, repeat: int = 1, rows: bool = True) -> Execution:
    """Runs a query ``repeat`` times and takes the median time.

    With ``rows`` up to ``MOST_ROWS`` rows come to the driver, and a larger
    result is an error; without, the whole result is computed where it is and
    dropped.  With a timeout the query's jobs are cancelled when it has passed.
    """
    sc, times, got = df.sparkSession.sparkContext, [], None
    for _ in range(repeat):
        group, fired = f"planforge-{uuid.uuid4().hex}", threading.Event()
        timer = None
        if timeout is not None:

            def stop(group=group, fired=fired):
                fired.set()
                sc.cancelJobGroup(group)

            timer = threading.Timer(timeout, stop)
            timer.daemon = True
        sc.setJobGroup(group, "planforge", True)
        began = time.monotonic()
        try:
            if timer:
                timer.start()
            if rows:
                got = df.collect() if _small(df) else df.take(MOST_ROWS + 1)
            else:
                df.write.format("noop").mode("overwrite").save()
        except Exception:
            if fired.is_set():
                return Execution(None, time.monotonic() - began, True, None)
            raise
        finally:
            if timer:
                timer.cancel()
            sc._jsc.clearJobGroup()
        times.append(time.monotonic() - began)
    if got is not None and len(got) > MOST_ROWS:
        raise ValueError(f"the result has more than {MOST_ROWS} rows; run it with rows=False")
    return Execution(got, sorted(times)[len(times) // 2], False, physical_plan(df))
