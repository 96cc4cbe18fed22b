"""Searching the fastest hint set of each query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from planforge.plans.runtime import execute, plan_key, settings, with_joins

from .hints import CORE, Hint, HintSet

DDL = "query_name string, hint_set_int long, time double, level int, opt boolean, timeout boolean, chosen boolean, removed string, seen_plan boolean, plan string"


@dataclass
class Trial:
    query: str
    hints: HintSet
    seconds: float
    level: int
    optimal: bool = False
    timed_out: bool = False
    seen_plan: bool = False
    plan: str = ""
    removed: str | None = None


@dataclass
class Experience:
    """How often switching a hint off helped, over all queries; decides what is tried first."""

    better: dict[str, int] = field(default_factory=dict)
    used: dict[str, int] = field(default_factory=dict)

    def note(self, hint: str, helped: bool) -> None:
        self.used[hint] = self.used.get(hint, 0) + 1
        self.better[hint] = self.better.get(hint, 0) + helped

    def ratio(self, hint: str, smoothing: float = 1.0) -> float:
        return (self.better.get(hint, 0) + smoothing) / (self.used.get(hint, 0) + 2 * smoothing)


@dataclass(frozen=True)
class Search:
    baseline_timeout: float = 150.0
    levels: int = 4
    patience: int = 2  # levels without a gain before the search ends
    slack: float = 1.2  # a trial may take this times the best so far,
    least: float = 0.5  # and at least so many seconds
    repeat: int = 1


def label_query(spark: SparkSession, name: str, query: Callable[[], DataFrame], *, library: tuple[Hint, ...] = CORE, search: Search = Search(), experience: Experience | None = None) -> list[Trial]:
    """Breadth-first from all hints on, one more off at each level.

    Only the best set of a level is taken further.  A plan that was seen
    before is not run again; trials are cut off shortly beyond the best.
    """
    experience = experience or Experience()
    seen: dict[str, Trial] = {}

    def attempt(hints: HintSet, level: int, timeout: float, removed: str | None) -> Trial:
        with settings(spark, {"spark.sql.adaptive.enabled": "false"} | hints.conf()):
            df = with_joins(query(), hints.joins())
            key = plan_key(df)
            if key in seen:
                old = seen[key]
                return Trial(name, hints, old.seconds, level, False, old.timed_out, True, key, removed)
            done = execute(df, timeout=timeout, repeat=search.repeat, rows=False)
        seen[key] = Trial(name, hints, done.seconds, level, False, done.timed_out, False, key, removed)
        return seen[key]

    best = attempt(HintSet.all_on(library), 0, search.baseline_timeout, None)
    trials, front, idle = [best], best.hints, 0
    for level in range(1, search.levels + 1):
        found = None
        order = sorted(front.neighbours(), key=lambda h: -experience.ratio(next(iter(set(h.disabled()) - set(front.disabled())))))
        for hints in order:
            removed = next(iter(set(hints.disabled()) - set(front.disabled())))
            trial = attempt(hints, level, max(search.least, search.slack * best.seconds), removed)
            trials.append(trial)
            helped = not trial.timed_out and trial.seconds < best.seconds
            experience.note(removed, helped)
            if not trial.timed_out and (found is None or trial.seconds < found.seconds):
                found = trial
            if helped:
                best = trial
        if found is None:
            break
        idle = 0 if best.level == level else idle + 1
        if idle >= search.patience:
            break
        front = found.hints
    best.optimal = True
    return trials


def label_workload(spark: SparkSession, queries: dict[str, Callable[[], DataFrame]], **options) -> list[Trial]:
    experience = options.pop("experience", None) or Experience()
    return [t for name, q in queries.items() for t in label_query(spark, name, q, experience=experience, **options)]


def trials_frame(spark: SparkSession, trials: list[Trial]) -> DataFrame:
    return spark.createDataFrame([(t.query, t.hints.bits, t.seconds, t.level, t.optimal, t.timed_out, t.optimal, t.removed, t.seen_plan, t.plan) for t in trials], DDL)


def best_labels(trials: DataFrame) -> DataFrame:
    """(query_name, hint_set_int, time): the chosen run of each query."""
    from pyspark.sql import functions as F

    best = trials.where("not timeout and opt").groupBy("query_name").agg(F.min(F.struct("time", "hint_set_int")).alias("m"))
    return best.select("query_name", "m.hint_set_int", "m.time")
