"""Choosing session settings and join operators by a learned cost of the resulting plan."""

from __future__ import annotations

import base64
import io
import json
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.plans.runtime import PlanNode, execute, physical_plan, settings, with_joins
from planforge.sources.storage import read_text, write_text
from planforge.workload.executions import plan_from_json, plan_json

from .set_model import Adam

FRESH = {"spark.sql.adaptive.enabled": "false"}  # plans are compared as planned

#: Choices that an arm switches on; a plan needs one of each group.
JOINS = ("hash", "merge", "broadcast")
SCANS = {"pushdown": "spark.sql.parquet.filterPushdown", "vectorized": "spark.sql.parquet.enableVectorizedReader", "aggregate": "spark.sql.parquet.aggregatePushdown"}


@dataclass(frozen=True)
class Arm:
    """``joins``: the join operators that the arm leaves, put on the query's joins as hints; ``conf``: settings of its scans."""

    name: str
    conf: tuple[tuple[str, str], ...]
    joins: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        return with_joins(df, self.joins) if self.joins else df


def arms() -> list[Arm]:
    """Every non-empty set of join choices with every non-empty set of scan choices.

    Of hash and merge joins the planner itself would take merge joins, so that
    hash joins are taken only without them.  Index scans do not exist in Spark;
    the scan choices are its own counterparts.  The first arm has all on.
    """

    def subsets(names):
        return [tuple(n for n, b in zip(names, bits, strict=True) if b) for bits in product((1, 0), repeat=len(names)) if any(bits)]

    out = []
    for joins, scans in product(subsets(JOINS), subsets(list(SCANS))):
        conf = {key: str(name in scans).lower() for name, key in SCANS.items()}
        order = tuple(j for j in ("broadcast", "merge", "hash") if j in joins and not (j == "hash" and "merge" in joins))
        arm = Arm("+".join((*joins, *scans)), tuple(sorted(conf.items())), order)
        if all((a.conf, a.joins) != (arm.conf, arm.joins) for a in out):
            out.append(arm)
    return out


@dataclass
class PlanFeatures:
    """Node vectors: operator one-hot, log rows and log cost share, cached share."""

    operators: list[str]
    top_rows: float
    top_runtime: float

    @classmethod
    def fit(cls, plans: list[PlanNode], runtimes: list[float]) -> PlanFeatures:
        nodes = [n for p in plans for n in p.walk()]
        return cls(sorted({_kind(n) for n in nodes}), float(max([1.0, *(_rows(n) for n in nodes)])), float(max([1.0, *runtimes])))

    @property
    def width(self) -> int:
        return len(self.operators) + 2

    def node(self, n: PlanNode, cached: float = 0.0) -> np.ndarray:
        out = np.zeros(self.width)
        if _kind(n) in self.operators:
            out[self.operators.index(_kind(n))] = 1
        out[-2] = min(1.0, np.log1p(_rows(n)) / np.log1p(self.top_rows))
        out[-1] = cached if not n.children else 0.0
        return out

    def tree(self, plan: PlanNode, cached: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(node vectors with a zero row first, rows of (node, left, right)); one-sided nodes point to the zero row."""
        vectors, links = [np.zeros(self.width)], []

        def visit(n: PlanNode) -> int:
            me = len(vectors)
            vectors.append(self.node(n, cached))
            links.append([me, 0, 0])
            slot = len(links) - 1
            children = n.children[:2]
            for i, c in enumerate(children):
                links[slot][i + 1] = visit(c)
            for c in n.children[2:]:  # more than two children hang below the last
                visit(c)
            return me

        visit(plan)
        return np.array(vectors), np.array(links)

    def runtime(self, ms: float) -> float:
        return min(1.0, np.log1p(ms) / np.log1p(self.top_runtime))

    def milliseconds(self, y: float) -> float:
        return float(np.expm1(y * np.log1p(self.top_runtime)))


def _kind(n: PlanNode) -> str:
    return n.name.split(" ")[0]


def _rows(n: PlanNode) -> float:
    return float(n.estimate if n.estimate is not None else n.rows or 0)


@dataclass
class TreeModel:
    """Three convolutions over (node, left, right), maximum over nodes, two dense layers."""

    width: int
    channels: tuple[int, ...] = (256, 128, 64)
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.params:
            rng, size = np.random.default_rng(1), self.width
            for i, c in enumerate(self.channels):
                self.params[f"c{i}w"], self.params[f"c{i}b"] = rng.normal(0, np.sqrt(2 / (3 * size)), (3 * size, c)), np.zeros(c)
                size = c
            self.params["d0w"], self.params["d0b"] = rng.normal(0, np.sqrt(2 / size), (size, 32)), np.zeros(32)
            self.params["d1w"], self.params["d1b"] = rng.normal(0, np.sqrt(1 / 32), (32, 1)), np.zeros(1)

    def forward(self, tree: tuple[np.ndarray, np.ndarray]):
        x, links = tree
        p, keep = self.params, []
        for i in range(len(self.channels)):
            gathered = x[links].reshape(len(links), -1)
            z = gathered @ p[f"c{i}w"] + p[f"c{i}b"]
            keep.append((x, gathered, z))
            x = np.concatenate([np.zeros((1, z.shape[1])), np.maximum(z, 0.01 * z)])
        best = x[1:].argmax(axis=0)
        pooled = x[1:][best, np.arange(x.shape[1])]
        h = np.maximum(pooled @ p["d0w"] + p["d0b"], 0)
        return float((h @ p["d1w"] + p["d1b"])[0]), (keep, best, pooled, h, links)

    def gradients(self, cache, dy: float) -> dict[str, np.ndarray]:
        keep, best, pooled, h, links = cache
        p, g = self.params, {"d1w": dy * h[:, None], "d1b": np.array([dy])}
        dh = dy * p["d1w"][:, 0] * (h > 0)
        g["d0w"], g["d0b"] = np.outer(pooled, dh), dh
        dx = np.zeros((len(links) + 1, len(pooled)))
        dx[1 + best, np.arange(len(pooled))] = p["d0w"] @ dh
        for i in reversed(range(len(self.channels))):
            x, gathered, z = keep[i]
            dz = dx[1:] * np.where(z > 0, 1.0, 0.01)
            g[f"c{i}w"], g[f"c{i}b"] = gathered.T @ dz, dz.sum(axis=0)
            back = (dz @ p[f"c{i}w"].T).reshape(len(links), 3, x.shape[1])
            dx = np.zeros_like(x)
            np.add.at(dx, links.ravel(), back.reshape(-1, x.shape[1]))
            dx[0] = 0
        return g


class Experience:
    """The last ``window`` (plan, runtime) pairs; says when ``every`` new ones have come."""

    def __init__(self, window: int = 2000, every: int = 100) -> None:
        self.window, self.every, self.fresh = window, every, 0
        self.items: deque[tuple[PlanNode, float]] = deque(maxlen=window)

    def add(self, plan: PlanNode, ms: float) -> None:
        self.items.append((plan, ms))
        self.fresh += 1

    @property
    def due(self) -> bool:
        return self.fresh >= self.every

    def retrained(self) -> None:
        self.fresh = 0

    DDL = "seq long, plan string, runtime double"

    def store(self, spark: SparkSession, path: str) -> None:
        rows = [(i, json.dumps(plan_json(p)), float(ms)) for i, (p, ms) in enumerate(self.items)]
        spark.createDataFrame(rows, self.DDL).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, window: int = 2000, every: int = 100) -> Experience:
        out = cls(window, every)
        for r in sorted(spark.read.parquet(path).orderBy(F.desc("seq")).limit(window).collect()):
            out.items.append((plan_from_json(json.loads(r.plan)), r.runtime))
        return out


class PlanChooser:
    """Plans a query under each arm, predicts each plan's runtime, and takes the least."""

    def __init__(self, spark: SparkSession, choices: list[Arm] | None = None, *, window: int = 2000, every: int = 100, epochs: int = 100, rate: float = 1e-3, batch: int = 16) -> None:
        self.spark, self.arms = spark, choices or arms()[:5]
        self.experience = Experience(window, every)
        self.epochs, self.rate, self.batch = epochs, rate, batch
        self.features: PlanFeatures | None = None
        self.model: TreeModel | None = None
        self.losses: list[float] = []

    def plans(self, query: Callable[[], DataFrame]) -> list[PlanNode]:
        out = []
        for arm in self.arms:
            with settings(self.spark, FRESH | dict(arm.conf)):
                out.append(physical_plan(arm.apply(query())))
        return out

    def predict(self, plan: PlanNode) -> float:
        """Milliseconds; infinite before the first training."""
        if self.model is None:
            return float("inf")
        return self.features.milliseconds(max(0.0, self.model.forward(self.features.tree(plan))[0]))

    def choose(self, query: Callable[[], DataFrame]) -> Arm:
        costs = [self.predict(p) for p in self.plans(query)]
        return self.arms[int(np.argmin(costs))]

    def run(self, query: Callable[[], DataFrame], arm: Arm | None = None, *, timeout: float | None = None, rows: bool = True):
        """Executes under an arm (the chosen one) and learns from it; a run that timed out has no known runtime and is not learned.

        ``rows``: see :func:`planforge.plans.runtime.execute`.
        """
        arm = arm or self.choose(query)
        with settings(self.spark, FRESH | dict(arm.conf)):
            df = arm.apply(query())
            plan = physical_plan(df)
            done = execute(df, timeout=timeout, rows=rows)
        if not done.timed_out:
            self.add(plan, done.seconds * 1000)
        return arm, done

    def add(self, plan: PlanNode, ms: float) -> None:
        self.experience.add(plan, ms)
        if self.experience.due:
            self.train()

    def calibrate(self, workload: list[Callable[[], DataFrame]], *, timeout: float | None = None) -> None:
        """Each query under each arm, then one training."""
        every, self.experience.every = self.experience.every, float("inf")
        for q in workload:
            for arm in self.arms:
                self.run(q, arm, timeout=timeout, rows=False)
        self.experience.every = every
        self.train()

    def calibrate_from(self, samples: list[tuple[PlanNode, float]]) -> None:
        """Learns from executions recorded before (plan, milliseconds), then one training; nothing is run."""
        for plan, ms in samples:
            self.experience.add(plan, ms)
        self.train()

    def train(self, seed: int = 0) -> None:
        plans, ms = zip(*self.experience.items, strict=True)
        self.features = PlanFeatures.fit(list(plans), list(ms))
        self.model = TreeModel(self.features.width)
        trees, target = [self.features.tree(p) for p in plans], np.array([self.features.runtime(m) for m in ms])
        rng, adam, self.losses = np.random.default_rng(seed), Adam(self.model.params, self.rate), []
        for _ in range(self.epochs):
            total = 0.0
            for at in np.array_split(rng.permutation(len(trees)), max(1, -(-len(trees) // self.batch))):
                grads: dict[str, np.ndarray] = {}
                for i in at:
                    y, cache = self.model.forward(trees[i])
                    total += (y - target[i]) ** 2
                    for k, g in self.model.gradients(cache, 2 * (y - target[i]) / len(at)).items():
                        grads[k] = grads.get(k, 0) + g
                adam.step(grads)
            self.losses.append(total / len(trees))
        self.experience.retrained()

    def store(self, path: str) -> None:
        self.experience.store(self.spark, f"{path}/experience")
        raw = io.BytesIO()
        np.savez_compressed(raw, **(self.model.params if self.model else {}))
        f = self.features
        write_text(self.spark, f"{path}/model.json", json.dumps({"arms": [[a.name, list(map(list, a.conf)), list(a.joins)] for a in self.arms], "features": [f.operators, f.top_rows, f.top_runtime] if f else None, "weights": base64.b64encode(raw.getvalue()).decode()}))

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> PlanChooser:
        d = json.loads(read_text(spark, f"{path}/model.json"))
        out = cls(spark, [Arm(n, tuple(map(tuple, c)), tuple(j)) for n, c, j in d["arms"]], **options)
        out.experience = Experience.load(spark, f"{path}/experience", out.experience.window, out.experience.every)
        if d["features"]:
            out.features = PlanFeatures(*d["features"])
            with np.load(io.BytesIO(base64.b64decode(d["weights"]))) as z:
                out.model = TreeModel(out.features.width, params={k: z[k] for k in z.files})
        return out
