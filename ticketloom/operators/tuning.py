"""Searching clustering parameters: the grid, seeded random search, a tree of Parzen estimators, selection of the best run."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Space:
    # The ranges that are searched.
    n_neighbors: tuple[int, ...] = tuple(range(5, 51, 5))
    n_components: tuple[int, ...] = tuple(range(3, 16, 2))
    min_cluster_size: tuple[int, ...] = tuple(range(5, 31, 5))

    def axes(self) -> dict[str, tuple[int, ...]]:
        return {"n_neighbors": self.n_neighbors, "n_components": self.n_components, "min_cluster_size": self.min_cluster_size}


# Bounds of the label count, the penalty outside them, the loss of a failed trial.
LOWER, UPPER, PENALTY, FAILED = 10, 75, 0.15, 999.0
Score = Callable[[dict], tuple[int, float]]


#: What makes a trial fail: values that a configuration cannot take, numbers out of range, errors of Spark or of the machine.
#: Errors of programming, such as a wrong name or type, end the search.
FAILURES = (ValueError, ArithmeticError, RuntimeError, OSError, PySparkException, Py4JError)


class TooLarge(ValueError):
    """The table has more rows than the scored operator takes; no configuration can succeed, so the search ends with it."""


def grid(spark: SparkSession, space: Space = Space()) -> DataFrame:
    """Every configuration: explodes of literal arrays on one row, no join."""
    df = spark.range(1)
    for name, values in space.axes().items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df.drop("id")


def loss(cost: Column, label_count: Column, lower: int = LOWER, upper: int = UPPER) -> Column:
    return cost + F.when(label_count.between(lower, upper), F.lit(0.0)).otherwise(F.lit(PENALTY))


def select_best(trials: DataFrame, cost: str, id_col: str, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """The one run of least cost within the bounds, else of all; ties go to the smaller id, runs without a cost take no part."""
    inside = F.coalesce(F.col("label_count").between(lower, upper), F.lit(False))
    ran = trials.where(F.col(cost).isNotNull())
    return ran.orderBy(inside.desc(), F.col(cost), F.col(id_col)).limit(1)


@dataclass
class Search:
    best: dict | None = None
    trials: list[dict] = field(default_factory=list)
    #: Seconds of each trial, by its number; apart from the trials, which are the same in every run.
    eval_times: dict[int, float] = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        """The trials with their eval_time; without trials an empty table."""
        if not self.trials:
            return spark.createDataFrame([], "run_id int, eval_time double")
        key = next(iter(self.trials[0]))
        names = [*self.trials[0], "eval_time"]
        return spark.createDataFrame([(*t.values(), self.eval_times.get(t[key])) for t in self.trials], names)


def random_search(score: Score, evals: int = 30, space: Space = Space(), lower: int = LOWER, upper: int = UPPER, seed: int = 42) -> Search:
    """`evals` configurations drawn with replacement; failed ones are skipped."""
    rng = random.Random(seed)
    out = Search()
    for run in range(evals):
        params = {k: rng.choice(v) for k, v in space.axes().items()}
        began = time.perf_counter()
        try:
            count, cost = score(params)
        except TooLarge:
            raise
        except FAILURES:
            continue
        out.eval_times[run] = time.perf_counter() - began
        out.trials.append({"run_id": run, **params, "label_count": count, "cost": cost})
    inside = [t for t in out.trials if lower <= t["label_count"] <= upper] or out.trials
    out.best = min(inside, key=lambda t: (t["cost"], t["run_id"]), default=None)
    return out


def bayesian_search(score: Score, evals: int = 30, space: Space = Space(), lower: int = LOWER, upper: int = UPPER, seed: int = 42, startup: int = 10, gamma: float = 0.25, draws: int = 24) -> Search:
    """A tree of Parzen estimators over the grid: after `startup` random trials, of `draws` configurations drawn from the
    density of the best `gamma` share the one of greatest ratio to the density of the rest is tried."""
    rng = random.Random(seed)
    axes = space.axes()
    out = Search()

    def weights(name: str, trials: list[dict]) -> list[float]:
        values = axes[name]
        w = [1.0] * len(values)  # a prior of one trial a value
        for t in trials:
            at = values.index(t[name])
            for i in range(len(values)):  # neighbours on the axis share a trial's weight
                w[i] += 0.5 ** abs(i - at)
        total = sum(w)
        return [x / total for x in w]

    for trial in range(evals):
        done = sorted(out.trials, key=lambda t: (t["loss"], t["trial_id"]))
        if trial < startup or len(done) < 4:
            params = {k: rng.choice(v) for k, v in axes.items()}
        else:
            cut = max(1, round(gamma * len(done)))
            good, rest = done[:cut], done[cut:]
            best_ratio, params = -1.0, {}
            dens = {k: (weights(k, good), weights(k, rest)) for k in axes}
            for _ in range(draws):
                at = {k: rng.choices(range(len(v)), dens[k][0])[0] for k, v in axes.items()}
                ratio = 1.0
                for k, i in at.items():
                    ratio *= dens[k][0][i] / dens[k][1][i]
                if ratio > best_ratio:
                    best_ratio, params = ratio, {k: axes[k][i] for k, i in at.items()}
        began = time.perf_counter()
        try:
            count, cost = score(params)
            value, status = cost + (0.0 if lower <= count <= upper else PENALTY), "ok"
        except TooLarge:
            raise
        except FAILURES:
            count, value, status = 0, FAILED, "fail"
        out.eval_times[trial] = time.perf_counter() - began
        out.trials.append({"trial_id": trial, **params, "label_count": count, "loss": value, "status": status})
    ok = [t for t in out.trials if t["status"] == "ok"]
    out.best = min(ok, key=lambda t: (t["loss"], t["trial_id"]), default=None)
    return out


def tune(method: str, score: Score, **options) -> Search:
    if method not in ("random", "bayesian"):
        raise ValueError("method must be random or bayesian")
    return (random_search if method == "random" else bayesian_search)(score, **options)
