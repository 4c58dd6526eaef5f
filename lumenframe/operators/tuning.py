"""Guided model search: a tree-structured Parzen sampler, a median stop after each fold, and a store of trials.

Trials run in batches, a batch fold by fold, or several folds at once: what a stopped trial found behind its stop is then
dropped. The results of each fold are written to the store as one folder; a search that was cut off reads the folders that
are whole and goes on behind them. What a trial draws depends only on the seed and on
finished trials of earlier batches, so a search that goes on ends like one that was never cut off.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TRIALS = 30
BATCH = 10
#: Trials drawn at random before the sampler has enough to go by.
STARTUP = 10
CANDIDATES = 24
#: The median stop waits for so many whole trials.
LEAST_WHOLE = 5

#: The model space. (kind, low, high) of each number; conditional on the model.
SPACE = {
    "random_forest": {"rf_n_estimators": ("int", 100, 800), "rf_max_depth": ("int", 3, 30)},
    "lightgbm": {"lgbm_learning_rate": ("log", 0.005, 0.3), "lgbm_n_estimators": ("int", 100, 1200)},
    "xgboost": {"xgb_n_estimators": ("int", 100, 1000), "xgb_max_depth": ("int", 3, 10),
                "xgb_learning_rate": ("float", 0.01, 0.3)},
    "logistic_regression": {"lr_c": ("log", 0.001, 10.0)},
}
STORE = "batch int, trial int, params string, fold int, hits double, rows double, stopped boolean"


# Sampler -------------------------------------------------------------------------------------------------------

@dataclass
class Parzen:
    """A mixture of normal distributions cut off at the ends of a range: one per value seen, as wide as the larger gap to its
    neighbours, and one over the whole range."""

    low: float
    high: float
    centres: list[float]
    widths: list[float] = field(init=False)

    def __post_init__(self):
        span = self.high - self.low
        self.centres = sorted(self.centres)
        near = [self.low, *self.centres, self.high]
        least = span / min(100.0, 1.0 + len(self.centres))
        self.widths = [min(span, max(least, near[i] - near[i - 1], near[i + 1] - near[i])) for i in range(1, len(near) - 1)]
        self.centres = [*self.centres, (self.low + self.high) / 2]
        self.widths.append(span)

    def density(self, x: float) -> float:
        total = 0.0
        for c, s in zip(self.centres, self.widths):
            inside = _normal((self.high - c) / s) - _normal((self.low - c) / s)
            total += math.exp(-0.5 * ((x - c) / s) ** 2) / (s * math.sqrt(2 * math.pi) * inside)
        return total / len(self.centres)

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.centres))
        while True:
            x = rng.gauss(self.centres[i], self.widths[i])
            if self.low <= x <= self.high:
                return x


def _normal(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def _inner(kind: str, value: float) -> float:
    return math.log(value) if kind == "log" else float(value)


def _range(spec: tuple) -> tuple[float, float]:
    kind, low, high = spec
    if kind == "int":
        return low - 0.5, high + 0.5
    return _inner(kind, low), _inner(kind, high)


def _outer(spec: tuple, x: float):
    kind, low, high = spec
    if kind == "int":
        return min(high, max(low, round(x)))
    return min(high, max(low, math.exp(x) if kind == "log" else x))


def random_params(rng: random.Random, model: str | None = None) -> dict:
    model = model or rng.choice(list(SPACE))
    return {"model_name": model} | {name: _outer(spec, rng.uniform(*_range(spec))) for name, spec in SPACE[model].items()}


def split_good(finished: list[tuple[dict, float]]) -> tuple[list[dict], list[dict]]:
    """The best tenth of the finished trials (25 at most), and the others. Ties go to the earlier trial."""
    order = sorted(range(len(finished)), key=lambda i: (-finished[i][1], i))
    n = min(25, math.ceil(0.1 * len(finished)))
    return [finished[i][0] for i in order[:n]], [finished[i][0] for i in order[n:]]


def choice_weights(options: list[str], seen: list[str]) -> dict[str, float]:
    """Shares of the options among those seen, each counted once more."""
    total = len(seen) + len(options)
    return {o: (seen.count(o) + 1) / total for o in options}


def propose(trial: int, seed: int, finished: list[tuple[dict, float]]) -> dict:
    """Parameters of a trial: of some candidates drawn from the density of good trials the one with the largest ratio to the
    density of the others, for each parameter on its own. The first trials take the models in turn, at random values."""
    rng = random.Random(f"{seed}-{trial}")
    models = list(SPACE)
    if len(finished) < STARTUP:
        return random_params(rng, models[trial] if trial < len(models) else None)
    good, bad = split_good(finished)
    a, b = (choice_weights(models, [p["model_name"] for p in part]) for part in (good, bad))
    drawn = rng.choices(models, [a[m] for m in models], k=CANDIDATES)
    model = max(drawn, key=lambda m: a[m] / b[m])
    params = {"model_name": model}
    for name, spec in SPACE[model].items():
        low, high = _range(spec)
        above, below = (Parzen(low, high, [_inner(spec[0], p[name]) for p in part if p["model_name"] == model])
                        for part in (good, bad))
        values = [above.draw(rng) for _ in range(CANDIDATES)]
        params[name] = _outer(spec, max(values, key=lambda x: above.density(x) / below.density(x)))
    return params


# Stop ----------------------------------------------------------------------------------------------------------

def should_stop(own: list[float], others: list[list[float]], least_whole: int = LEAST_WHOLE) -> bool:
    """Whether a trial's mean so far is below the median of the means that whole trials had after as many folds."""
    if len(others) < least_whole:
        return False
    n = len(own)
    means = sorted(sum(o[:n]) / n for o in others)
    k = len(means)
    median = means[k // 2] if k % 2 else (means[k // 2 - 1] + means[k // 2]) / 2
    return sum(own) / n < median


# Store ---------------------------------------------------------------------------------------------------------

class TrialStore:
    """Results by batch and fold in a shared folder. A folder counts once Spark has marked it as whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, batch: int, fold: int) -> str:
        return f"{self.path}/batch={batch:04d}/fold={fold:03d}"

    def whole(self, batch: int, fold: int) -> bool:
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self._place(batch, fold)}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def write(self, batch: int, fold: int, rows: list[tuple]) -> None:
        frame = self.spark.createDataFrame(rows, STORE).coalesce(1)
        frame.drop("batch", "fold").write.mode("overwrite").parquet(self._place(batch, fold))

    def read(self, batch: int, fold: int) -> list:
        kept = ", ".join(c for c in STORE.split(", ") if c.split()[0] not in ("batch", "fold"))
        return sorted(self.spark.read.schema(kept).parquet(self._place(batch, fold)).collect(), key=lambda r: r["trial"])

    def table(self) -> DataFrame:
        """All results: batch, trial, params, fold, hits, rows, stopped."""
        return self.spark.read.schema(STORE).option("basePath", self.path).parquet(f"{self.path}/batch=*/fold=*")


# Search --------------------------------------------------------------------------------------------------------

@dataclass
class Trial:
    number: int
    params: dict
    scores: list[float] = field(default_factory=list)
    stopped: bool = False

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores) if self.scores else 0.0


def run_trials(store: TrialStore, folds: int, evaluate: Callable[[int, list[tuple[int, dict]]], dict], trials: int = TRIALS,
               seed: int = 42, batch_size: int = BATCH,
               together: Callable[[list[int], list[tuple[int, dict]]], dict] | None = None) -> list[Trial]:
    """All trials. ``evaluate`` gives for a fold and the models (number, params) of a batch ``{number: (hits, rows)}``.

    ``together`` gives the same by fold for many folds. It is asked for the first fold where that may stop trials, and for
    all others at once, so that no fold waits for the slowest model of the fold before; the result is the same.
    """
    done: list[Trial] = []
    for batch, first in enumerate(range(0, trials, batch_size)):
        # stopped trials rank below all whole ones, by how far they came
        finished = [(t.params, t.mean if not t.stopped else len(t.scores) / folds - 2 + t.mean / 1e6) for t in done]
        own = [Trial(i, propose(i, seed, finished)) for i in range(first, min(first + batch_size, trials))]
        whole = [t.scores for t in done if not t.stopped]
        ready: dict[int, dict] = {}
        for fold in range(folds):
            running = [t for t in own if not t.stopped]
            if not running:
                break
            if store.whole(batch, fold):
                for r in store.read(batch, fold):
                    trial = own[r["trial"] - first]
                    if json.loads(r["params"]) != trial.params:
                        raise ValueError(f"the store {store.path} holds another search: trial {r['trial']} differs")
                    trial.scores.append(r["hits"] / r["rows"] if r["rows"] else 0.0)
                    trial.stopped = r["stopped"]
                continue
            models = [(t.number, t.params) for t in running]
            if together and fold not in ready:
                alone = fold == 0 and len(whole) >= LEAST_WHOLE
                ready = together([fold] if alone else [f for f in range(fold, folds) if not store.whole(batch, f)], models)
            found = ready.pop(fold) if together else evaluate(fold, models)
            rows = []
            for t in running:
                hits, n = found.get(t.number, (0.0, 0.0))
                t.scores.append(hits / n if n else 0.0)
                t.stopped = fold < folds - 1 and should_stop(t.scores, whole)
                rows.append((batch, t.number, json.dumps(t.params), fold, float(hits), float(n), t.stopped))
            store.write(batch, fold, rows)
        done += own
    return done


def best_trial(trials: list[Trial]) -> Trial:
    """The highest mean over all folds; of equal ones the earlier trial."""
    return max((t for t in trials if not t.stopped), key=lambda t: (t.mean, -t.number))
