"""Preparation, model search, cross validation and refit with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lumenframe.operators.anomaly import _deviation, encode, impute
from lumenframe.operators.boosting import CELL_BYTES, BinnedTrees, bin_edges, cells, fits, packed_cells, score_models
from lumenframe.operators.extra_trees import ExtraTrees
from lumenframe.operators.ordered import same, split_row_number
from lumenframe.operators.profile import categorical_profile, string_columns
from lumenframe.operators.quantiles import numbers, quantile_map, summarise
from lumenframe.operators.regression_forest import RegressionForest
from lumenframe.operators.tuning import BATCH, SPACE, TRIALS, TrialStore, best_trial, propose, run_trials
from lumenframe.session import materialise, scratch_path

FOLDS = 5
HOLDOUT = 0.2
MODELS = list(SPACE)
#: Models fitted by Spark that run side by side.
PARALLEL = 4
#: Small tables are read by few tasks, since every step of a model is a job of its own.
ROWS_PER_TASK = 50_000


# Preparation ---------------------------------------------------------------------------------------------------

class PreparedTable(Model):
    """Fitted preparation: adds a ``features`` vector."""

    def __init__(self, numeric: list[str], text: list[str], medians: dict, centres: dict, modes: dict, encoder):
        super().__init__()
        self.numeric, self.text, self.medians, self.centres, self.modes = numeric, text, medians, centres, modes
        self.encoder = encoder

    @property
    def feature_names(self) -> list[str]:
        names = list(self.numeric)
        if self.text:
            for c, labels in zip(self.text, self.encoder.stages[0].labelsArray):
                names += [f"{c}_{x}" for x in labels]
        return names

    def _transform(self, df: DataFrame) -> DataFrame:
        shaped = df
        for c in self.numeric:
            mean, deviation = self.centres[c]
            value = F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c, 0.0)))
            shaped = shaped.withColumn(f"_n_{c}", (value - F.lit(mean)) / F.lit(deviation))
        for c in self.text:
            shaped = shaped.withColumn(f"_t_{c}", F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c, ""))))
        out = self.encoder.transform(shaped)
        return out.select(*df.columns, "features")


class TablePreparation(Estimator):
    """Numbers: exact median for gaps, then zero mean and unit deviation. Texts: mode for gaps, then one column per
    value; a value not seen before sets none of them."""

    def __init__(self, features: list[str], text: list[str]):
        super().__init__()
        self.text = [c for c in features if c in text]
        self.numeric = [c for c in features if c not in text]

    def _fit(self, df: DataFrame) -> PreparedTable:
        medians, centres, modes = {}, {}, {}
        if self.numeric:
            plain = numbers(df, self.numeric)
            medians = {c: q[0.5] for c, q in quantile_map(plain, self.numeric, [0.5]).items()}
            s = summarise(impute(plain, self.numeric, medians), self.numeric)
            centres = {c: (s[c]["mean"] or 0.0, _deviation(s[c])) for c in self.numeric}
        stages = []
        if self.text:
            modes = {r["column"]: r["most_common"] for r in categorical_profile(df, self.text).collect()}
            stages = [
                StringIndexer(inputCols=[f"_t_{c}" for c in self.text], outputCols=[f"_i_{c}" for c in self.text],
                              handleInvalid="keep", stringOrderType="alphabetAsc"),
                # The extra slot for unseen values is the last one and is dropped.
                OneHotEncoder(inputCols=[f"_i_{c}" for c in self.text], outputCols=[f"_o_{c}" for c in self.text],
                              dropLast=True)]
        inputs = [f"_n_{c}" for c in self.numeric] + [f"_o_{c}" for c in self.text]
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
        shaped = PreparedTable(self.numeric, self.text, medians, centres, modes, Pipeline(stages=[]).fit(df))
        filled = df
        for c in self.numeric:
            filled = filled.withColumn(f"_n_{c}", F.lit(0.0))
        for c in self.text:
            filled = filled.withColumn(f"_t_{c}", F.coalesce(F.col(c).cast("string"), F.lit(modes.get(c, ""))))
        shaped.encoder = Pipeline(stages=stages).fit(filled)
        return shaped


def preparation(df: DataFrame, features: list[str]) -> TablePreparation:
    return TablePreparation(features, [c for c in features if isinstance(df.schema[c].dataType, T.StringType)])


def with_label(df: DataFrame, target: str) -> tuple[DataFrame, list]:
    """``df`` without rows lacking the target, and a ``label`` number: position of the class in sorted order."""
    known = df.filter(F.col(target).isNotNull())
    listed = known.select(F.col(target).alias("_class")).distinct()
    place = F.row_number().over(Window.orderBy("_class")) - 1  # one row per class
    numbered = materialise(listed.withColumn("label", place.cast("double")), "classes")
    classes = [r["_class"] for r in numbered.orderBy("label").collect()]
    kept = [c for c in known.columns if c != "label"]
    return known.select(*kept).join(numbered, F.col(target) == F.col("_class")).drop("_class"), classes


# Splits --------------------------------------------------------------------------------------------------------

def _shuffled(df: DataFrame, key: str, by: str, seed: int) -> DataFrame:
    """Position of each row in its class under a hash order; the leading hash digits cut a class into pieces."""
    digest = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    hashed = df.withColumn("_digest", digest).withColumn("_piece", F.left("_digest", F.lit(2)))
    return split_row_number(hashed, [by], "_piece", ["_digest", key], "_position").drop("_digest", "_piece")


def stratified_folds(df: DataFrame, key: str, by: str, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 0..folds-1; every class is spread evenly."""
    return (_shuffled(df, key, by, seed)
            .withColumn("fold", ((F.col("_position") - 1) % folds).cast("int")).drop("_position"))


def stratified_holdout(df: DataFrame, key: str, by: str, share: float = HOLDOUT, seed: int = 42) -> DataFrame:
    """``df`` with ``held_out``: the rounded ``share`` of every class."""
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_size"))
    return (_shuffled(df, key, by, seed).join(sizes, same([by], ["_by"]))
            .withColumn("held_out", F.col("_position") <= F.round(F.col("_size") * share))
            .drop("_position", "_size", "_by"))


def accuracy(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predicted.agg(F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)).alias("accuracy"),
                         F.count(F.lit(1)).alias("rows"))


# Model space ---------------------------------------------------------------------------------------------------

def draw_params(trial: int, seed: int = 42) -> dict:
    """Parameters of one trial, drawn at random from the fixed ranges; the first trials take the models in turn."""
    return propose(trial, seed, [])


def limited(params: dict, max_trees: int | None) -> dict:
    """``params`` with at most ``max_trees`` trees."""
    return {k: min(v, max_trees) if max_trees and k.endswith("n_estimators") else v for k, v in params.items()}


def build_classifier(params: dict, classes: int = 2, rows: int = 1, seed: int = 42, max_trees: int | None = None):
    """Estimator for drawn or stored parameters: binned trees (see ``boosting``) or a logistic regression, whose penalty
    is that of a sum of losses over ``rows``."""
    name = str(params.get("model_name", "")).lower()
    if name in ("random_forest", "lightgbm", "xgboost"):
        return BinnedTrees(limited({**params, "model_name": name}, max_trees), classes, seed)
    if name == "logistic_regression":
        return LogisticRegression(regParam=1.0 / (float(params["lr_c"]) * max(rows, 1)), maxIter=200,
                                  standardization=False)
    raise ValueError("params must include model_name as one of: " + ", ".join(repr(m) for m in MODELS))


class PreparedFolds:
    """A table with ``fold``, prepared once per fold: the preparation is fitted on the other folds. All models of a search
    are tried on what is written here."""

    def __init__(self, table: DataFrame, features: list[str], classes: int, folds: int = FOLDS, seed: int = 42,
                 cell_bytes: int = CELL_BYTES):
        self.classes, self.seed = max(2, classes), seed
        self.learnt = {r["fold"]: r["count"] for r in table.groupBy("fold").count().collect()}
        total = sum(self.learnt.values())
        self.learnt = {f: total - self.learnt.get(f, 0) for f in range(folds)}

        def prepared(f: int) -> DataFrame:
            ready = preparation(table, features).fit(table.filter(F.col("fold") != f)).transform(table)
            return ready.select(F.lit(f).alias("split"), (F.col("fold") == f).alias("held"), "label", "features",
                                vector_to_array("features").alias("f"))

        with ThreadPool(PARALLEL) as pool:
            parts = pool.map(prepared, range(folds), chunksize=1)
        self.rows = materialise(reduce(DataFrame.unionByName, parts).coalesce(max(1, folds * total // ROWS_PER_TASK)),
                                "prepared-folds")
        edges = bin_edges(self.rows.filter(~F.col("held")), ["split"])
        self.widths = {k: [len(e) + 1 for e in own] for k, own in edges.items()}
        known = self.rows.filter(F.col("split").isin([k[0] for k in edges]))  # a fold may hold all rows
        cells_ = materialise(cells(known, ["split", "held"], edges), "fold-cells")
        self.packed = None
        if all(fits(cells_.filter(F.col("split") == k[0]), w, cell_bytes) for k, w in self.widths.items()):
            self.packed = materialise(packed_cells(cells_, "split"), "packed-cells")

    def _alone(self, fold: int, params: dict) -> tuple[float, float]:
        """One model fitted by Spark over all rows of a fold."""
        own = self.rows.filter(F.col("split") == fold)
        learnt = own.filter(~F.col("held")).coalesce(max(1, self.learnt[fold] // ROWS_PER_TASK))
        model = build_classifier(params, self.classes, self.learnt[fold], self.seed).fit(learnt)
        found = accuracy(model.transform(own.filter("held"))).first()
        return (found["accuracy"] or 0.0) * found["rows"], float(found["rows"])

    def evaluate(self, fold: int, models: list[tuple[int, dict]]) -> dict:
        """``{number: (hits, rows)}`` on the held rows of a fold."""
        return self.evaluate_folds([fold], models)[fold]

    def evaluate_folds(self, folds: list[int], models: list[tuple[int, dict]]) -> dict:
        """``{fold: {number: (hits, rows)}}`` on the held rows of many folds; all models of all folds run side by side."""
        known = [f for f in folds if (f,) in self.widths]
        found: dict = {f: {} for f in folds}
        trees = [(m, p) for m, p in models if self.packed is not None and p["model_name"] != "logistic_regression"]
        others = [(m, f, p) for f in known for m, p in models if (m, p) not in trees]
        with ThreadPool(1 + min(len(others), PARALLEL)) as pool:
            grown = pool.apply_async(score_models, (
                self.packed.filter(F.col("split").isin(known)), "split", [(m, f, p) for f in known for m, p in trees],
                self.widths, self.classes, self.seed)) if trees and known else None
            for (m, f, _), score in zip(others, pool.map(lambda x: self._alone(x[1], x[2]), others, chunksize=1)):
                found[f][m] = score
            if grown:
                for (m, f), score in grown.get().items():
                    found[f][m] = score
        return found


def cross_validate(df: DataFrame, features: list[str], params: dict, classes: int, folds: int = FOLDS,
                   seed: int = 42, max_trees: int | None = None) -> float:
    """Mean accuracy over the folds of column ``fold``; preparation is fitted inside each fold."""
    ready = PreparedFolds(df, features, classes, folds, seed)
    scores = [ready.evaluate(f, [(0, limited(params, max_trees))]).get(0, (0.0, 0.0)) for f in range(folds)]
    return sum(hits / rows if rows else 0.0 for hits, rows in scores) / folds


@dataclass
class SearchResult:
    best_params: dict
    best_score: float
    model: PipelineModel
    classes: list
    trials: DataFrame
    store: TrialStore
    extras: dict = field(default_factory=dict)


def search(df: DataFrame, key: str, features: list[str], target: str, trials: int = TRIALS, folds: int = FOLDS,
           seed: int = 42, max_trees: int | None = None, store: str | None = None, batch_size: int = BATCH) -> SearchResult:
    """Guided search over the model space (see ``tuning``), then a refit of the winner on all rows.

    ``store`` is a folder for the trials; given one that holds part of the same search, the search goes on from there.
    """
    spark = df.sparkSession
    labelled, classes = with_label(df.select(key, *features, target), target)
    table = materialise(stratified_folds(labelled, key, "label", folds, seed), "folds")
    kept = TrialStore(spark, store or scratch_path(spark, "trials"))
    ready = PreparedFolds(table, features, len(classes), folds, seed)

    def together(asked: list[int], models: list[tuple[int, dict]]) -> dict:
        return ready.evaluate_folds(asked, [(m, limited(p, max_trees)) for m, p in models])

    done = run_trials(kept, folds, lambda fold, models: together([fold], models)[fold], trials, seed, batch_size, together)
    best = best_trial(done)
    rows = [(t.number, t.params["model_name"], {k: str(v) for k, v in t.params.items() if k != "model_name"}, t.mean,
             len(t.scores), t.stopped) for t in done]
    frame = spark.createDataFrame(
        rows, "trial int, model_name string, params map<string,string>, score double, folds int, stopped boolean")
    model = train(table, features, best.params, len(classes), seed, max_trees)
    return SearchResult(best.params, best.mean, model, classes, frame, kept)


def train(labelled: DataFrame, features: list[str], params: dict, classes: int = 2, seed: int = 42,
          max_trees: int | None = None) -> PipelineModel:
    """Preparation and model fitted on all rows of a table with ``label``."""
    flow = Pipeline(stages=[preparation(labelled, features),
                            build_classifier(params, classes, labelled.count(), seed, max_trees)])
    return flow.fit(labelled)


# Refit for explanation -----------------------------------------------------------------------------------------

def build_explained_model(name: str, problem: str, rows: int, seed: int = 42, trees: int = 100, depth: int = 8,
                          classes: int = 2):
    """Registry of models that can be explained; an unknown name falls back to ridge or a random forest.

    Boosted trees know two classes; with more there is one model per class.
    """
    if name in ("ExtraTreesRegressor", "ExtraTreesClassifier") and name.endswith("Regressor") == (problem == "regression"):
        return ExtraTrees(0 if problem == "regression" else classes, trees, depth, seed)
    if problem == "regression":
        if name in ("RandomForestRegressor", "random_forest"):
            return RegressionForest(trees, depth, seed)
        if name == "GradientBoostingRegressor":
            return GBTRegressor(maxIter=trees, maxDepth=3, stepSize=0.1, seed=seed)
        penalty, mix = {"Lasso": (1.0, 1.0), "ElasticNet": (1.0, 0.5)}.get(name, (1.0 / max(rows, 1), 0.0))
        return LinearRegression(regParam=penalty, elasticNetParam=mix, standardization=False)
    if name in ("GradientBoostingClassifier", "lightgbm", "xgboost"):
        boosted = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.1, seed=seed)
        return boosted if classes <= 2 else OneVsRest(classifier=boosted)
    if name == "logistic_regression":
        return LogisticRegression(regParam=1.0 / max(rows, 1), maxIter=200, standardization=False)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)


def clean_table(df: DataFrame, key: str, features: list[str], target: str, problem: str) -> DataFrame:
    """Rows with a target: scaled numbers, sorted codes for texts, and ``label``. The codes are written once; gaps and scales
    are worked out where rows are read."""
    known = df.select(key, *features, target).filter(F.col(target).isNotNull())
    if problem == "regression":
        known = known.withColumn("label", F.col(target).cast("double"))
    else:
        known, _ = with_label(known, target)
    texts = [c for c in features if c in string_columns(df)]
    numeric = [c for c in features if c not in texts]
    coded = encode(known.select(key, "label", *[F.col(c).cast("double").alias(c) if c in numeric else F.col(c)
                                                for c in features]), texts)
    coded = materialise(coded.select(key, "label", *features), "coded")
    filled = impute(coded, features)
    s = summarise(filled, numeric) if numeric else {}
    scaled = [((F.col(c) - s[c]["mean"]) / _deviation(s[c])).alias(c) if c in numeric else F.col(c) for c in features]
    return filled.select(key, "label", *scaled)


def fit_clean_model(table: DataFrame, features: list[str], name: str, problem: str, **options):
    if problem != "regression":
        options.setdefault("classes", int(table.agg(F.count_distinct("label")).first()[0]))
    model = build_explained_model(name, problem, table.count(), **options)
    if isinstance(model, GBTRegressor):
        # No cut parts equal rows, so their squares around their mean add the same to every cut: one weighted row is enough.
        table = materialise(table.groupBy(*features).agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double")
                                                         .alias("weight")), "merged")
        model = model.setWeightCol("weight")
    return model.fit(VectorAssembler(inputCols=features, outputCol="features").transform(table))
