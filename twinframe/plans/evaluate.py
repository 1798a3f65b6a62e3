"""Score a synthetic table: fidelity, detection, utility; and compare methods.

Results are long ``(method, family, metric, column, mean, std)`` rows.  Trees are
forests: all trees grow level by level in the same few passes, where as many boosted
trees would read the rows once per tree and level.  Small tables take Spark ML's,
which keeps counts and nodes per row and tree; larger ones those of ``forests``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from twinframe.operators import forests
from twinframe.operators.features import level_dictionary, with_codes
from twinframe.operators.fidelity import fidelity_summary
from twinframe.operators.sampling import (
    SEEDS,
    balanced_pair,
    labelled_union,
    sample_exact,
    split_stratified,
    split_train_val_test,
)
from twinframe.operators.scores import (
    classification_metrics,
    long_scores,
    regression_metrics,
    roc_auc,
    seed_summary,
)
from twinframe.session import groups_that_fit, materialize

DETECTION_TREES = 200
UTILITY_TREES = 500
DEPTH = 6

#: Rows of a task that grows or walks trees, while their tasks are few: a task also adds up the bins of all open nodes.
TASK_ROWS = 2000
TASKS = 40
TASK_SHARE = 400

#: Training rows up to which a forest is Spark ML's, and features and classes above which it is at any size.
FOREST_ROWS = TASKS * TASK_ROWS
FOREST_WIDTH = 256
FOREST_CLASSES = 64


@dataclass(frozen=True)
class FeatureModel:
    """Numbers, then one-hot levels as one sparse vector, whatever the number of levels."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    dictionary: DataFrame | None
    small: dict[str, bool]
    one_hot: Model | None

    def _inputs(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        # trees cannot split on a missing value; it goes left of all others
        values = [
            F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(-1.7976931348623157e308)).alias(f"_v{i}")
            for i, c in enumerate(self.numeric)
        ]
        levels = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(self.categorical)]
        plain = rows.select(*[f"`{c}`" for c in keep], *values, *levels)
        if self.dictionary is None:
            return plain
        names = {f"_c{i}": c for i, c in enumerate(self.categorical)}
        return with_codes(plain, self.dictionary, names, self.small)

    def transform(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        coded = self._inputs(rows, keep)
        parts = [f"_v{i}" for i in range(len(self.numeric))]
        if self.one_hot is not None:
            coded = self.one_hot.transform(coded)
            parts += [f"_h{i}" for i in range(len(self.categorical))]
        assembled = VectorAssembler(inputCols=parts, outputCol="features").transform(coded)
        return assembled.select(*[f"`{c}`" for c in keep], "features")


def fit_features(
    rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> FeatureModel:
    """Fitted on all frames together, so widths always agree.

    Levels are numbered in a dictionary table, which is broadcast only when its
    measured size allows; none of them reaches the driver.  Null is a level.
    """
    if not categorical:
        return FeatureModel(numeric, categorical, None, True, None)
    dictionary = materialize(level_dictionary(rows, categorical))
    width = range(len(categorical))
    # the encoder reads only the highest code of each column
    highest = {r["column"]: r["idx"] for r in dictionary.groupBy("column").agg(F.max("idx").alias("idx")).collect()}
    ends = rows.sparkSession.range(1).select(
        *[F.lit(float(highest.get(c, 0))).alias(f"_c{i}") for i, c in enumerate(categorical)]
    )
    one_hot = OneHotEncoder(
        inputCols=[f"_c{i}" for i in width], outputCols=[f"_h{i}" for i in width], dropLast=False
    ).fit(ends)
    return FeatureModel(numeric, categorical, dictionary, groups_that_fit(dictionary, "column"), one_hot)


def _rows(summary: DataFrame, method: str, family: str) -> DataFrame:
    return summary.select(
        F.lit(method).alias("method"),
        F.lit(family).alias("family"),
        "metric",
        F.lit("").alias("column"),
        "mean",
        "std",
    )


def _spread(rows: DataFrame) -> DataFrame:
    """Computed once and dealt over tasks by their number: encoded rows are narrow, so by bytes all would be one task's.

    Every row costs a step of each tree, and every task the bins of all open nodes; so
    tasks grow with the rows while few, and with the root of them once that asks for
    more. The cluster plays no part, for the draws of a forest follow its partitions.
    """
    rows = materialize(rows)
    tasks = _tasks(rows.count())
    return materialize(rows.repartition(tasks)) if tasks > 1 else rows


def _tasks(n: int) -> int:
    few = max(TASKS, int((n / TASK_SHARE) ** 0.5))
    return min(-(-n // TASK_ROWS), few)


def _forest(rows: DataFrame, continuous: int, classes: bool, trees: int, seed: int) -> Model | forests.Forest:
    """A forest of dealt training rows (y, features), of which the first ``continuous`` are numbers."""
    size = F.size(vector_to_array("features"))
    n, width, top = rows.agg(F.count(F.lit(1)), F.max(size), F.max("y")).first()
    levels = max(2, int(top) + 1) if classes and n else 0
    if n > FOREST_ROWS and width <= FOREST_WIDTH and levels <= FOREST_CLASSES:
        return forests.grow(rows, continuous, levels, trees, DEPTH, seed)
    kind = RandomForestClassifier if classes else RandomForestRegressor
    return kind(labelCol="y", numTrees=trees, maxDepth=DEPTH, seed=seed, cacheNodeIds=True).fit(rows)


def _predicted(model: Model | forests.Forest, rows: DataFrame) -> DataFrame:
    """Tested rows with their prediction; every one walks all trees, so they are dealt as training rows are."""
    return model.transform(_spread(rows)).select("y", F.col("prediction").alias("yhat"))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def run_fidelity(
    pair: DataFrame, numeric: Sequence[str], categorical: Sequence[str], method: str = "ours"
) -> DataFrame:
    return fidelity_summary(pair, numeric, categorical, method).select(
        "method",
        F.lit("fidelity").alias("family"),
        "metric",
        "column",
        F.col("value").alias("mean"),
        F.lit(None).cast("double").alias("std"),
    )


def run_detection(
    pair: DataFrame,
    ids: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    method: str = "ours",
    seed: int = 42,
    seeds: Sequence[int] = SEEDS,
    trees: int = DETECTION_TREES,
) -> DataFrame:
    """How well a classifier tells synthetic from real rows; 1/2 is indistinguishable."""
    even = materialize(balanced_pair(pair, ids, seed))
    features = fit_features(even, numeric, categorical)
    rows = even.withColumn("y", F.when(F.col("side") == "synth", 1.0).otherwise(0.0))
    scores = []
    for s in seeds:
        split = _spread(features.transform(split_stratified(rows, ids, "side", s), ["y", "split"]))
        model = _forest(split.where("split = 'train'"), len(numeric), True, trees, s)
        tested = materialize(
            model.transform(split.where("split = 'test'")).select(
                "y", F.col("prediction").alias("yhat"),
                vector_to_array("probability")[1].alias("score"),
            )
        )
        accuracy = tested.agg(
            F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("value")
        ).select(F.lit("accuracy").alias("metric"), "value")
        auc = roc_auc(tested).select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
        scores += [accuracy, auc]
    return _rows(seed_summary(_union(scores), ["metric"]), method, "detection")


def score_classification(
    train: DataFrame, test: DataFrame, numeric, categorical, target: str, seed: int, trees: int
) -> DataFrame:
    """``(metric, value)``: accuracy and macro F1 of trees fitted on ``train``."""
    numeric = [c for c in numeric if c != target]
    categorical = [c for c in categorical if c != target]
    both = train.unionByName(test)
    features = fit_features(both, numeric, categorical)
    labels = StringIndexer(
        inputCol="_target", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(_target(both, target))
    encode = lambda rows: labels.transform(
        features.transform(_target(rows, target), ["_target"])
    )
    model = _forest(_spread(encode(train)), len(numeric), True, trees, seed)
    tested = _predicted(model, encode(test))
    return long_scores(classification_metrics(tested), ["accuracy", "macro_f1"], [])


def _target(rows: DataFrame, target: str) -> DataFrame:
    return rows.withColumn("_target", F.col(f"`{target}`").cast("string"))


def score_regression(
    train: DataFrame, test: DataFrame, numeric, categorical, target: str, seed: int, trees: int
) -> DataFrame:
    """``(metric, value)``: RMSE and R2 of trees fitted on ``train``."""
    numeric = [c for c in numeric if c != target]
    categorical = [c for c in categorical if c != target]
    features = fit_features(train.unionByName(test), numeric, categorical)
    value = F.col(f"`{target}`").cast("double")
    encode = lambda rows: features.transform(rows.withColumn("y", value), ["y"])
    model = _forest(_spread(encode(train)), len(numeric), False, trees, seed)
    tested = _predicted(model, encode(test))
    return long_scores(regression_metrics(tested), ["rmse", "r2"], [])


def _utility(
    real: DataFrame,
    synth: DataFrame | None,
    ids: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    class_target: str | None,
    value_target: str | None,
    seeds: Sequence[int],
    trees: int,
) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in dict.fromkeys([*numeric, *categorical])]
    scores = []
    for seed in seeds:
        split = materialize(split_train_val_test(real, ids, seed))
        train = split.where("split = 'train'")
        if synth is not None:
            train = sample_exact(synth, ids, train.count(), seed)
        train = materialize(train.select(*columns))
        test = split.where("split = 'test'").select(*columns)
        if class_target:
            scores.append(
                score_classification(train, test, numeric, categorical, class_target, seed, trees)
            )
        if value_target:
            scores.append(
                score_regression(train, test, numeric, categorical, value_target, seed, trees)
            )
    return seed_summary(materialize(_union(scores)), ["metric"])


def run_tstr(
    real: DataFrame,
    synth: DataFrame,
    ids: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    class_target: str | None,
    value_target: str | None,
    method: str = "ours",
    seeds: Sequence[int] = SEEDS,
    trees: int = UTILITY_TREES,
) -> DataFrame:
    """Train on synthetic rows (as many as the real training split), test on real ones."""
    found = _utility(
        real, synth, ids, numeric, categorical, class_target, value_target, seeds, trees
    )
    return _rows(found, method, "tstr")


def run_trtr(
    real: DataFrame,
    ids: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    class_target: str | None,
    value_target: str | None,
    seeds: Sequence[int] = SEEDS,
    trees: int = UTILITY_TREES,
) -> DataFrame:
    """Train and test on real rows: the upper bound."""
    found = _utility(
        real, None, ids, numeric, categorical, class_target, value_target, seeds, trees
    )
    return _rows(found, "Real (TRTR)", "tstr")


def compare_methods(results: DataFrame, family: str, metrics: Sequence[str]) -> DataFrame:
    """One row per method, ``<metric>`` and ``<metric>_std`` columns, table-level metrics only."""
    chosen = results.where((F.col("family") == family) & (F.col("column") == ""))
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return chosen.groupBy("method").agg(
        *[pick(m, "mean").alias(m) for m in metrics],
        *[pick(m, "std").alias(f"{m}_std") for m in metrics],
    )


#: The four tables of a comparison.
SUMMARIES = {
    "fidelity": ("fidelity", ["avg_ks", "avg_tvd", "corr_frobenius"]),
    "detection": ("detection", ["accuracy", "auc"]),
    "classification": ("tstr", ["accuracy", "macro_f1"]),
    "regression": ("tstr", ["rmse", "r2"]),
}


def summary_tables(results: DataFrame) -> dict[str, DataFrame]:
    return {
        name: compare_methods(results, family, metrics)
        for name, (family, metrics) in SUMMARIES.items()
    }


def run_all(
    real: DataFrame,
    methods: dict[str, DataFrame],
    ids: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    class_target: str | None,
    value_target: str | None,
    seeds: Sequence[int] = SEEDS,
    detection_trees: int = DETECTION_TREES,
    utility_trees: int = UTILITY_TREES,
) -> DataFrame:
    """All families for every synthetic table, and the real upper bound."""
    columns = [F.col(f"`{c}`") for c in dict.fromkeys([*ids, *numeric, *categorical])]
    results = []
    for method, synth in methods.items():
        pair = materialize(labelled_union(real.select(*columns), synth.select(*columns)))
        results += [
            run_fidelity(pair, numeric, categorical, method),
            run_detection(
                pair, ids, numeric, categorical, method, seeds=seeds, trees=detection_trees
            ),
            run_tstr(
                real, synth, ids, numeric, categorical, class_target, value_target, method, seeds,
                utility_trees,
            ),
        ]
    results.append(
        run_trtr(real, ids, numeric, categorical, class_target, value_target, seeds, utility_trees)
    )
    return _union(results)
