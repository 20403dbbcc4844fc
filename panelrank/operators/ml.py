"""Thin MLlib layer over instance tables: estimators by name, folds, selection, stacking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrank.operators import metrics, paged, scale
from panelrank.operators.clean import clean_for_model
from panelrank.operators.groups import cut_class

FEATURES, LABEL, PRED, WEIGHT = "features", "label", "prediction", "weight"


# --- preparation --------------------------------------------------------------------------


def scaling(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population spread of each column on the training rows."""
    row = train.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standardise(df: DataFrame, scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Centre and scale by training values; a constant column is only centred."""
    return df.withColumns(
        {c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in scales.items()}
    )


def class_weights(df: DataFrame, label: str, out: str = WEIGHT) -> DataFrame:
    """n / (k * n_c) per row, for any number of classes; a row without a class has no weight."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total, k = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    share = F.lit(float(total or 0)) / (F.lit(k) * F.col("_n"))
    return scale.join_lookup(df, counts.select(label, share.alias(out)), [label])


def assemble(df: DataFrame, cols: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector, double label, and the columns to keep."""
    ready = clean_for_model(df, cols).withColumn(LABEL, F.col(label).cast("double"))
    vector = VectorAssembler(inputCols=list(cols), outputCol=FEATURES).transform(ready)
    extra = [c for c in (*keep, WEIGHT) if c in df.columns]
    return vector.select(FEATURES, LABEL, *dict.fromkeys(extra))


# --- estimators by name -------------------------------------------------------------------

_COMMON = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PRED}


def _one_vs_rest(base: Estimator) -> Estimator:
    return mc.OneVsRest(classifier=base, **_COMMON)


ESTIMATORS: dict[tuple[str, str], Callable[..., Estimator]] = {
    ("random_forest", "classification"): lambda **p: mc.RandomForestClassifier(**_COMMON, **p),
    ("random_forest", "regression"): lambda **p: mr.RandomForestRegressor(**_COMMON, **p),
    ("boosting", "regression"): lambda **p: mr.GBTRegressor(**_COMMON, **p),
    ("boosting", "classification"): lambda **p: _one_vs_rest(mc.GBTClassifier(**p)),
    ("tree", "classification"): lambda **p: mc.DecisionTreeClassifier(**_COMMON, **p),
    ("tree", "regression"): lambda **p: mr.DecisionTreeRegressor(**_COMMON, **p),
    ("naive_bayes", "classification"): lambda **p: mc.NaiveBayes(
        modelType="gaussian", **_COMMON, **p
    ),
    ("logistic", "classification"): lambda **p: mc.LogisticRegression(**_COMMON, **p),
    ("linear", "regression"): lambda **p: mr.LinearRegression(**_COMMON, **p),
    ("ridge", "regression"): lambda **p: mr.LinearRegression(
        elasticNetParam=0.0, **_COMMON, **{"regParam": 0.1, **p}
    ),
    ("lasso", "regression"): lambda **p: mr.LinearRegression(
        elasticNetParam=1.0, **_COMMON, **{"regParam": 0.1, **p}
    ),
    ("elastic_net", "regression"): lambda **p: mr.LinearRegression(
        **_COMMON, **{"elasticNetParam": 0.5, "regParam": 0.1, **p}
    ),
    ("huber", "regression"): lambda **p: mr.LinearRegression(loss="huber", **_COMMON, **p),
    ("linear_svm", "classification"): lambda **p: _one_vs_rest(mc.LinearSVC(**p)),
    ("mlp", "classification"): lambda **p: mc.MultilayerPerceptronClassifier(**_COMMON, **p),
}


def estimator(name: str, task: str, **params) -> Estimator:
    try:
        build = ESTIMATORS[name, task]
    except KeyError:
        raise ValueError(f"no estimator {name!r} for {task}") from None
    return build(**params)


def mlp_layers(n_features: int, n_classes: int, hidden: Sequence[int] = (64, 32)) -> list[int]:
    return [n_features, *hidden, n_classes]


class MacroF1(Evaluator):
    """Macro F1 over the classes that occur, from one class-count aggregate."""

    def _evaluate(self, dataset: DataFrame) -> float:
        counts = metrics.confusion_counts(dataset, LABEL, PRED)
        return float(metrics.classification_report(counts).first()["f1_macro"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def mse_evaluator() -> Evaluator:
    return RegressionEvaluator(labelCol=LABEL, predictionCol=PRED, metricName="mse")


def grid(estimator_: Estimator, values: Mapping[str, Sequence]) -> list:
    builder = ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(estimator_.getParam(name), list(options))
    return builder.build()


def grid_search(
    train: DataFrame,
    estimator_: Estimator,
    values: Mapping[str, Sequence],
    fold: str,
    folds: int = 5,
    evaluator: Evaluator | None = None,
) -> CrossValidatorModel:
    """Cross-validated search; ``fold`` keeps whole groups together."""
    return CrossValidator(
        estimator=estimator_,
        estimatorParamMaps=grid(estimator_, values),
        evaluator=evaluator or mse_evaluator(),
        numFolds=folds,
        foldCol=fold,
    ).fit(train)


def grid_scores(model: CrossValidatorModel, spark) -> DataFrame:
    """One row per parameter set with its mean score."""
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name)), float(s))
        for i, (m, s) in enumerate(zip(model.getEstimatorParamMaps(), model.avgMetrics, strict=True))
    ]
    return spark.createDataFrame(rows, "candidate int, params string, score double")


def fit_predict(train: DataFrame, test: DataFrame, estimator_: Estimator) -> DataFrame:
    return estimator_.fit(train).transform(test)


def score(predictions: DataFrame, task: str) -> DataFrame:
    """One-row report of a prediction table."""
    if task == "classification":
        return metrics.classification_report(metrics.confusion_counts(predictions, LABEL, PRED))
    return metrics.regression_report(predictions, F.col(LABEL), F.col(PRED))


def out_of_fold(
    train: DataFrame, estimator_: Estimator, fold: str, folds: int, out: str, key: Sequence[str]
) -> DataFrame:
    """Prediction of every training row by a model that did not see its fold."""
    parts = None
    for f in range(folds):
        model = estimator_.fit(train.filter(F.col(fold) != f))
        part = model.transform(train.filter(F.col(fold) == f)).select(
            *key, F.col(PRED).alias(out)
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def stacking(
    train: DataFrame,
    test: DataFrame,
    bases: Mapping[str, Estimator],
    final: Estimator,
    fold: str,
    folds: int,
    key: Sequence[str],
) -> DataFrame:
    """Base models' out-of-fold predictions feed a final model; returns test predictions.

    Rows and predictions are written once; every model passes over them repeatedly.
    """
    key = list(key)
    train, test = scale.cut_lineage(train), scale.cut_lineage(test)
    meta_train = train.select(*key, LABEL)
    meta_test = test.select(*key, LABEL)
    for name, base in bases.items():
        meta_train = meta_train.join(out_of_fold(train, base, fold, folds, name, key), key)
        predicted = base.fit(train).transform(test).select(*key, F.col(PRED).alias(name))
        meta_test = meta_test.join(predicted, key)
    vector = VectorAssembler(inputCols=list(bases), outputCol=FEATURES)
    return final.fit(vector.transform(scale.cut_lineage(meta_train))).transform(vector.transform(meta_test))


def _class_columns(predicted: DataFrame, name: str, classes: int, key: Sequence[str]) -> DataFrame:
    share = vector_to_array(F.col("probability"))
    return predicted.select(*key, *[share[i].alias(f"{name}_{i}") for i in range(classes)])


def out_of_fold_classes(
    train: DataFrame, base: Estimator, fold: str, folds: int, name: str, classes: int, key: Sequence[str]
) -> DataFrame:
    """Class probabilities of every training row by a model that did not see its fold."""
    parts = None
    for f in range(folds):
        model = base.fit(train.filter(F.col(fold) != f))
        part = _class_columns(model.transform(train.filter(F.col(fold) == f)), name, classes, key)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def stacking_classes(
    train: DataFrame,
    test: DataFrame,
    bases: Mapping[str, Estimator],
    final: Estimator,
    fold: str,
    folds: int,
    key: Sequence[str],
    classes: int = 3,
) -> DataFrame:
    """Base classifiers' out-of-fold probabilities feed a final classifier; returns test predictions.

    Rows and probabilities are written once; every model passes over them repeatedly.
    """
    key = list(key)
    train, test = scale.cut_lineage(train), scale.cut_lineage(test)
    meta_train, meta_test = train.select(*key, LABEL), test.select(*key, LABEL)
    for name, base in bases.items():
        own = out_of_fold_classes(train, base, fold, folds, name, classes, key)
        meta_train = scale.join_groups(meta_train, own, key)
        seen = _class_columns(base.fit(train).transform(test), name, classes, key)
        meta_test = scale.join_groups(meta_test, seen, key)
    columns = [f"{name}_{i}" for name in bases for i in range(classes)]
    vector = VectorAssembler(inputCols=columns, outputCol=FEATURES)
    fitted = final.fit(vector.transform(scale.cut_lineage(meta_train)))
    return fitted.transform(vector.transform(meta_test))


def refit_on_top(
    train: DataFrame, test: DataFrame, cols: Sequence[str], estimator_: Estimator, n: int = 20
) -> tuple[list[str], DataFrame]:
    """The ``n`` columns that matter most to a model, and test predictions of one fitted to them alone."""
    names = top_by_importance(estimator_.fit(train), cols, n)
    sliced = VectorSlicer(inputCol=FEATURES, outputCol="_top", indices=[list(cols).index(c) for c in names])

    def narrow(df: DataFrame) -> DataFrame:
        return sliced.transform(df).drop(FEATURES).withColumnRenamed("_top", FEATURES)

    return names, estimator_.fit(narrow(train)).transform(narrow(test))


# --- selection ----------------------------------------------------------------------------


def mutual_information(
    df: DataFrame, cols: Sequence[str], target: str, bins: int = 10
) -> DataFrame:
    """Mutual information (nats) of quantile-binned columns with the quantile-binned target.

    All columns are counted in one aggregate over (column, x bin, y bin).
    """
    probs = [i / bins for i in range(1, bins)]
    found = scale.quantile_values(df, [*cols, target], probs)
    # Quantiles go through the same rounding as values, so engines agree on equal ones.
    binned = {
        c: cut_class(F.round(F.col(c), 9), sorted({round(q, 9) for q in found[c][1]}))
        for c in [*cols, target]
    }
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), binned[c].alias("x")) for c in cols]
    )
    counts = (
        df.select(binned[target].alias("y"), F.explode(cells).alias("c"))
        .select("y", "c.*")
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("column", "x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most bins * bins rows per column.
    whole = Window.partitionBy("column")
    n = F.col("n")
    ratio = n * F.sum(n).over(whole) / (
        F.sum(n).over(Window.partitionBy("column", "x"))
        * F.sum(n).over(Window.partitionBy("column", "y"))
    )
    return (
        counts.withColumn("_term", n / F.sum(n).over(whole) * F.ln(ratio))
        .groupBy("column")
        .agg(F.sum("_term").alias("mutual_information"))
    )


def select_top(scores: DataFrame, by: str, k: int = 30) -> list[str]:
    return [r["column"] for r in scores.orderBy(F.desc(by), "column").limit(k).collect()]


def top_by_importance(model: Model, cols: Sequence[str], n: int = 20) -> list[str]:
    ranked = np.argsort(-model.featureImportances.toArray(), kind="stable")
    return [cols[i] for i in ranked[:n]]


def _terms(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull()).select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"t{i}") for i, c in enumerate(cols)],
        F.col(target).cast("double").alias(f"t{len(cols)}"),
    )


def centre(df: DataFrame, cols: Sequence[str], target: str) -> np.ndarray:
    """Means of the columns and the target: what ``gram`` subtracts before it multiplies."""
    terms = _terms(df, cols, target)
    row = terms.agg(*[F.avg(c).alias(c) for c in terms.columns]).first()
    return np.array([x or 0.0 for x in row])


def gram(
    df: DataFrame, cols: Sequence[str], target: str, middle: np.ndarray | None = None
) -> np.ndarray:
    """Sums of products of (1, columns, target), each minus its entry of ``middle``.

    Every task multiplies its batches as matrices and sends one row per cell; the sums of equal
    cells combine before and after the shuffle, so only (columns x columns) numbers remain.
    """
    n = len(cols) + 2
    off = np.zeros(n - 1) if middle is None else middle

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), batch.to_numpy(float) - off])
            total += x.T @ x
        i, j = np.triu_indices(n)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = _terms(df, cols, target).mapInPandas(products, "i int, j int, v double")
    out = np.zeros((n, n))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _grams(train: DataFrame, check: DataFrame, cols: Sequence[str], target: str):
    """Sums of both tables around the means of the first."""
    middle = centre(train, cols, target)
    return gram(train, cols, target, middle), gram(check, cols, target, middle)


def _solve(g: np.ndarray, used: Sequence[int], penalty: float = 1e-10) -> np.ndarray:
    a = g[np.ix_(used, used)]
    size = np.sqrt(np.maximum(np.diag(a), 1e-300))
    scaled = a / np.outer(size, size) + penalty * np.eye(len(used))
    return np.linalg.solve(scaled, g[used, -1] / size) / size


def _error(g: np.ndarray, used: Sequence[int], beta: np.ndarray) -> float:
    rows = g[0, 0]
    sse = g[-1, -1] - 2 * beta @ g[used, -1] + beta @ g[np.ix_(used, used)] @ beta
    return float(sse / rows)


def forward_selection(
    train: DataFrame,
    validation: DataFrame,
    cols: Sequence[str],
    target: str,
    start: str,
    steps: int = 30,
) -> DataFrame:
    """Greedy linear model: each step adds the column that lowers validation MSE most.

    Two aggregates give all sums; the search itself only touches (columns x columns) numbers.
    """
    fit, check = _grams(train, validation, cols, target)
    used = [0, list(cols).index(start) + 1]
    rows = [(0, start, _error(check, used, _solve(fit, used)))]
    while len(rows) < steps:
        options = [i + 1 for i in range(len(cols)) if i + 1 not in used]
        tried = [(_error(check, [*used, i], _solve(fit, [*used, i])), i) for i in options]
        if not tried or min(tried)[0] >= rows[-1][2]:
            break
        best, i = min(tried)
        used.append(i)
        rows.append((len(rows), cols[i - 1], best))
    return train.sparkSession.createDataFrame(rows, "step int, column string, mse double")


def ablation(
    train: DataFrame,
    validation: DataFrame,
    blocks: Mapping[str, Sequence[str]],
    target: str,
) -> DataFrame:
    """Validation MSE of a linear model with all blocks and without each one.

    The features are aggregated once; every subset is solved from the same sums.
    """
    cols = [c for block in blocks.values() for c in block]
    fit, check = _grams(train, validation, cols, target)

    def error(kept: Sequence[str]) -> float:
        used = [0, *[cols.index(c) + 1 for c in kept]]
        return _error(check, used, _solve(fit, used))

    rows = [("all", len(cols), error(cols))]
    for name, block in blocks.items():
        kept = [c for c in cols if c not in block]
        rows.append((f"without {name}", len(kept), error(kept)))
    return train.sparkSession.createDataFrame(rows, "features string, n int, mse double")


def incremental_blocks(
    train: DataFrame,
    validation: DataFrame,
    blocks: Mapping[str, Sequence[str]],
    target: str,
) -> DataFrame:
    """Validation MSE as feature blocks are added one after the other."""
    cols = [c for block in blocks.values() for c in block]
    fit, check = _grams(train, validation, cols, target)
    rows, used = [], [0]
    for name, block in blocks.items():
        used = [*used, *[cols.index(c) + 1 for c in block]]
        rows.append((len(rows), name, len(used) - 1, _error(check, used, _solve(fit, used))))
    return train.sparkSession.createDataFrame(
        rows, "step int, block string, n int, mse double"
    )


# --- projections, clusters, per-id models -------------------------------------------------


def pca(df: DataFrame, cols: Sequence[str], keep: Sequence[str], k: int = 10) -> DataFrame:
    """First ``k`` principal components of standardised columns."""
    ready = standardise(clean_for_model(df, cols), scaling(clean_for_model(df, cols), cols))
    vector = VectorAssembler(inputCols=list(cols), outputCol=FEATURES).transform(ready)
    model = PCA(k=k, inputCol=FEATURES, outputCol="components").fit(vector)
    parts = vector_to_array(F.col("components"))
    return model.transform(vector).select(
        *keep, *[parts[i].alias(f"pc{i + 1}") for i in range(k)]
    )


def cluster_ids(panel: DataFrame, cols: Sequence[str], k: int = 4, seed: int = 42) -> DataFrame:
    """k-means over each id's column means and spreads (id, cluster).

    Clusters are written once, so that nothing that reads them goes back to the panel.
    """
    profile = panel.groupBy("id").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in cols],
    )
    names = [f"{c}_{s}" for s in ("mean", "std") for c in cols]
    ready = clean_for_model(profile, names)
    ready = standardise(ready, scaling(ready, names))
    vector = VectorAssembler(inputCols=names, outputCol=FEATURES).transform(ready)
    model = KMeans(k=k, seed=seed, featuresCol=FEATURES, predictionCol="cluster").fit(vector)
    return scale.cut_lineage(model.transform(vector).select("id", "cluster"))


def cluster_models(
    train: DataFrame, test: DataFrame, clusters: DataFrame, build: Callable[[], Estimator], k: int = 4
) -> DataFrame:
    """One model per cluster of ids; assembled rows must keep ``id``.

    Rows are written with their cluster once, so no fit joins them again.
    """
    train, test = (scale.cut_lineage(scale.join_lookup(rows, clusters, ["id"], "inner")) for rows in (train, test))
    parts = None
    for c in range(k):
        own = train.filter(F.col("cluster") == c)
        rest = test.filter(F.col("cluster") == c)
        if own.isEmpty():
            continue
        part = build().fit(own).transform(rest)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def per_id_models(
    instances: DataFrame,
    cols: Sequence[str],
    target: str,
    test_fraction: float = 0.2,
    penalty: float = 1.0,
    least: int = 5,
) -> DataFrame:
    """A ridge regression per id, tested on the id's last rows.

    An id holds at most one row per calendar day, so its rows travel as one short array and many ids
    share a batch. An id with fewer than ``least`` training rows, or none to test on, has a row
    without errors and a ``reason``. Rows without a target take no part. Columns are taken relative to
    the id's first row, so one that is constant has a spread of exactly zero.
    """
    width = len(cols) + 1
    id_type = instances.schema["id"].dataType.simpleString()

    def errors(rows: np.ndarray) -> tuple[int, int, float | None, float | None, float | None, str | None]:
        cut = int(len(rows) * (1 - test_fraction))
        if cut < least or cut == len(rows):
            return cut, len(rows) - cut, None, None, None, "too few rows"
        y, x = rows[:, 0], np.where(np.isnan(rows[:, 1:]), 0.0, rows[:, 1:])
        x = x - x[0]
        mid, spread = x[:cut].mean(0), x[:cut].std(0)
        z = (x - mid) / np.where(spread > 0, spread, 1.0)
        top = y[:cut].mean()
        beta = np.linalg.solve(
            z[:cut].T @ z[:cut] + penalty * np.eye(width - 1), z[:cut].T @ (y[:cut] - top)
        )
        error = y[cut:] - (top + z[cut:] @ beta)
        mse, mae = float(np.mean(error**2)), float(np.mean(np.abs(error)))
        return cut, len(rows) - cut, mse, mae, float(np.mean((y[cut:] - top) ** 2)), None

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            ends = np.cumsum(held.value_lengths().to_numpy()) // width
            rows = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            found = [errors(own) for own in np.split(rows, ends[:-1])] if len(batch) else []
            columns = zip(*found) if found else [[]] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *names])

    names = ["n_train", "n_test", "mse", "mae", "baseline_mse", "reason"]
    types = [pa.int32(), pa.int32(), *[pa.float64()] * 3, pa.string()]
    values = [F.col(target), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]]
    row = F.struct(
        F.col("date").isNull().alias("undated"), "date", F.array(*[v.cast("double") for v in values]).alias("v")
    )
    return (
        instances.filter(F.col(target).isNotNull())
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
        .select("id", F.flatten(F.col("rows.v")).alias("rows"))
        .mapInArrow(
            fit,
            f"id {id_type}, n_train int, n_test int, mse double, mae double,"
            " baseline_mse double, reason string",
        )
    )


# --- ranking ------------------------------------------------------------------------------


def contrast_rows(
    df: DataFrame, group: Sequence[str], cols: Sequence[str], rel: str
) -> DataFrame:
    """Training rows of a linear ranker: each positive minus its group's mean negative.

    One row per positive (and its mirror image), not one per pair of rows, so a group's size
    does not multiply. Weighted by the relevance grade.
    """
    return _mirrored(_contrasts(df, group, cols, rel), cols)


def _contrasts(df: DataFrame, group: Sequence[str], cols: Sequence[str], rel: str) -> DataFrame:
    """One row per positive. Rows move once, by group, unless a group is too large for one task."""
    negatives = {
        f"_mean_{c}": F.avg(F.when(F.col(rel) == 0, F.col(c).cast("double"))) for c in cols
    }
    rows = df.select(*group, rel, *cols)
    if scale.oversized_groups(df.select(*group), group) is None:
        whole = Window.partitionBy(*group)
        rows = rows.withColumns({name: mean.over(whole) for name, mean in negatives.items()})
    else:
        rows = scale.with_group_stats(rows, group, negatives)
    rows = rows.filter((F.col(rel) > 0) & F.col(f"_mean_{cols[0]}").isNotNull())
    return rows.select(
        *[(F.col(c) - F.col(f"_mean_{c}")).alias(c) for c in cols], F.col(rel).cast("double").alias(WEIGHT)
    )


def _mirrored(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = rows.withColumn("_side", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    return rows.select(
        *[(F.col("_side") * F.col(c)).alias(c) for c in cols],
        F.when(F.col("_side") > 0, 1.0).otherwise(0.0).alias(LABEL),
        WEIGHT,
    )


def fit_ranker(
    df: DataFrame | paged.Paged, group: Sequence[str], cols: Sequence[str], rel: str
) -> dict[str, float]:
    """Coefficients of a linear score learnt by logistic regression on contrasts.

    The contrasts are written once, without their mirror images: fitting passes over them repeatedly.
    Of pages that lie together they are made without moving a row.
    """
    if isinstance(df, paged.Paged):
        found = paged.contrasts(df, WEIGHT).select(*cols, WEIGHT)
        if df.large is not None:
            found = found.unionByName(_contrasts(df.large, group, cols, rel))
    else:
        found = _contrasts(df, group, cols, rel)
    rows = _mirrored(scale.cut_lineage(found), cols)
    vector = VectorAssembler(inputCols=list(cols), outputCol=FEATURES).transform(rows)
    model = mc.LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, fitIntercept=False, regParam=1e-4
    ).fit(vector.select(FEATURES, LABEL, WEIGHT))
    return dict(zip(cols, map(float, model.coefficients.toArray()), strict=True))


def linear_score(coefficients: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for c, w in coefficients.items():
        total = total + F.col(c) * w
    return total


def window_sweep(
    build: Callable[[int], DataFrame],
    sizes: Sequence[int],
    cols: Callable[[int], Sequence[str]],
    target: str,
    is_train: Column,
) -> DataFrame:
    """Validation MSE of a linear model on features of each window size."""
    rows = []
    for size in sizes:
        table = scale.cut_lineage(build(size))
        names = list(cols(size))
        fit, check = _grams(table.filter(is_train), table.filter(~is_train), names, target)
        used = list(range(len(names) + 1))
        rows.append((size, int(check[0, 0]), _error(check, used, _solve(fit, used))))
        spark = table.sparkSession
    return spark.createDataFrame(rows, "window int, n_test int, mse double")

