"""One experiment: cleaned panel -> instances -> split -> fit -> report row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrank.operators import groups, metrics, ml, scale, splits
from panelrank.plans.instances import FeatureOptions, build_instances, feature_names


@dataclass(frozen=True)
class Experiment:
    features: FeatureOptions
    split: str = "date"
    test_fraction: float = 0.2
    held_out: int = 5
    seed: int = 42
    regressor: str = "ridge"
    regressor_params: dict = field(default_factory=dict)
    classifier: str | None = None
    classifier_params: dict = field(default_factory=dict)


def split_instances(rows: DataFrame, e: Experiment) -> DataFrame:
    if e.split == "date":
        return splits.split_by_date(rows, e.test_fraction)
    if e.split == "leave_groups_out":
        return splits.split_leave_groups_out(rows, "id", e.held_out, e.seed)
    if e.split == "per_id":
        return splits.split_per_id(rows, e.test_fraction)
    if e.split == "stratified":
        return splits.stratified_holdout(rows, "id", "target", e.held_out)
    raise ValueError(f"unknown split {e.split!r}")


def run_experiment(panel: DataFrame, e: Experiment, name: str) -> DataFrame:
    """A row per model and baseline: split sizes and test metrics.

    Fitting reads the instances many times, so they are written once to the shared folder.
    """
    rows = scale.cut_lineage(split_instances(build_instances(panel, e.features), e))
    cols = feature_names(rows)
    train, test = rows.filter(F.col("part") == "train"), rows.filter(F.col("part") == "test")
    cuts = groups.class_cuts(train, "target")
    scales = ml.scaling(train.fillna(0.0, cols), cols)

    def prepared(part: DataFrame, label: str) -> DataFrame:
        ready = ml.standardise(part.fillna(0.0, cols), scales)
        ready = ready.withColumn("_class", groups.cut_class(F.col("target"), cuts))
        return ml.assemble(ready, cols, label)

    reports = []
    fitted = ml.fit_predict(
        prepared(train, "target"),
        prepared(test, "target"),
        ml.estimator(e.regressor, "regression", **e.regressor_params),
    )
    reports.append((e.regressor, ml.score(fitted, "regression").first().asDict()))
    if e.classifier:
        fitted = ml.fit_predict(
            prepared(train, "_class"),
            prepared(test, "_class"),
            ml.estimator(e.classifier, "classification", **e.classifier_params),
        )
        reports.append((e.classifier, ml.score(fitted, "classification").first().asDict()))
    reports.append(("baseline", metrics.baselines(train, test, "target", cuts).first().asDict()))
    names = ("n", "accuracy", "f1_macro", "mse", "rmse", "mae", "r2")
    table = [
        (name, model, len(cols), *[r.get(m) for m in names]) for model, r in reports
    ]
    return panel.sparkSession.createDataFrame(
        table,
        "run string, model string, n_features int, n_test long, accuracy double, "
        "f1_macro double, mse double, rmse double, mae double, r2 double",
    )
