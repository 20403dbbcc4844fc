"""Paired tests and resampled intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrank.functions.stats import binomial_half_two_sided, chi2_1_tail, normal_two_sided
from panelrank.operators import metrics, scale, splits

# Sums per replicate and pair of classes: rows, rows with values, errors, truths, truths squared.
SUMS = ("n", "m", "sse", "sy", "syy")


def mcnemar(df: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """2x2 of correctness, chi-squared statistic and p-values (asymptotic and exact)."""
    right_a, right_b = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    counts = df.agg(
        F.count_if(right_a & right_b).alias("both"),
        F.count_if(right_a & ~right_b).alias("only_a"),
        F.count_if(~right_a & right_b).alias("only_b"),
        F.count_if(~right_a & ~right_b).alias("neither"),
    )
    gap = (F.col("only_a") - F.col("only_b")).cast("double")
    discordant = F.col("only_a") + F.col("only_b")
    stat = F.coalesce(F.try_divide(gap * gap, discordant), F.lit(0.0))
    return (
        counts.withColumn("chi2", stat)
        .withColumn("p_value", chi2_1_tail("chi2"))
        .withColumn("p_exact", binomial_half_two_sided("only_a", F.col("only_a") + F.col("only_b")))
    )


def wilcoxon_signed_rank(
    df: DataFrame, a: str, b: str, limit: int = scale.SMALL_BYTES
) -> DataFrame:
    """Signed-rank test of paired values; zero differences drop out, ties share their rank.

    Differences are counted per distinct size, and ranks are running counts over the sizes.
    """
    d = F.round(F.col(a) - F.col(b), 12)
    sizes = (
        df.select(d.alias("d"))
        .filter(F.col("d") != 0)
        .groupBy(F.abs("d").alias("size"))
        .agg(F.count_if(F.col("d") > 0).alias("up"), F.count(F.lit(1)).alias("n"))
    )
    ranked = scale.running_total(sizes, [], ["size"], F.col("n"), "below", limit=limit)
    rank = F.col("below") + (F.col("n") + 1) / F.lit(2.0)
    n = F.col("n").cast("double")
    sums = ranked.agg(
        F.sum("n").alias("pairs"),
        F.sum(rank * F.col("up")).alias("w_plus"),
        F.sum(rank * (F.col("n") - F.col("up"))).alias("w_minus"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    m = F.col("pairs").cast("double")
    variance = m * (m + 1) * (2 * m + 1) / 24 - F.col("_ties") / 48
    low = F.least("w_plus", "w_minus")
    return (
        sums.withColumn("z", F.try_divide(low - m * (m + 1) / 4, F.sqrt(variance)))
        .withColumn("p_value", normal_two_sided("z"))
        .drop("_ties")
    )


def bootstrap_reports(
    df: DataFrame,
    key: Sequence[str],
    truth: str,
    pred: str,
    truth_class: str,
    pred_class: str,
    replicates: int = 200,
    seed: int = 42,
) -> DataFrame:
    """Macro F1, accuracy and R2 of every resampled copy of the prediction table.

    All replicates are summed in one pass: a batch's weights, one column per replicate, are added up
    per pair of classes, so a task sends one row per replicate and pair, however many rows it read.
    """
    keys = splits.replicate_keys(replicates, seed)
    rows = df.select(
        splits.row_numbers(key, seed).alias("number"),
        F.col(truth).cast("double").alias("y"),
        F.col(pred).cast("double").alias("p"),
        F.col(truth_class).alias("truth"),
        F.col(pred_class).alias("pred"),
    )
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("truth", "pred")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            w = splits.drawn_weights(batch["number"].to_numpy(), keys).astype(float)
            known = (batch["y"].notna() & batch["p"].notna()).to_numpy(float)
            y, p = batch["y"].fillna(0.0).to_numpy(), batch["p"].fillna(0.0).to_numpy()
            sums = np.column_stack([np.ones(len(batch)), known, known * (y - p) ** 2, known * y, known * y * y])
            for pair, places in batch.groupby(["truth", "pred"], dropna=False).indices.items():
                part = w[places].T @ sums[places]
                held[pair] = held[pair] + part if pair in held else part
        for (t, p), part in held.items():
            t, p = (None if pd.isna(v) else v for v in (t, p))
            yield pd.DataFrame({"replicate": range(replicates), "truth": t, "pred": p}).assign(
                **{name: part[:, i] for i, name in enumerate(SUMS)}
            )

    schema = f"replicate int, truth {kinds['truth']}, pred {kinds['pred']}, " + ", ".join(f"{n} double" for n in SUMS)
    sums = rows.mapInPandas(run, schema).groupBy("replicate", "truth", "pred")
    counts = sums.agg(*[F.sum(n).alias(n) for n in SUMS]).filter("n > 0")
    classes = metrics.classification_report(counts, by=["replicate"])
    whole = counts.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in SUMS[1:]])
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("m")
    r2 = F.when(total > 1e-12 * F.col("syy"), 1 - F.col("sse") / total)
    return classes.drop("n").join(whole.select("replicate", r2.alias("r2")), "replicate")


def bootstrap_ci(reports: DataFrame, cols: Sequence[str] = ("f1_macro", "accuracy", "r2")) -> DataFrame:
    """2.5 and 97.5 percentiles over the replicates (one row each)."""
    ends = F.array(F.lit(0.025), F.lit(0.975))
    cells = [
        F.struct(
            F.lit(c).alias("metric"),
            F.avg(c).alias("mean"),
            F.percentile(c, ends)[0].alias("lower"),
            F.percentile(c, ends)[1].alias("upper"),
        )
        for c in cols
    ]
    return reports.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def accuracy_normal_ci(df: DataFrame, truth: str, pred: str, z: float = 1.96) -> DataFrame:
    right = F.avg((F.col(truth) == F.col(pred)).cast("int"))
    out = df.agg(F.count(F.lit(1)).alias("n"), right.alias("accuracy"))
    half = z * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n"))
    return out.withColumns({"lower": F.col("accuracy") - half, "upper": F.col("accuracy") + half})


def estimate_632(train: DataFrame, out_of_bag: DataFrame, cols: Sequence[str]) -> DataFrame:
    """0.368 * training score + 0.632 * out-of-bag score, from two one-row reports."""
    return train.select(
        *[(0.368 * F.col(c) + 0.632 * out_of_bag.select(c).scalar()).alias(c) for c in cols]
    )
