"""Interactions to a ranked submission and its audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrank.operators import groups, metrics, ml, paged, ranker, scale, splits


@dataclass(frozen=True)
class RankingColumns:
    group: str
    item: str
    price: str
    rel: str
    tie: Sequence[str]
    targets: Mapping[str, float]
    deltas: Sequence[str] = ()
    prior_keys: Sequence[Sequence[str]] = ()
    folds: int = 5
    seed: int = 42


def ranking_features(
    df: DataFrame, c: RankingColumns, pages: DataFrame | None = None
) -> DataFrame:
    """Split, within-group features and out-of-fold priors per key set.

    Prior columns carry the key set's names as a prefix. Within-group features are made where the
    rows arrive, which is by group if they were last joined on it. The table is then written once: each key
    set's sums and the rates read a few of its columns, and the rows, with the key sets of most columns
    (the largest lookups) first; they carry sums, and priors are made from them at the end. ``pages``
    may name a cheaper table with the same group sizes to look for oversized groups in.
    """
    fold = F.when(
        F.col("part") == "train", splits.hash_bucket(c.folds, c.group, seed=c.seed + 1)
    )
    base = splits.split_groups(df, c.group, seed=c.seed).withColumn("fold", fold)
    large = scale.oversized_groups(df if pages is None else pages, [c.group])
    if large is not None:
        base = scale.cut_lineage(base)
    base = groups.within_group_features(base, [c.group], c.price, c.deltas, oversized=large)
    rows = base = scale.cut_lineage(base)
    train = base.filter(F.col("part") == "train")
    rates = groups.overall_rates(train, c.targets)
    names = {"_".join(keys): keys for keys in c.prior_keys}
    for prefix, keys in sorted(names.items(), key=lambda e: -len(e[1])):
        source = train.select(*keys, "fold", *c.targets)
        rows = groups.oof_sums(rows, keys, "fold", c.targets, source, prefix=f"_{prefix}")
    priors: dict[str, Column] = {}
    for prefix in names:
        priors |= groups.oof_features(c.targets, rates, prefix=f"_{prefix}", out=f"{prefix}_")
    return rows.select(*base.columns, *[prior.alias(name) for name, prior in priors.items()])


def feature_columns(rows: DataFrame, c: RankingColumns) -> list[str]:
    made = [f"{c.price}_z", f"{c.price}_rank", *[f"{d}_delta" for d in c.deltas]]
    for keys in c.prior_keys:
        prefix = "_".join(keys)
        made += [f"{prefix}_impressions_log1p", *[f"{prefix}_{t}_rate" for t in c.targets]]
    return [name for name in made if name in rows.columns]


def _scaled_features(
    df: DataFrame, c: RankingColumns, pages: DataFrame | None
) -> tuple[DataFrame, list[str]]:
    """Features in units of their spread on the training part, written once."""
    rows = scale.cut_lineage(ranking_features(df, c, pages))
    cols = feature_columns(rows, c)
    ready = rows.fillna(0.0, cols)
    train = ready.filter(F.col("part") == "train")
    ready = ready.withColumns({n: F.col(n).cast("double") for n in cols})
    return ml.standardise(ready, ml.scaling(train, cols)), cols


def _quality(scored: DataFrame, c: RankingColumns) -> DataFrame:
    return (
        metrics.ndcg_per_group(scored, ["part", c.group], c.rel, "score", c.tie)
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("groups"), F.avg("ndcg").alias("ndcg"))
    )


def fit_and_rank(
    df: DataFrame, c: RankingColumns, pages: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Linear ranker learnt on the training part: (submission, NDCG per part).

    The feature table is written once; fitting and scoring both read it.
    """
    scaled, cols = _scaled_features(df, c, pages)
    weights = ml.fit_ranker(scaled.filter(F.col("part") == "train"), [c.group], cols, c.rel)
    scored = scaled.withColumn("score", ml.linear_score(weights))
    quality = _quality(scored, c)
    submission = metrics.rank_submission(scored, c.group, c.item, "score", c.tie)
    return submission, quality


def fit_pairs_and_rank(
    df: DataFrame, c: RankingColumns, pages: DataFrame | None = None, steps: int = 8
) -> DataFrame:
    """NDCG per part of the ranker learnt from contrasts, and of the one refined on pairs from there.

    Scaled rows move once more, by page; learning and scoring read the pages where they lie.
    """
    with scale.shuffles_dropped(df.sparkSession):
        scaled, cols = _scaled_features(df, c, pages)
        arranged = paged.arrange(scaled, [c.group], cols, c.rel, c.tie, keep=["part"], sizes=pages)
        train, val = (arranged.filter(F.col("part") == p) for p in ("train", "val"))
        start = ml.fit_ranker(train, [c.group], cols, c.rel)
        refined, _ = ranker.fit(train, val, [c.group], cols, c.rel, c.tie, start=start, steps=steps)
    out = [
        ranker.page_ndcg(arranged, w).groupBy("part").agg(F.count(F.lit(1)).alias("groups"), F.avg("ndcg").alias(name))
        for name, w in (("contrasts", start), ("pairs", refined))
    ]
    return out[0].join(out[1].drop("groups"), "part")
