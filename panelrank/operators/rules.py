"""Association rules over baskets with an item taxonomy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrank.operators import scale


def encode_taxonomy(baskets: DataFrame, taxonomy: DataFrame, basket: str, item: str) -> DataFrame:
    """Each basket's distinct items plus all their ancestors, as an array.

    ``taxonomy`` has (item, ancestor) with one row per ancestor, roots without a row. The
    array holds distinct labels, so its length is bounded by the vocabulary.
    """
    above = taxonomy.groupBy("item").agg(F.collect_set("ancestor").alias("_above"))
    labels = F.concat(F.array("item"), F.coalesce("_above", F.array().cast(above.schema["_above"].dataType)))
    return (
        scale.join_lookup(baskets.select(basket, F.col(item).alias("item")), above, ["item"])
        .select(basket, labels.alias("_labels"))
        .groupBy(basket)
        .agg(F.collect_set("_labels").alias("_held"))
        .select(basket, F.array_sort(F.array_compact(F.array_distinct(F.flatten("_held")))).alias("items"))
    )


def frequent_itemsets(
    encoded: DataFrame, min_support: float, min_confidence: float
) -> tuple[DataFrame, DataFrame]:
    """Itemsets with support, and single-consequent rules with confidence, lift and support.

    Mining reads the baskets several times, so they are written once to the shared folder, equal
    ones side by side: a task's tree then holds few baskets of other tasks. The itemsets are written
    too: the model would mine again for every use of its sets or rules.
    """
    encoded = scale.cut_lineage(encoded.select("items").hint("rebalance", "items"))
    total = encoded.count()
    model = FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence
    ).fit(encoded)
    itemsets = scale.cut_lineage(
        model.freqItemsets.select(
            F.array_sort("items").alias("items"), "freq", (F.col("freq") / F.lit(total)).alias("support")
        )
    )
    return itemsets, scale.cut_lineage(rules_of(itemsets, min_confidence))


def rules_of(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """Rules with one consequent from all sets of two or more: confidence, lift and support.

    Parts of a frequent set are frequent, so both sides are found among the sets themselves.
    """
    sides = itemsets.filter(F.size("items") > 1).select(
        "items", "freq", "support", F.explode("items").alias("consequent")
    )
    sides = sides.withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    before = itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("n_before"))
    after = itemsets.filter(F.size("items") == 1).select(
        F.col("items")[0].alias("consequent"), F.col("support").alias("share")
    )
    confidence = F.col("freq") / F.col("n_before")
    return (
        sides.join(before, "antecedent")
        .filter(confidence >= min_confidence)
        .join(after, "consequent")
        .select(
            "antecedent", "consequent", confidence.alias("confidence"),
            (confidence / F.col("share")).alias("lift"), "support",
        )
    )


def drop_own_ancestor(rules: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Drop rules that hold an item together with its own ancestor anywhere."""
    keyed = rules.withColumn("_all", F.array_union("antecedent", F.array("consequent")))
    members = keyed.select("antecedent", "consequent", "_all", F.explode("_all").alias("item"))
    trivial = (
        members.join(taxonomy, "item")
        .filter(F.array_contains("_all", F.col("ancestor")))
        .select("antecedent", "consequent")
        .distinct()
    )
    return rules.join(trivial, ["antecedent", "consequent"], "left_anti")


def drop_redundant_rules(
    rules: DataFrame,
    taxonomy: DataFrame,
    support_gap: float = 0.1,
    confidence_gap: float = 0.1,
) -> DataFrame:
    """Drop a generalisation whose support and confidence are close to a more specific rule's.

    A rule generalises another if one antecedent item is replaced by its ancestor.
    """
    clean = drop_own_ancestor(rules, taxonomy)
    specific = (
        clean.withColumn("item", F.explode("antecedent"))
        .join(taxonomy, "item")
        .select(
            F.array_sort(
                F.array_union(
                    F.array_remove("antecedent", F.col("item")), F.array("ancestor")
                )
            ).alias("antecedent"),
            "consequent",
            F.col("support").alias("_support"),
            F.col("confidence").alias("_confidence"),
        )
    )
    redundant = (
        clean.join(specific, ["antecedent", "consequent"])
        .filter(
            (F.abs(F.col("support") - F.col("_support")) <= support_gap * F.col("support"))
            & (
                F.abs(F.col("confidence") - F.col("_confidence"))
                <= confidence_gap * F.col("confidence")
            )
        )
        .select("antecedent", "consequent")
        .distinct()
    )
    return clean.join(redundant, ["antecedent", "consequent"], "left_anti")


def pair_rules(
    encoded: DataFrame, basket: str, min_support: float, min_confidence: float
) -> DataFrame:
    """Rules between two single items."""
    _, rules = frequent_itemsets(encoded, min_support, min_confidence)
    return rules.filter(F.size("antecedent") == 1).withColumn(
        "antecedent", F.col("antecedent")[0]
    )


def taxonomy_of(items: DataFrame, item: str, parents: Sequence[str]) -> DataFrame:
    """(item, ancestor) rows from the parent columns of an item table."""
    levels = [
        items.select(F.col(item).alias("item"), F.col(p).alias("ancestor")) for p in parents
    ]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.filter(F.col("ancestor").isNotNull()).distinct()
