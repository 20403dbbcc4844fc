"""Merkle manifest of a dataset: one digest for the table, and a proof for every row.

Rows become leaves: the digest of their fields. Inside every group leaves follow an order, and runs
of ``fanout`` consecutive nodes become one parent until one node is left, the group's subroot; the
subroots, ordered by group, become the root in the same way. A run may be short, even a single node;
a lone node is not hashed again.

Slot pivot: a node at place p sits in slot ``p % fanout`` of the parent at place ``p // fanout``.
Conditional aggregates spread a parent's children into one column per slot. All columns together
hash to the parent; without the row's own slot they are its siblings, split into those before and
those after it, which is what a proof needs.

Scale: places come from range slices (``scale.running_total``), so a group may hold any share of the
table. A block of ``fanout ** levels`` consecutive nodes lies in one partition, and all its levels
are done there: going up, aggregates reduce every block to one row; the same is done with those rows
until one per group is left; coming down, each block takes its own path from the row above it. So
the table is shuffled once for the order, once going up and once coming down, whatever its height,
and no task ever holds more of a group than blocks. Nothing but the height reaches the driver.

Defined results: a missing field counts as ``-``, which no present value can look like; rows without
an order value come first, groups without a name too; rows alike in every field are interchangeable;
rows with the same order value are ordered by their leaf; a table without rows has no manifest rows;
further columns, whatever their names, do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrank.operators import scale
from panelrank.operators.scale import cut_lineage

# Nodes of one block: what a partition turns into a subtree at a time.
BLOCK = 1024
STEP = "struct<before: string, after: string>"


def digest(parts: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other; missing parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: every field with its length in bytes, ``-`` where it is missing."""
    text = [f.cast("string") for f in fields]
    return digest(
        [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    )


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Place ``pos`` of every node in its group ``g``, and the group's number of nodes ``n``.

    Nodes alike in all of ``order`` get different places by a row number, which is written
    before it is used.
    """
    rows = cut_lineage(nodes.withColumn("_row", F.monotonically_increasing_id()))
    rows = scale.running_total(rows, ["g"], [*order, "_row"], F.lit(1).cast("long"), "pos", limit=0)
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return scale.join_lookup(rows.drop("_row"), sizes, ["g"], "inner")


def _levels(fanout: int) -> int:
    return max(1, int(math.log(BLOCK, fanout)))


def _blocks(nodes: DataFrame, fanout: int) -> DataFrame:
    size = fanout ** _levels(fanout)
    block = F.floor(F.col("pos") / size).cast("long")
    return nodes.withColumn("_block", block).repartition("g", "_block")


def _up(pos: Column, n: Column, fanout: int) -> tuple[Column, Column]:
    """Place of a node's parent, and the number of nodes on the parent's level."""
    return F.floor(pos / fanout).cast("long"), F.ceil(n / fanout).cast("long")


def climb(nodes: DataFrame, fanout: int) -> DataFrame:
    """Every block's top node: (g, pos, n, digest) of the level above all blocks."""
    rows = _blocks(nodes.select("g", "pos", "n", "digest"), fanout)
    slots = [f"_s{j}" for j in range(fanout)]
    for _ in range(_levels(fanout)):
        slot = F.col("pos") % fanout
        parent, count = _up(F.col("pos"), F.col("n"), fanout)
        rows = rows.groupBy("g", "_block", parent.alias("pos")).agg(
            F.max("n").alias("_n"),
            F.max(count).alias("n"),
            *[F.max(F.when(slot == j, F.col("digest"))).alias(s) for j, s in enumerate(slots)],
        )
        alone = F.col("_n") == 1
        rows = rows.select(
            "g", "_block", "pos", "n",
            F.when(alone, F.col(slots[0])).otherwise(digest([F.col(s) for s in slots])).alias("digest"),
        )
    return rows.drop("_block")


def _paths(rows: DataFrame, fanout: int) -> DataFrame:
    """Steps from every node to the top of its block, as column ``_own``."""
    slots = [f"_s{j}" for j in range(fanout)]
    kept = rows.columns
    rows = rows.withColumns({"_d": F.col("digest"), "_p": F.col("pos"), "_n": F.col("n")})
    steps = []
    for level in range(_levels(fanout)):
        slot = F.col("_p") % fanout
        rows = rows.withColumn("_up", F.floor(F.col("_p") / fanout).cast("long"))
        family = Window.partitionBy("g", "_block", "_up")
        rows = rows.withColumns(
            {s: F.max(F.when(slot == j, F.col("_d"))).over(family) for j, s in enumerate(slots)}
        )
        sides = [
            F.concat_ws("", *[F.when(side, F.col(s)) for s, side in zip(slots, chosen)])
            for chosen in ([F.lit(j) < slot for j in range(fanout)], [F.lit(j) > slot for j in range(fanout)])
        ]
        step = F.struct(sides[0].alias("before"), sides[1].alias("after"))
        steps.append(f"_step{level}")
        more = F.col("_n") > 1
        rows = rows.withColumn(steps[-1], F.when(more, step)).select(
            *kept,
            *steps,
            F.when(more, digest([F.col(s) for s in slots])).otherwise(F.col("_d")).alias("_d"),
            F.col("_up").alias("_p"),
            F.ceil(F.col("_n") / fanout).cast("long").alias("_n"),
        )
    own = F.filter(F.array(*steps), lambda s: s.isNotNull())
    return rows.select(*kept, own.alias("_own"))


def stories(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The nodes, the tops of their blocks, the tops of blocks of those, up to one per group."""
    found = [nodes]
    while (found[-1].agg(F.max("n").alias("n")).first()["n"] or 1) > 1:
        found.append(cut_lineage(climb(found[-1], fanout)))
    return found


def prove(found: Sequence[DataFrame], fanout: int) -> DataFrame:
    """The nodes of the lowest story with ``top``, their group's last digest, and the ``proof`` of it."""
    none = F.array().cast(f"array<{STEP}>")
    rows = found[-1].withColumns({"top": F.col("digest"), "proof": none})
    for nodes in reversed(found[:-1]):
        above = rows.select("g", F.col("pos").alias("_block"), "top", F.col("proof").alias("_later"))
        rows = _paths(_blocks(nodes, fanout).join(above, ["g", "_block"]), fanout)
        rows = rows.select(*nodes.columns, "top", F.concat("_own", "_later").alias("proof"))
    return rows


def folded(start: Column, proof: Column) -> Column:
    """The digest a proof leads to from ``start``."""
    return F.aggregate(proof, start, lambda h, s: digest([s["before"], h, s["after"]]))


def siblings(proof: Column) -> Column:
    """All digests of a proof in order, as one text."""
    return F.concat_ws("", F.transform(proof, lambda s: F.concat(s["before"], s["after"])))


def manifest(
    docs: DataFrame,
    order: str,
    group: str,
    fields: Sequence[str],
    fanout: int = 2,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: order value, leaf, subroot, root and the proof of the leaf.

    ``keep`` names further columns computed from the row, such as another leaf to try.
    """
    name = F.col(f"`{group}`").cast("string")
    # Ordered like the names, with the rows without one first.
    key = F.coalesce(F.concat(F.lit("="), name), F.lit(""))
    rows = docs.select(
        key.alias("g"),
        F.col(f"`{order}`").alias("_order"),
        leaf([F.col(f"`{f}`") for f in fields]).alias("digest"),
        *[c.alias(f"_keep_{k}") for k, c in (keep or {}).items()],
    )
    trees = stories(cut_lineage(placed(rows, ["_order", "digest"])), fanout)
    tops = trees[-1].select(F.lit("").alias("g"), F.col("g").alias("_name"), "digest")
    upper = prove(stories(cut_lineage(placed(tops, ["_name"])), fanout), fanout).select(
        F.col("_name").alias("g"),
        F.col("digest").alias("subroot"),
        F.col("top").alias("root"),
        F.col("proof").alias("_upper"),
    )
    leaves = prove(trees, fanout)
    found = scale.join_lookup(leaves, upper, ["g"], "inner")
    return found.select(
        F.col("_order").alias(order),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.concat("proof", "_upper").alias("proof"),
        *[F.col(f"_keep_{k}").alias(k) for k in (keep or {})],
    )
