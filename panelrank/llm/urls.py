"""URL filters: rules by host and path, and link-graph propagation for every other url.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
there up to ``?``, ``#`` or the end. A missing url, or one without ``://``, has neither. A rule
(host, path, verdict) fits its host and all subdomains, if the path starts with the rule's; the
longest fitting rule wins.

A url that no rule fits takes the verdict of its host. Each host starts with the share of its
pages that allow rules judge (trust) and that block rules judge (distrust). Trust follows links:
personalised PageRank from the trusted hosts over the edges from host to host. Distrust runs
against them: a host that links to distrusted hosts takes part of their distrust. Both are sums
in DataFrame functions, one join and one aggregation (combined before the shuffle) a round,
written to the shared folder after each. A host is blocked if its distrust exceeds its trust by
more than ``threshold`` of what a host without links has whose pages are all blocked.

Edges are links with a host of their own in ``href`` or ``src``; links inside a host are none. A
url without a host, and a host without any evidence, are allowed. Repeated pages count again in
shares and edges; a missing html has no links. Where pages hold relative links only, there are no
edges, and a host keeps what its own pages give it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrank.operators.scale import cut_lineage

Rule = tuple[str, str, str]  # host, path, allow or block

DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-6
# Hosts with two numbers each that may go to all executors.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct (rule, verdict); missing if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = (host == rule_host) | host.endswith("." + rule_host)
        named = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits & path.startswith(rule_path), named).otherwise(out)
    return out


def seeds(judged: DataFrame) -> DataFrame:
    """(host, trust, distrust): the shares of each host's pages that rules allow and block."""
    one = lambda verdict: F.avg(
        F.when(F.col("rule.verdict") == verdict, 1.0).otherwise(0.0)
    )
    return (
        judged.filter("host <> ''")
        .groupBy("host")
        .agg(one("allow").alias("trust"), one("block").alias("distrust"))
    )


def edges(pages: DataFrame, host: Column, html: str) -> DataFrame:
    """(src, dst, n): how many pages of a host link to another host."""
    linked = F.explode(
        F.array_distinct(
            F.transform(
                F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1)),
                lambda h: F.translate(h, _UPPER, _LOWER),
            )
        )
    )
    return (
        pages.select(host.alias("src"), linked.alias("dst"))
        .filter("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(
    start: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """(host, trust, distrust), each within ``tolerance`` of where the rounds lead.

    What a round still moves shrinks by ``damping``, so their number follows from the tolerance;
    they end earlier if nothing moves by more than it.

    ``start`` has one row per host that has pages; hosts that are only linked to start at zero.
    """
    known = start.select("host").union(links.select("dst")).distinct()
    start = cut_lineage(
        known.join(start, "host", "left").select(
            "host",
            F.coalesce("trust", F.lit(0.0)).alias("trust0"),
            F.coalesce("distrust", F.lit(0.0)).alias("distrust0"),
        )
    )
    outward = links.groupBy("src").agg(F.sum("n").alias("out"))
    inward = links.groupBy("dst").agg(F.sum("n").alias("in"))
    weighed = links.join(outward, "src").join(inward, "dst")
    # Trust goes along a link, distrust against it; each host deals out what it has by its links.
    moves = cut_lineage(
        weighed.select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out")).alias("t"), F.lit(0.0).alias("d")),
                    F.struct(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("in")).alias("d")),
                )
            ).alias("m")
        ).select("m.*")
    )
    state = start.select("host", ((1 - damping) * F.col("trust0")).alias("trust"), ((1 - damping) * F.col("distrust0")).alias("distrust"))
    if moves.isEmpty():
        return state
    for _ in range(math.ceil(math.log(tolerance) / math.log(damping))):
        came = (
            moves.join(state, "host")
            .groupBy("to")
            .agg(F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
        )
        old = state.select("host", F.col("trust").alias("was_t"), F.col("distrust").alias("was_d"))
        new = cut_lineage(
            start.join(came, F.col("host") == F.col("to"), "left")
            .join(old, "host")
            .select(
                "host",
                ((1 - damping) * F.col("trust0") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
                ((1 - damping) * F.col("distrust0") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
                "was_t",
                "was_d",
            )
        )
        moved = new.agg(
            F.max(F.greatest(F.abs(F.col("trust") - F.col("was_t")), F.abs(F.col("distrust") - F.col("was_d"))))
        ).first()[0]
        state = new.select("host", "trust", "distrust")
        if moved is None or moved <= tolerance * (1 - damping):
            break
    return state


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = DAMPING,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """For every page: id, host, path, rule (missing if none fits), verdict, trust, distrust."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    placed = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    judged = placed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    found = propagate(cut_lineage(seeds(judged)), cut_lineage(edges(pages, host, html_col)), damping)
    distrusted = F.col("distrust") - F.col("trust") > threshold * (1 - damping)
    hosts = cut_lineage(
        found.select("host", "trust", "distrust", F.when(distrusted, "block").otherwise("allow").alias("by_host"))
    )
    if hosts.count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    return judged.join(hosts, "host", "left").select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("rule.rule").alias("rule"),
        F.coalesce("rule.verdict", "by_host", F.lit("allow")).alias("verdict"),
        "trust",
        "distrust",
    )
