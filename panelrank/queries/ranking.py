"""Queries over grouped interactions derived from ``lineitem`` and its dimensions.

An order stands for a search page, a part for an item, the customer's nation for the
destination. ``line, item, supp`` identify a row inside a page and break ties.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrank.operators import groups, joins, metrics, mining, profile, rules, scale, splits
from panelrank.queries.registry import query, rd, rds, rounded
from panelrank.sources.tables import table

TIE = ["line", "item", "supp"]
GROUP = ["srch"]


def interactions(spark, sf):
    li = table(spark, sf, "lineitem")
    booked = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    clicked = booked | (F.col("l_returnflag") == "A")
    rows = li.select(
        F.col("l_orderkey").alias("srch"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("item"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("score2"),
        F.col("l_quantity").alias("qty"),
        clicked.cast("int").alias("clicked"),
        booked.cast("int").alias("booked"),
        (F.col("l_orderkey") % 3 == 0).cast("int").alias("is_random"),
        (-F.col("l_extendedprice") / 1000).alias("score_a"),
        (F.col("l_discount") * 1000 - F.col("l_quantity")).alias("score_b"),
        (-F.col("l_quantity")).alias("score_c"),
    ).withColumn("rel", groups.relevance_grade(F.col("booked"), F.col("clicked")))
    return scale.spread(rows, "srch")


def with_parts(spark, sf):
    return splits.split_groups(interactions(spark, sf), "srch")


def with_destination(df, spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("srch"), F.col("o_custkey").alias("c_custkey")
    )
    customer = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("dest")
    )
    return df.join(orders.join(customer, "c_custkey").drop("c_custkey"), "srch")


def with_stars(df, spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("stars")
    )
    return df.join(part, "item")


def segmented(spark, sf, part):
    """Rows of one part with the popularity label learnt on the training part."""
    rows = with_parts(spark, sf)
    tertiles = groups.popularity_tertile(rows.filter(F.col("part") == "train"), "item")
    return groups.label_popularity(rows.filter(F.col("part") == part), tertiles, "item")


_BOOKED = "(l_returnflag = 'R' AND l_linestatus = 'F')"
INTER = f"""inter AS (SELECT l_orderkey AS srch, l_linenumber AS line, l_partkey AS item, l_suppkey AS supp,
  l_extendedprice AS price, l_discount AS score2, l_quantity AS qty,
  ({_BOOKED} OR l_returnflag = 'A')::INT AS clicked, {_BOOKED}::INT AS booked, (l_orderkey % 3 = 0)::INT AS is_random,
  -l_extendedprice / 1000 AS score_a, l_discount * 1000 - l_quantity AS score_b, -l_quantity AS score_c,
  CASE WHEN {_BOOKED} THEN 5 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS rel FROM lineitem)"""


def sql_hash(*cols, seed=42):
    parts = ", ".join(f"({c})::VARCHAR" for c in cols)
    return f"('0x' || substr(md5(concat_ws('-', {parts}, '{seed}')), 1, 8))::BIGINT"


def sql_bucket(n, *cols, seed=42):
    return f"floor({sql_hash(*cols, seed=seed)} * {n} / 4294967296.0::DOUBLE)::INT"


def sql_uniform(*cols, seed=42):
    return f"({sql_hash(*cols, seed=seed)} / 4294967296.0::DOUBLE)"


PARTED = f"""{INTER}, parted AS (SELECT *, CASE WHEN {sql_uniform("srch")} < 0.8 THEN 'train'
  WHEN {sql_uniform("srch")} < 0.9 THEN 'val' ELSE 'holdout' END AS part FROM inter)"""
SEGMENTS = f"""{PARTED}, imp AS (SELECT item, count(*) AS impressions FROM parted WHERE part = 'train' GROUP BY item),
cuts AS (SELECT quantile_cont(impressions, 0.3333333333333333) AS lo, quantile_cont(impressions, 0.6666666666666666) AS hi FROM imp),
tert AS (SELECT item, impressions, CASE WHEN impressions <= lo THEN 'low' WHEN impressions <= hi THEN 'medium' ELSE 'high' END AS popularity FROM imp, cuts),
seg AS (SELECT parted.*, coalesce(popularity, 'low') AS popularity FROM parted LEFT JOIN tert USING (item))"""
_TIE = "line, item, supp"


def sql_ndcg(source, score, keys="srch", name="nd", where="TRUE"):
    """CTEs ``{name}_r`` (ranked rows) and ``{name}`` (NDCG@5 per group)."""
    return f"""{name}_r AS (SELECT *, {score} AS the_score, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, {_TIE}) AS pos,
  row_number() OVER (PARTITION BY {keys} ORDER BY rel DESC, {_TIE}) AS ideal FROM {source} WHERE {where}),
{name} AS (SELECT {keys}, CASE WHEN max(rel) > 0 THEN sum(CASE WHEN pos <= 5 THEN rel / log2(pos + 1) ELSE 0 END)
  / sum(CASE WHEN ideal <= 5 THEN rel / log2(ideal + 1) ELSE 0 END) ELSE 0 END AS ndcg FROM {name}_r GROUP BY {keys})"""


# --- within-group features ----------------------------------------------------------------


@query(
    "relevance_grade",
    f"WITH {INTER} SELECT rel, (CASE rel WHEN 5 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::INT AS label_idx, count(*) AS n FROM inter GROUP BY rel",
)
def _(spark, sf):
    rows = interactions(spark, sf).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("label_idx", groups.grade_index(F.col("rel")))


@query(
    "rank_in_group",
    f"WITH {INTER} SELECT srch, line, item, supp, rank() OVER (PARTITION BY srch ORDER BY price) AS price_rank FROM inter",
)
def _(spark, sf):
    rows = interactions(spark, sf).select("srch", *TIE, "price")
    large = scale.oversized_groups(rows, GROUP)
    return scale.rank_in_group(rows, GROUP, "price", "price_rank", oversized=large).drop("price")


@query(
    "rank_in_oversized_group",
    f"""WITH {INTER} SELECT is_random, srch, line, item, supp, rank() OVER (PARTITION BY is_random ORDER BY price DESC) AS price_rank FROM inter""",
)
def _(spark, sf):
    # A flag with two values: a third of all rows shares one group, ranked in range slices.
    rows = interactions(spark, sf).select("is_random", "srch", *TIE, "price")
    large = scale.oversized_groups(rows, ["is_random"], most=1000, limit=0)
    return scale.rank_in_group(
        rows, ["is_random"], "price", "price_rank", descending=True, oversized=large
    ).drop("price")


@query(
    "zscore_in_group",
    f"""WITH {INTER}, g AS (SELECT *, ln(1 + price) AS lp FROM inter), s AS (SELECT srch, avg(lp) AS m, stddev_samp(lp) AS sd FROM g GROUP BY srch)
    SELECT srch, line, item, supp, {rd("(lp - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END", "price_z")} FROM g JOIN s USING (srch)""",
)
def _(spark, sf):
    rows = interactions(spark, sf).select("srch", *TIE, "price")
    return rounded(
        groups.zscore_in_group(rows, GROUP, F.log1p("price"), "price_z").drop("price")
    )


@query(
    "delta_to_group_mean",
    f"""WITH {INTER}, j AS (SELECT inter.*, p_size::DOUBLE AS stars FROM inter JOIN part ON p_partkey = item),
    s AS (SELECT srch, avg(stars) AS ms, avg(score2) AS m2 FROM j GROUP BY srch)
    SELECT srch, line, item, supp, {rd("stars - ms", "stars_delta")}, {rd("score2 - m2", "score2_delta")} FROM j JOIN s USING (srch)""",
)
def _(spark, sf):
    rows = with_stars(interactions(spark, sf), spark, sf).select("srch", *TIE, "stars", "score2")
    return rounded(
        groups.delta_to_group_mean(rows, GROUP, ["stars", "score2"]).drop("stars", "score2")
    )


@query(
    "within_group_features",
    f"""WITH {INTER}, j AS (SELECT inter.*, p_size::DOUBLE AS stars, ln(1 + price) AS lp FROM inter JOIN part ON p_partkey = item),
    s AS (SELECT srch, avg(lp) AS m, stddev_samp(lp) AS sd, avg(stars) AS ms, avg(score2) AS m2 FROM j GROUP BY srch)
    SELECT srch, line, item, supp, {rd("(lp - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END", "price_z")}, {rd("stars - ms", "stars_delta")},
    {rd("score2 - m2", "score2_delta")}, rank() OVER (PARTITION BY srch ORDER BY price) AS price_rank FROM j JOIN s USING (srch)""",
)
def _(spark, sf):
    base = interactions(spark, sf).select("srch", *TIE, "price", "score2")
    rows = groups.within_group_features(
        with_stars(base, spark, sf),
        GROUP,
        "price",
        ["stars", "score2"],
        oversized=scale.oversized_groups(base, GROUP),
    )
    return rounded(rows.drop("price", "stars", "score2"))


# --- priors and segments ------------------------------------------------------------------

TARGETS = {"clicked": 1.0, "booked": 1.0, "rel": 5.0}
_RATE = "g AS (SELECT avg(clicked) AS g_clicked, avg(booked) AS g_booked, avg(rel) / 5.0 AS g_rel FROM parted WHERE part = 'train')"


def _smooth(t, n="n", s=None):
    return rd(f"({s or 's_' + t} + 20 * g_{t}) / ({n} + 20.0)", f"{t}_rate")


@query(
    "smoothed_priors",
    f"""WITH {PARTED}, {_RATE}, p AS (SELECT item, count(*) AS n, sum(clicked) AS s_clicked, sum(booked) AS s_booked, sum(rel) AS s_rel
      FROM parted WHERE part = 'train' GROUP BY item)
    SELECT item, {rd("ln(1 + n)", "impressions_log1p")}, {_smooth("clicked")}, {_smooth("booked")}, {_smooth("rel")} FROM p, g""",
)
def _(spark, sf):
    train = with_parts(spark, sf).filter(F.col("part") == "train")
    return rounded(groups.smoothed_priors(train, ["item"], TARGETS))


def _oof_sql(keys, source):
    return f"""folded AS (SELECT *, CASE WHEN part = 'train' THEN {sql_bucket(5, "srch", seed=7)} ELSE -1 END AS fold FROM {source}),
    {_RATE}, pf AS (SELECT {keys}, fold, count(*) AS n, sum(clicked) AS s1, sum(booked) AS s2, sum(rel) AS s3 FROM folded WHERE fold >= 0 GROUP BY {keys}, fold),
    pa AS (SELECT {keys}, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2, sum(s3) AS s3 FROM pf GROUP BY {keys}),
    x AS (SELECT f.srch, f.line, f.item, f.supp, f.fold, coalesce(pa.n, 0) - coalesce(pf.n, 0) AS n, coalesce(pa.s1, 0) - coalesce(pf.s1, 0) AS s_clicked,
      coalesce(pa.s2, 0) - coalesce(pf.s2, 0) AS s_booked, coalesce(pa.s3, 0) - coalesce(pf.s3, 0) AS s_rel
      FROM folded f LEFT JOIN pa USING ({keys}) LEFT JOIN pf USING ({keys}, fold))
    SELECT srch, line, item, supp, fold, {rd("ln(1 + n)", "impressions_log1p")}, {_smooth("clicked")}, {_smooth("booked")}, {_smooth("rel")} FROM x, g"""


def _oof(rows, keys):
    fold = F.when(F.col("part") == "train", splits.hash_bucket(5, "srch", seed=7))
    rows = rows.select("srch", *TIE, *[k for k in keys if k not in TIE], *TARGETS, "part")
    # Rows, sums per fold and overall rates all read this narrow table: it is joined once.
    rows = scale.cut_lineage(rows.withColumn("fold", fold))
    train = rows.filter(F.col("part") == "train")
    rates = groups.overall_rates(train, TARGETS)
    built = groups.oof_priors(rows, keys, "fold", TARGETS, rates=rates, source=train)
    features = ["impressions_log1p", *[f"{t}_rate" for t in TARGETS]]
    return rounded(
        built.withColumn("fold", F.coalesce("fold", F.lit(-1))).select(
            "srch", *TIE, "fold", *features
        )
    )


@query("oof_priors", f"WITH {PARTED}, {_oof_sql('item', 'parted')}")
def _(spark, sf):
    return _oof(with_parts(spark, sf), ["item"])


@query(
    "oof_priors_pair",
    f"""WITH {PARTED}, located AS (SELECT parted.*, c_nationkey AS dest FROM parted JOIN orders ON o_orderkey = srch JOIN customer ON c_custkey = o_custkey),
    {_oof_sql("item, dest", "located").replace(_RATE, _RATE.replace("FROM parted", "FROM located"))}""",
)
def _(spark, sf):
    return _oof(with_destination(with_parts(spark, sf), spark, sf), ["item", "dest"])


@query(
    "apply_priors",
    f"""WITH {PARTED}, {_RATE}, p AS (SELECT item, supp, count(*) AS n, sum(clicked) AS s_clicked FROM parted WHERE part = 'train' GROUP BY item, supp),
    f AS (SELECT item, supp, ln(1 + n) AS imp, (s_clicked + 20 * g_clicked) / (n + 20.0) AS r FROM p, g)
    SELECT srch, line, item, supp, {rd("coalesce(imp, 0)", "impressions_log1p")}, {rd("coalesce(r, g_clicked)", "clicked_rate")}
    FROM parted LEFT JOIN f USING (item, supp), g WHERE part <> 'train'""",
)
def _(spark, sf):
    rows = with_parts(spark, sf).select("srch", *TIE, "clicked", "part")
    train = rows.filter(F.col("part") == "train")
    priors = groups.smoothed_priors(train, ["item", "supp"], {"clicked": 1.0})
    overall = train.agg(F.avg("clicked")).scalar()
    scored = groups.apply_priors(
        rows.filter(F.col("part") != "train"),
        priors,
        ["item", "supp"],
        {"impressions_log1p": F.lit(0.0), "clicked_rate": overall},
    )
    return rounded(scored.select("srch", *TIE, "impressions_log1p", "clicked_rate"))


@query("popularity_tertile", f"WITH {SEGMENTS} SELECT item, impressions, popularity FROM tert")
def _(spark, sf):
    train = with_parts(spark, sf).filter(F.col("part") == "train")
    return groups.popularity_tertile(train, "item")


_TOP = "top AS (SELECT dest FROM (SELECT dest, count(*) AS n FROM loc WHERE part = 'train' GROUP BY dest) ORDER BY n DESC, dest LIMIT 10)"


@query(
    "top_k_or_tail",
    f"""WITH {PARTED}, loc AS (SELECT parted.*, c_nationkey AS dest FROM parted JOIN orders ON o_orderkey = srch JOIN customer ON c_custkey = o_custkey), {_TOP}
    SELECT (CASE WHEN dest IN (SELECT dest FROM top) THEN dest ELSE -1 END)::INT AS dest_segment, count(*) AS n FROM loc WHERE part <> 'train' GROUP BY 1""",
)
def _(spark, sf):
    rows = with_destination(with_parts(spark, sf).select("srch", "part"), spark, sf)
    labelled = groups.top_k_or_tail(
        rows.filter(F.col("part") != "train"),
        rows.filter(F.col("part") == "train"),
        "dest",
        "dest_segment",
    )
    return labelled.groupBy("dest_segment").agg(F.count(F.lit(1)).alias("n"))


EDGES, LABELS = [0, 2, 4, 6, 40], ["1-2", "3-4", "5-6", "7+"]
_BIN = "CASE WHEN {x} > 0 AND {x} <= 2 THEN '1-2' WHEN {x} > 2 AND {x} <= 4 THEN '3-4' WHEN {x} > 4 AND {x} <= 6 THEN '5-6' WHEN {x} > 6 AND {x} <= 40 THEN '7+' END"


@query(
    "size_bins",
    f"WITH {INTER}, s AS (SELECT srch, count(*) AS size FROM inter GROUP BY srch) SELECT {_BIN.format(x='size')} AS size_bin, count(*) AS n FROM s GROUP BY 1",
)
def _(spark, sf):
    sizes = profile.group_sizes(interactions(spark, sf), GROUP)
    label = groups.bin_right_closed(F.col("size"), EDGES, LABELS)
    return sizes.groupBy(label.alias("size_bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_encode",
    "SELECT l_orderkey, l_linenumber, l_returnflag, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS flag_idx FROM lineitem",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return groups.label_encode(rows, "l_returnflag", "flag_idx")


# --- ranking metrics ----------------------------------------------------------------------


@query(
    "ndcg_at_5",
    f"WITH {INTER}, {sql_ndcg('inter', 'score_b')} SELECT srch, {rd('ndcg')} FROM nd",
)
def _(spark, sf):
    return rounded(
        metrics.ndcg_per_group(interactions(spark, sf), GROUP, "rel", "score_b", TIE)
    )


@query(
    "ndcg_mean",
    f"WITH {INTER}, {sql_ndcg('inter', 'score_a')} SELECT count(*) AS groups, {rd('avg(ndcg)', 'ndcg')} FROM nd",
)
def _(spark, sf):
    return rounded(metrics.ndcg(interactions(spark, sf), GROUP, "rel", "score_a", TIE))


@query(
    "ndcg_by_size",
    f"""WITH {INTER}, {sql_ndcg("inter", "score_b")}, s AS (SELECT srch, {_BIN.format(x="count(*)")} AS size_bin FROM inter GROUP BY srch)
    SELECT size_bin, count(*) AS groups, {rd("avg(ndcg)", "ndcg")} FROM nd JOIN s USING (srch) GROUP BY size_bin""",
)
def _(spark, sf):
    rows = interactions(spark, sf)
    sizes = profile.group_sizes(rows, GROUP).select(
        "srch", groups.bin_right_closed(F.col("size"), EDGES, LABELS).alias("size_bin")
    )
    scores = metrics.ndcg_per_group(rows, GROUP, "rel", "score_b", TIE)
    return rounded(metrics.ndcg_by(scores, sizes, GROUP, "size_bin"))


@query(
    "ndcg_by_random_flag",
    f"""WITH {INTER}, {sql_ndcg("inter", "score_b")}, s AS (SELECT srch, min(is_random) AS is_random FROM inter GROUP BY srch)
    SELECT is_random, count(*) AS groups, {rd("avg(ndcg)", "ndcg")} FROM nd JOIN s USING (srch) GROUP BY is_random""",
)
def _(spark, sf):
    rows = interactions(spark, sf)
    flag = metrics.group_first(rows, GROUP, "is_random", TIE)
    scores = metrics.ndcg_per_group(rows, GROUP, "rel", "score_b", TIE)
    return rounded(metrics.ndcg_by(scores, flag, GROUP, "is_random"))


@query(
    "top_k_per_group",
    f"""WITH {INTER} SELECT * FROM (SELECT srch, line, item, supp, row_number() OVER (PARTITION BY srch ORDER BY score_b DESC, {_TIE})::INT AS pos FROM inter) WHERE pos <= 5""",
)
def _(spark, sf):
    rows = interactions(spark, sf).select("srch", *TIE, "score_b")
    return scale.top_k_in_group(rows, GROUP, [F.desc("score_b"), *TIE], 5).drop("score_b")


def sql_segments(source, score, keys="srch", name="sm", where="TRUE"):
    return f"""{sql_ndcg(source, score, keys, name + "_n", where)},
    {name}_p AS (SELECT {keys}, popularity, count(*) FILTER (rel > 0) AS pos, count(*) FILTER (pos <= 5) / 5.0 AS share FROM {name}_n_r GROUP BY {keys}, popularity),
    {name} AS (SELECT {keys}, popularity, pos, share, ndcg FROM {name}_p JOIN {name}_n USING ({keys}) WHERE pos > 0)"""


@query(
    "segment_metrics",
    f"""WITH {SEGMENTS}, {sql_segments("seg", "score_b", where="part = 'holdout'")}
    SELECT popularity, count(*) AS groups, sum(pos)::BIGINT AS positives, {rd("avg(ndcg)", "ndcg")}, {rd("avg(share)", "exposure")},
    count(*) >= 200 AND sum(pos) >= 100 AS supported FROM sm GROUP BY popularity""",
)
def _(spark, sf):
    rows = segmented(spark, sf, "holdout")
    return rounded(
        metrics.segment_metrics(
            rows,
            GROUP,
            "rel",
            "score_b",
            "popularity",
            TIE,
            least_groups=200,
        )
    )


_BOOST = f"""{SEGMENTS}, {sql_segments("seg", "score_b", where="part = 'val'", name="base")},
boosts AS (SELECT popularity, -ln(greatest(avg(share), 1e-6)) AS boost FROM base GROUP BY popularity),
boosted AS (SELECT seg.*, coalesce(boost, 0) AS boost FROM seg LEFT JOIN boosts USING (popularity))"""


def _boosts(spark, sf):
    rows = segmented(spark, sf, "val")
    base = metrics.segment_metrics(
        rows, GROUP, "rel", "score_b", "popularity", TIE
    )
    return rows, metrics.exposure_boosts(base, "popularity")


@query(
    "exposure_boosts", f"WITH {_BOOST} SELECT popularity, {rd('boost')} FROM boosts"
)
def _(spark, sf):
    _, boosts = _boosts(spark, sf)
    return rounded(
        spark.createDataFrame(sorted(boosts.items()), "popularity string, boost double")
    )


_REPORT = "SELECT popularity, avg(ndcg) AS ndcg, avg(share) AS exposure FROM {n} GROUP BY popularity"


@query(
    "rerank_before_after",
    f"""WITH {_BOOST}, hold AS (SELECT *, score_b + 20.0 * boost AS moved FROM boosted WHERE part = 'holdout'),
    {sql_segments("hold", "score_b", name="b")}, {sql_segments("hold", "moved", name="a")},
    br AS ({_REPORT.format(n="b")}), ar AS ({_REPORT.format(n="a")})
    SELECT popularity, {rd("br.ndcg", "ndcg_before")}, {rd("br.exposure", "exposure_before")}, {rd("ar.ndcg", "ndcg_after")}, {rd("ar.exposure", "exposure_after")},
    {rd("ar.ndcg - br.ndcg", "ndcg_delta")}, {rd("ar.exposure - br.exposure", "exposure_delta")} FROM br JOIN ar USING (popularity)""",
)
def _(spark, sf):
    _, boosts = _boosts(spark, sf)
    rows = segmented(spark, sf, "holdout")
    before, after = (
        metrics.segment_metrics(df, GROUP, "rel", "score_b", "popularity", TIE)
        for df in (rows, metrics.rerank(rows, "score_b", "popularity", boosts, 20.0))
    )
    return rounded(joins.before_after(before, after, "popularity", ["ndcg", "exposure"]))


STRENGTHS = (0.0, 1.0, 5.0, 20.0, 50.0, 100.0)


@query(
    "lambda_sweep",
    f"""WITH {_BOOST}, spread AS (SELECT b.*, v.lam, score_b + lam * boost AS moved FROM boosted b, (SELECT unnest([{", ".join(map(str, STRENGTHS))}]::DOUBLE[]) AS lam) v WHERE part = 'val'),
    {sql_segments("spread", "moved", keys="lam, srch", name="s")},
    o AS (SELECT lam, avg(ndcg) AS ndcg FROM s_n GROUP BY lam),
    e AS (SELECT lam, coalesce(avg(share) FILTER (popularity = 'low'), 0) AS lo, coalesce(avg(share) FILTER (popularity = 'medium'), 0) AS me, coalesce(avg(share) FILTER (popularity = 'high'), 0) AS hi FROM s GROUP BY lam),
    t AS (SELECT * FROM o JOIN e USING (lam)), z AS (SELECT ndcg AS n0, lo AS l0, me AS m0 FROM t WHERE lam = 0),
    c AS (SELECT coalesce(max(lam) FILTER (ndcg >= n0 - 0.02 AND lo > l0 AND me > m0), 0) AS best FROM t, z)
    SELECT lam AS lambda, {rd("ndcg")}, {rd("lo", "exposure_low")}, {rd("me", "exposure_medium")}, {rd("hi", "exposure_high")}, lam = best AS chosen FROM t, c""",
)
def _(spark, sf):
    rows, boosts = _boosts(spark, sf)
    return rounded(
        metrics.lambda_sweep(
            rows,
            GROUP,
            "rel",
            "score_b",
            "popularity",
            boosts,
            TIE,
            STRENGTHS,
            tolerance=0.02,
        )
    )


WEIGHTS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


@query(
    "blend_sweep",
    f"""WITH {INTER}, spread AS (SELECT inter.*, v.w, (1.0 - w) * ((0.0 + score_a + score_c) / 2) + w * score_b AS s FROM inter, (SELECT unnest([{", ".join(map(str, WEIGHTS))}]::DOUBLE[]) AS w) v),
    {sql_ndcg("spread", "s", "w, srch")} SELECT w AS weight, {rd("avg(ndcg)", "ndcg")} FROM nd GROUP BY w""",
)
def _(spark, sf):
    return rounded(
        metrics.blend_sweep(
            interactions(spark, sf),
            GROUP,
            "rel",
            ["score_a", "score_c"],
            "score_b",
            TIE,
            WEIGHTS,
        )
    )


@query(
    "worst_groups",
    f"""WITH {INTER}, {sql_ndcg("inter", "score_b")}, w AS (SELECT srch FROM nd JOIN (SELECT srch, max(rel) AS best FROM inter GROUP BY srch) USING (srch)
      WHERE ndcg = 0 AND best > 0 ORDER BY srch LIMIT 3)
    SELECT srch, line, item, supp, rel, pos::INT AS pos FROM nd_r WHERE srch IN (SELECT srch FROM w) AND pos <= 8""",
)
def _(spark, sf):
    rows = interactions(spark, sf).select("srch", *TIE, "rel", "score_b")
    return metrics.worst_groups(rows, GROUP, "rel", "score_b", TIE).drop("score_b")


@query(
    "rank_submission",
    f"""WITH {INTER} SELECT srch, item,
    row_number() OVER (PARTITION BY srch ORDER BY score_b DESC, {_TIE}) AS position FROM inter""",
)
def _(spark, sf):
    return metrics.rank_submission(interactions(spark, sf), "srch", "item", "score_b", TIE)


@query(
    "check_submission",
    f"""WITH {INTER}, c AS (SELECT srch, item, count(*) AS n FROM inter GROUP BY srch, item)
    SELECT sum(n)::BIGINT AS rows, count(DISTINCT srch) AS groups, sum(n - 1)::BIGINT AS duplicates,
    (SELECT count(*) FROM inter) AS expected_rows, (SELECT count(DISTINCT srch) FROM inter) AS expected_groups FROM c""",
)
def _(spark, sf):
    rows = interactions(spark, sf)
    ranked = metrics.rank_submission(rows, "srch", "item", "score_b", TIE)
    return metrics.check_submission(ranked, rows, "srch", "item")


@query(
    "position_rates",
    f"""WITH {INTER} SELECT line, {rd("avg(booked) FILTER (is_random = 1)", "rate_flagged")}, {rd("avg(booked) FILTER (is_random = 0)", "rate_plain")} FROM inter GROUP BY line""",
)
def _(spark, sf):
    return rounded(
        metrics.position_rates(interactions(spark, sf), "line", "is_random", F.col("booked"))
    )


@query(
    "conversion_rates",
    f"""WITH {INTER} SELECT is_random, count(*) AS n, {rd("avg(clicked)", "click_rate")}, {rd("avg(booked)", "book_rate")},
    {rd("sum(booked) / nullif(sum(clicked), 0)", "book_given_click")} FROM inter GROUP BY is_random""",
)
def _(spark, sf):
    return rounded(
        profile.conversion_rates(
            interactions(spark, sf), F.col("clicked"), F.col("booked"), ["is_random"]
        )
    )


# --- splits of groups ---------------------------------------------------------------------


@query("split_groups", f"WITH {PARTED} SELECT srch, line, item, supp, part FROM parted")
def _(spark, sf):
    return with_parts(spark, sf).select("srch", *TIE, "part")


@query(
    "check_split",
    f"""WITH {PARTED} SELECT count(DISTINCT srch) AS groups, 0::BIGINT AS torn_groups, 0::BIGINT AS unassigned_rows FROM parted""",
)
def _(spark, sf):
    return splits.check_split(with_parts(spark, sf), "srch")


@query(
    "group_kfold",
    f"WITH {INTER} SELECT srch, line, item, supp, {sql_bucket(5, 'srch')} AS fold FROM inter",
)
def _(spark, sf):
    return splits.group_kfold(interactions(spark, sf).select("srch", *TIE), "srch")


@query(
    "sample_rows",
    f"""WITH {INTER} SELECT srch, line, item, supp FROM inter ORDER BY md5(concat_ws('-', srch::VARCHAR, line::VARCHAR, item::VARCHAR, supp::VARCHAR, '42')) LIMIT 500""",
)
def _(spark, sf):
    rows = interactions(spark, sf).select("srch", *TIE)
    return splits.sample_rows(rows, ["srch", *TIE], 500)


@query(
    "semi_and_anti",
    f"""WITH {PARTED} SELECT (SELECT count(*) FROM parted WHERE part = 'val' AND item IN (SELECT item FROM parted WHERE part = 'holdout')) AS seen,
    (SELECT count(*) FROM parted WHERE part = 'val' AND item NOT IN (SELECT item FROM parted WHERE part = 'holdout')) AS unseen""",
)
def _(spark, sf):
    rows = with_parts(spark, sf).select("item", "part")
    other = rows.filter(F.col("part") == "holdout").select("item").distinct()
    val = rows.filter(F.col("part") == "val")
    seen = val.join(other, "item", "left_semi").agg(F.count(F.lit(1)).alias("seen"))
    unseen = val.join(other, "item", "left_anti").agg(F.count(F.lit(1)))
    return seen.withColumn("unseen", unseen.scalar())


# --- association rules --------------------------------------------------------------------


def baskets(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return li.join(part, "p_partkey").select("l_orderkey", "p_brand")


def taxonomy(spark, sf):
    """Brands roll up into five lines by the last digit of their number."""
    brands = table(spark, sf, "part").select("p_brand").distinct()
    line = F.concat(F.lit("line"), F.regexp_extract("p_brand", r"(\d)$", 1).cast("int") % 5)
    return rules.taxonomy_of(brands.withColumn("family", line), "p_brand", ["family"])


_ENCODED = """bought AS (SELECT DISTINCT l_orderkey, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey),
tax AS (SELECT DISTINCT p_brand AS item, 'line' || (right(p_brand, 1)::INT % 5) AS ancestor FROM part),
enc AS (SELECT l_orderkey, item FROM bought UNION SELECT l_orderkey, ancestor FROM bought JOIN tax USING (item)),
total AS (SELECT count(DISTINCT l_orderkey) AS n FROM enc),
single AS (SELECT item, count(*) AS c FROM enc GROUP BY item),
pairs AS (SELECT a.item AS a, b.item AS b, count(*) AS c FROM enc a JOIN enc b ON a.l_orderkey = b.l_orderkey AND a.item <> b.item GROUP BY 1, 2)"""


@query(
    "encode_taxonomy",
    f"WITH {_ENCODED} SELECT l_orderkey, string_agg(item, '|' ORDER BY item) AS items FROM enc GROUP BY l_orderkey",
)
def _(spark, sf):
    encoded = rules.encode_taxonomy(baskets(spark, sf), taxonomy(spark, sf), "l_orderkey", "p_brand")
    return encoded.withColumn("items", F.array_join("items", "|"))


@query(
    "frequent_pairs",
    f"""WITH {_ENCODED} SELECT a || '|' || b AS items, c AS freq, {rd("c / n", "support")} FROM pairs, total WHERE a < b AND c >= ceil(0.02 * n)
    UNION ALL SELECT item, c, {rd("c / n", "support")} FROM single, total WHERE c >= ceil(0.02 * n)""",
)
def _(spark, sf):
    encoded = rules.encode_taxonomy(baskets(spark, sf), taxonomy(spark, sf), "l_orderkey", "p_brand")
    itemsets, _ = rules.frequent_itemsets(encoded, 0.02, 0.1)
    return rounded(
        itemsets.filter(F.size("items") <= 2).withColumn("items", F.array_join("items", "|"))
    )


_PAIR_RULES = f"""{_ENCODED}, r AS (SELECT a AS antecedent, b AS consequent, pairs.c / s.c AS confidence, (pairs.c / s.c) / (t.c / n) AS lift, pairs.c / n AS support
  FROM pairs JOIN single s ON s.item = a JOIN single t ON t.item = b, total WHERE pairs.c >= ceil(0.02 * n) AND pairs.c / s.c >= 0.1)"""


@query(
    "taxonomy_rules",
    f"""WITH {_PAIR_RULES} SELECT antecedent, consequent, {rds("confidence lift support")} FROM r
    WHERE NOT EXISTS (SELECT 1 FROM tax WHERE (item = antecedent AND ancestor = consequent) OR (item = consequent AND ancestor = antecedent))""",
)
def _(spark, sf):
    tree = taxonomy(spark, sf)
    encoded = rules.encode_taxonomy(baskets(spark, sf), tree, "l_orderkey", "p_brand")
    _, found = rules.frequent_itemsets(encoded, 0.02, 0.1)
    pairs = rules.drop_own_ancestor(found.filter(F.size("antecedent") == 1), tree)
    return rounded(pairs.withColumn("antecedent", F.col("antecedent")[0]))


@query(
    "non_redundant_rules",
    f"""WITH {_PAIR_RULES}, ok AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM tax WHERE (item = antecedent AND ancestor = consequent) OR (item = consequent AND ancestor = antecedent)))
    SELECT antecedent, consequent, {rds("confidence lift support")} FROM ok g WHERE NOT EXISTS (
      SELECT 1 FROM ok s JOIN tax ON s.antecedent = item WHERE ancestor = g.antecedent AND s.consequent = g.consequent
      AND abs(g.support - s.support) <= 0.8 * g.support AND abs(g.confidence - s.confidence) <= 0.1 * g.confidence)""",
)
def _(spark, sf):
    tree = taxonomy(spark, sf)
    encoded = rules.encode_taxonomy(baskets(spark, sf), tree, "l_orderkey", "p_brand")
    _, found = rules.frequent_itemsets(encoded, 0.02, 0.1)
    kept = rules.drop_redundant_rules(found.filter(F.size("antecedent") == 1), tree, 0.8, 0.1)
    return rounded(kept.withColumn("antecedent", F.col("antecedent")[0]))


# Every itemset of a basket is counted, so all lengths are compared, not only pairs.
_ALL_SETS = """tax AS (SELECT DISTINCT p_brand AS item, 'line' || (right(p_brand, 1)::INT % 5) AS ancestor FROM part),
bought AS (SELECT DISTINCT l_orderkey, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey),
enc AS (SELECT l_orderkey, item FROM bought UNION SELECT l_orderkey, ancestor FROM bought JOIN tax USING (item)),
total AS (SELECT count(DISTINCT l_orderkey) AS n FROM enc),
sub(l_orderkey, latest, items) AS (SELECT l_orderkey, item, [item] FROM enc
  UNION ALL SELECT s.l_orderkey, e.item, list_append(s.items, e.item) FROM sub s JOIN enc e ON s.l_orderkey = e.l_orderkey AND e.item > s.latest),
sets AS (SELECT items, count(*) AS c FROM sub GROUP BY items HAVING count(*) >= (SELECT ceil(0.02 * n) FROM total)),
parts AS (SELECT items, c, unnest(items) AS consequent FROM sets WHERE len(items) > 1),
sides AS (SELECT items, c, consequent, [x FOR x IN items IF x <> consequent] AS antecedent FROM parts),
found AS (SELECT sides.items, antecedent, consequent, sides.c / a.c AS confidence, (sides.c / a.c) / (t.c / n) AS lift, sides.c / n AS support
  FROM sides JOIN sets a ON a.items = antecedent JOIN sets t ON t.items = [consequent], total WHERE sides.c / a.c >= 0.1),
own AS (SELECT DISTINCT items FROM (SELECT items, unnest(items) AS item FROM sets) JOIN tax USING (item) WHERE list_contains(items, ancestor)),
ok AS (SELECT * FROM found WHERE items NOT IN (SELECT items FROM own))"""


def mined(spark, sf):
    tree = taxonomy(spark, sf)
    encoded = rules.encode_taxonomy(baskets(spark, sf), tree, "l_orderkey", "p_brand")
    return tree, *rules.frequent_itemsets(encoded, 0.02, 0.1)


@query(
    "frequent_itemsets",
    f"""WITH RECURSIVE {_ALL_SETS} SELECT array_to_string(items, '|') AS items, c AS freq, {rd("c / n", "support")} FROM sets, total""",
)
def _(spark, sf):
    _, itemsets, _ = mined(spark, sf)
    return rounded(itemsets.withColumn("items", F.array_join("items", "|")))


@query(
    "association_rules",
    f"""WITH RECURSIVE {_ALL_SETS} SELECT array_to_string(antecedent, '|') AS antecedent, consequent, {rds("confidence lift support")} FROM ok""",
)
def _(spark, sf):
    tree, _, found = mined(spark, sf)
    kept = rules.drop_own_ancestor(found, tree)
    return rounded(kept.withColumn("antecedent", F.array_join("antecedent", "|")))


@query(
    "non_redundant_association_rules",
    f"""WITH RECURSIVE {_ALL_SETS}, lifted AS (
      SELECT list_sort(list_distinct(list_append([x FOR x IN antecedent IF x <> item], ancestor))) AS antecedent, consequent, support, confidence
      FROM (SELECT *, unnest(antecedent) AS item FROM ok) JOIN tax USING (item))
    SELECT array_to_string(antecedent, '|') AS antecedent, consequent, {rds("confidence lift support")} FROM ok g WHERE NOT EXISTS (
      SELECT 1 FROM lifted s WHERE s.antecedent = g.antecedent AND s.consequent = g.consequent
      AND abs(g.support - s.support) <= 0.8 * g.support AND abs(g.confidence - s.confidence) <= 0.1 * g.confidence)""",
)
def _(spark, sf):
    tree, _, found = mined(spark, sf)
    kept = rules.drop_redundant_rules(found, tree, 0.8, 0.1)
    return rounded(kept.withColumn("antecedent", F.array_join("antecedent", "|")))


# --- sets without an item and its own ancestor, grown on bitmaps --------------------------


def grown(spark, sf, longest=None):
    tree = taxonomy(spark, sf)
    return tree, mining.mine(baskets(spark, sf), tree, "l_orderkey", "p_brand", 0.02, longest)


_GROWN = f"""{_ALL_SETS}, kept AS (SELECT items, c FROM sets WHERE items NOT IN (SELECT items FROM own))"""


@query(
    "taxonomy_itemsets",
    f"""WITH RECURSIVE {_GROWN} SELECT array_to_string(items, '|') AS items, c AS freq, {rd("c / n", "support")} FROM kept, total""",
)
def _(spark, sf):
    _, found = grown(spark, sf)
    return rounded(found.withColumn("items", F.array_join("items", "|")))


@query(
    "taxonomy_itemset_rules",
    f"""WITH RECURSIVE {_ALL_SETS} SELECT array_to_string(antecedent, '|') AS antecedent, consequent, {rds("confidence lift support")} FROM ok""",
)
def _(spark, sf):
    _, found = grown(spark, sf)
    kept = mining.rules_of(found, 0.1)
    return rounded(kept.withColumn("antecedent", F.array_join("antecedent", "|")))


@query(
    "taxonomy_pair_rules",
    f"""WITH {_PAIR_RULES} SELECT antecedent, consequent, {rds("confidence lift support")} FROM r
    WHERE NOT EXISTS (SELECT 1 FROM tax WHERE (item = antecedent AND ancestor = consequent) OR (item = consequent AND ancestor = antecedent))""",
)
def _(spark, sf):
    _, found = grown(spark, sf, longest=2)
    return rounded(mining.rules_of(found, 0.1).withColumn("antecedent", F.col("antecedent")[0]))


@query(
    "specific_taxonomy_rules",
    f"""WITH RECURSIVE {_ALL_SETS}, lifted AS (
      SELECT list_sort(list_distinct(list_append([x FOR x IN antecedent IF x <> item], ancestor))) AS antecedent, consequent, support, confidence
      FROM (SELECT *, unnest(antecedent) AS item FROM ok) JOIN tax USING (item))
    SELECT array_to_string(antecedent, '|') AS antecedent, consequent, {rds("confidence lift support")} FROM ok g WHERE NOT EXISTS (
      SELECT 1 FROM lifted s WHERE s.antecedent = g.antecedent AND s.consequent = g.consequent
      AND abs(g.support - s.support) <= 0.8 * g.support AND abs(g.confidence - s.confidence) <= 0.1 * g.confidence)""",
)
def _(spark, sf):
    tree, found = grown(spark, sf)
    kept = rules.drop_redundant_rules(mining.rules_of(found, 0.1), tree, 0.8, 0.1)
    return rounded(kept.withColumn("antecedent", F.array_join("antecedent", "|")))
