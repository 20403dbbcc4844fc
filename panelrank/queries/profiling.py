"""Descriptive queries over events, the panel and the dimension tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrank.operators import clean, impute, profile, scale
from panelrank.queries.panel import (
    ALL,
    BY,
    CLEAN,
    COLS,
    FILLED,
    PANEL,
    M,
    cleaned,
    interpolated,
    measurements,
    panel,
)
from panelrank.queries.ranking import INTER, interactions
from panelrank.queries.registry import query, rd, rounded
from panelrank.sources.tables import table


@query(
    "variable_stats",
    f"""WITH {M}, v AS (SELECT variable, CASE WHEN value BETWEEN 1 AND 200 THEN value END AS value FROM m)
    SELECT variable, count(*) AS n, count(*) - count(value) AS missing, {rd("100.0 * (count(*) - count(value)) / count(*)", "missing_pct")},
    {rd("avg(value)", "mean")}, {rd("stddev_samp(value)", "std")}, {rd("quantile_cont(value, 0.5)", "median")}, min(value) AS "min", max(value) AS "max"
    FROM v GROUP BY variable""",
)
def _(spark, sf):
    rows = clean.null_out_of_range(measurements(spark, sf), {"value": (1.0, 200.0)})
    return rounded(profile.variable_stats(rows))


def _profile_sql(c):
    return f"""SELECT '{c}' AS "column", count({c}) AS n, {rd(f"avg({c})", "mean", 4)}, {rd(f"stddev_samp({c})", "std", 4)}, {rd(f"min({c})", '"min"', 4)}, {rd(f"max({c})", '"max"', 4)},
    {rd(f"100.0 * (count(*) - count({c})) / count(*)", "missing_pct", 4)}, {rd(f"100.0 * count(*) FILTER ({c} = 0) / count(*)", "zero_pct", 4)}, count(DISTINCT {c}) AS n_unique FROM lineitem"""


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("column_profile", " UNION ALL ".join(_profile_sql(c) for c in NUMBERS))
def _(spark, sf):
    return rounded(profile.column_profile(table(spark, sf, "lineitem"), NUMBERS), 4)


@query(
    "column_classes",
    f"""WITH p AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, count(DISTINCT {c}) AS n FROM lineitem" for c in NUMBERS)})
    SELECT col AS "column", n AS n_unique, CASE WHEN n <= 1 THEN 'constant' WHEN n = 2 THEN 'binary' WHEN n = 3 THEN 'ternary' WHEN n <= 40 THEN 'discrete' ELSE 'continuous' END AS kind FROM p""",
)
def _(spark, sf):
    return profile.column_classes(profile.column_profile(table(spark, sf, "lineitem"), NUMBERS))


@query(
    "value_counts",
    f"""WITH {CLEAN} SELECT clicks, count(*) AS n, {rd("count(*) * 100.0 / (SELECT count(*) FROM clean)", "pct")} FROM clean GROUP BY clicks""",
)
def _(spark, sf):
    return rounded(profile.value_counts(cleaned(spark, sf), "clicks"))


@query(
    "value_counts_wide",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", nullif(count(*) FILTER ({c} = 'A'), 0) AS "A", nullif(count(*) FILTER ({c} = 'F'), 0) AS "F",
        nullif(count(*) FILTER ({c} = 'N'), 0) AS "N", nullif(count(*) FILTER ({c} = 'O'), 0) AS "O", nullif(count(*) FILTER ({c} = 'R'), 0) AS "R" FROM lineitem"""
        for c in ("l_returnflag", "l_linestatus")
    ),
)
def _(spark, sf):
    return profile.value_counts_wide(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["A", "F", "N", "O", "R"]
    )


@query(
    "cardinality",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey")
    ),
)
def _(spark, sf):
    return profile.cardinality(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"]
    )


@query(
    "share_of_rows_in_other",
    f"""SELECT count(*) AS n, {rd("avg((o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))::INT)", "share")} FROM orders""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    other = table(spark, sf, "customer").filter("c_acctbal > 0")
    return rounded(profile.share_of_rows_in_other(orders, other, "c_custkey"))


def _missing_sql(by):
    cells = ", ".join(rd(f"100.0 * (count(*) - count({c})) / count(*)", c) for c in COLS)
    return f"WITH {CLEAN} SELECT {by}{cells} FROM clean"


@query("missing_matrix", _missing_sql("id, ") + " GROUP BY id")
def _(spark, sf):
    return rounded(profile.missing_matrix(cleaned(spark, sf), COLS))


@query("missing_by_column", _missing_sql(""))
def _(spark, sf):
    return rounded(profile.missing_matrix(cleaned(spark, sf), COLS, by=()))


@query(
    "group_size_stats",
    f"""WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey)
    SELECT count(*) AS groups, min(size) AS "min", {rd("quantile_cont(size, 0.5)", "median")}, {rd("avg(size)", "mean")},
    {rd("quantile_cont(size, 0.95)", "p95")}, {rd("quantile_cont(size, 0.99)", "p99")}, max(size) AS "max" FROM s""",
)
def _(spark, sf):
    return rounded(profile.group_size_stats(table(spark, sf, "lineitem"), ["l_orderkey"]))


@query(
    "group_size_ecdf",
    f"""WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey), c AS (SELECT size, count(*) AS n FROM s GROUP BY size)
    SELECT size, n, {rd("sum(n) OVER (ORDER BY size) / (SELECT sum(n) FROM c)", "share")} FROM c""",
)
def _(spark, sf):
    return rounded(profile.group_size_ecdf(table(spark, sf, "lineitem"), ["l_orderkey"]))


@query(
    "histogram",
    f"""WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events),
    c AS (SELECT least(floor((value - lo) / w) + 1, 30)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1),
    b AS (SELECT unnest(range(1, 31))::INT AS bin) SELECT bin, {rd("lo + (bin - 1) * w", "lower")}, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin), e""",
)
def _(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "events"), "value", 30))


@query(
    "mean_std_by_weekday",
    f"""WITH {M} SELECT (isodow(date) - 1)::INT AS weekday, count(value) AS n, {rd("avg(value)", "mean")}, {rd("stddev_samp(value)", "std")} FROM m GROUP BY 1""",
)
def _(spark, sf):
    rows = measurements(spark, sf)
    return rounded(profile.mean_std_by(rows, F.weekday("date"), "weekday", "value"))


@query(
    "mean_std_by_date",
    f"""WITH {M} SELECT date, count(value) AS n, {rd("avg(value)", "mean")}, {rd("stddev_samp(value)", "std")} FROM m WHERE variable = 'view' GROUP BY date""",
)
def _(spark, sf):
    rows = measurements(spark, sf).filter(F.col("variable") == "view")
    return rounded(profile.mean_std_by(rows, F.col("date"), "date", "value"))


def _pairs_sql(source, cols):
    parts = [
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {source}"
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    ]
    return " UNION ALL ".join(parts)


@query(
    "correlation_pairs",
    f"WITH {FILLED} SELECT a, b, {rd('r')} FROM ({_pairs_sql('filled', COLS)})",
)
def _(spark, sf):
    return rounded(profile.correlation_pairs(interpolated(spark, sf), COLS))


@query(
    "correlation_with",
    f"WITH {CLEAN} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {rd(f"corr({c}, mood)", "r")} FROM clean""" for c in COLS[1:]
    ),
)
def _(spark, sf):
    return rounded(profile.correlation_with(cleaned(spark, sf), COLS[1:], "mood"))


@query(
    "top_correlated_pairs",
    f"SELECT a, b, {rd('r')} FROM ({_pairs_sql('lineitem', NUMBERS)}) ORDER BY abs(r) DESC LIMIT 3",
)
def _(spark, sf):
    return rounded(profile.top_correlated_pairs(table(spark, sf, "lineitem"), NUMBERS, 3))


@query(
    "spearman_matrix",
    f"""WITH {INTER}, r AS (SELECT {", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("score_a", "score_b", "score_c"))} FROM inter)
    SELECT a, b, {rd("r", "rho")} FROM ({_pairs_sql("r", ["score_a", "score_b", "score_c"])})""",
)
def _(spark, sf):
    rows = interactions(spark, sf)
    return rounded(profile.spearman_matrix(rows, ["score_a", "score_b", "score_c"]))


_HOLES = ["mood", "strain", "spend"]


@query(
    "correlation_pairs_with_holes",
    f"WITH {CLEAN} SELECT a, b, {rd('r')} FROM ({_pairs_sql('clean', COLS)})",
)
def _(spark, sf):
    return rounded(profile.correlation_pairs(cleaned(spark, sf), COLS))


@query(
    "spearman_with_holes",
    f"""WITH {CLEAN}, r AS (SELECT {", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}" for c in _HOLES)} FROM clean)
    SELECT a, b, {rd("r", "rho")} FROM ({_pairs_sql("r", _HOLES)})""",
)
def _(spark, sf):
    return rounded(profile.spearman_matrix(cleaned(spark, sf), _HOLES))


@query(
    "ols_line",
    f"""SELECT count(*) AS n, {rd("regr_slope(l_extendedprice, l_quantity)", "slope", 4)}, {rd("regr_intercept(l_extendedprice, l_quantity)", "intercept", 4)},
    {rd("corr(l_extendedprice, l_quantity)", "r", 4)}, {rd("regr_r2(l_extendedprice, l_quantity)", "r2", 4)} FROM lineitem""",
)
def _(spark, sf):
    return rounded(
        profile.ols_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), 4
    )


@query(
    "shape_report",
    f"WITH {CLEAN} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {rd(f"skewness({x})", "skew")}, {rd(f"kurtosis({x})", "kurtosis")} FROM clean"""
        for c, x in (("mood", "mood"), ("spend", "spend"), ("log_spend", "ln(1 + spend)"))
    ),
)
def _(spark, sf):
    rows = cleaned(spark, sf).withColumn("log_spend", F.log1p("spend"))
    return rounded(profile.shape_report(rows, ["mood", "spend", "log_spend"]))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, sf):
    return profile.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "same_timestamps_check",
    f"""WITH {M}, h AS (SELECT id, variable, date_trunc('day', time) AS time FROM m WHERE variable IN ('view', 'error', 'click')),
    t AS (SELECT id, time, count(DISTINCT variable) AS k FROM h GROUP BY id, time)
    SELECT id, count(*) AS times, min(k) = 3 AS all_equal FROM t GROUP BY id""",
)
def _(spark, sf):
    rows = measurements(spark, sf).withColumn("time", F.date_trunc("day", "time"))
    return profile.same_timestamps_check(rows, ["view", "error", "click"])


def _slots_sql(unit, seconds):
    return f"""WITH {M}, s AS (SELECT DISTINCT id, floor(epoch(time) / {seconds})::BIGINT AS slot FROM m WHERE variable = 'view')
    SELECT id, max(slot) - min(slot) + 1 AS expected, count(*) AS observed, max(slot) - min(slot) + 1 - count(*) AS missing FROM s GROUP BY id"""


@query("missing_slots", _slots_sql("DAY", 86400))
def _(spark, sf):
    return profile.missing_slots(measurements(spark, sf), "view")


@query("missing_hour_slots", _slots_sql("HOUR", 3600))
def _(spark, sf):
    return profile.missing_slots(measurements(spark, sf), "view", "HOUR")


def _slot_list_sql(unit: str) -> str:
    return f"""WITH {M}, seen AS (SELECT DISTINCT id, date_trunc('{unit}', time) AS slot FROM m WHERE variable = 'view'),
    ends AS (SELECT id, min(slot) AS a, max(slot) AS b FROM seen GROUP BY id),
    every AS (SELECT id, unnest(generate_series(a, b, INTERVAL 1 {unit})) AS slot FROM ends)
    SELECT id, slot::TIMESTAMP AS slot FROM every ANTI JOIN seen USING (id, slot)"""


@query("missing_slot_list", _slot_list_sql("DAY"))
def _(spark, sf):
    return profile.missing_slot_list(measurements(spark, sf), "view")


@query("missing_hour_slot_list", _slot_list_sql("HOUR"))
def _(spark, sf):
    return profile.missing_slot_list(measurements(spark, sf), "view", "HOUR")


_TOPCORR = f"""{FILLED}, c AS ({" UNION ALL ".join(f"SELECT id, '{c}' AS col, CASE WHEN stddev_pop({c}) > 0 AND stddev_pop(mood) > 0 THEN corr({c}, mood) END AS r FROM filled WHERE {c} IS NOT NULL AND mood IS NOT NULL GROUP BY id" for c in COLS[1:])}),
k AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY abs(round(r, 9)) DESC, col))::INT AS place, col AS "column", r FROM c WHERE r IS NOT NULL)"""


@query(
    "per_key_top_corr",
    f'WITH {_TOPCORR} SELECT id, place, "column", {rd("r")} FROM k WHERE place <= 2',
)
def _(spark, sf):
    return rounded(profile.per_key_top_corr(interpolated(spark, sf), COLS[1:], "mood", 2))


@query("feature_union", f'WITH {_TOPCORR} SELECT DISTINCT "column" FROM k WHERE place <= 2')
def _(spark, sf):
    return profile.feature_union(
        profile.per_key_top_corr(interpolated(spark, sf), COLS[1:], "mood", 2)
    )


@query(
    "lag1_autocorr",
    f"""WITH {CLEAN}, l AS (SELECT id, mood, lag(mood) OVER {BY} AS prev FROM clean WHERE mood IS NOT NULL)
    SELECT id, count(*) AS n, {rd("corr(mood, prev)", "r")} FROM l GROUP BY id HAVING count(*) > 10""",
)
def _(spark, sf):
    return rounded(profile.lag1_autocorr_per_id(cleaned(spark, sf), "mood"))


_ACF = f"""{CLEAN}, x AS (SELECT id, date, mood - avg(mood) OVER (PARTITION BY id) AS x FROM clean WHERE mood IS NOT NULL)"""
_ACF_POOLED = f"""{_ACF}, p AS (SELECT x, row_number() OVER (ORDER BY id, date) AS rn FROM x),
a AS ({" UNION ALL ".join(f"SELECT {k} AS lag, (SELECT sum(u.x * v.x) FROM p u JOIN p v ON v.rn = u.rn - {k}) / (SELECT sum(x * x) FROM p) AS r" for k in range(1, 15))})"""


@query(
    "acf",
    f"""WITH {_ACF_POOLED} SELECT lag::INT AS lag, {rd("r")}, (SELECT count(*) FROM p) AS n, {rd("1.96 / sqrt((SELECT count(*) FROM p))", "band")} FROM a""",
)
def _(spark, sf):
    return rounded(profile.acf_pooled(cleaned(spark, sf), "mood"))


@query(
    "acf_per_id",
    f"""WITH {_ACF}, l AS (SELECT id, x, {", ".join(f"lag(x, {k}) OVER {BY} AS l{k}" for k in (1, 2, 3))} FROM x)
    SELECT id, n, lag, {rd("r")} FROM (""" + " UNION ALL ".join(
        f"SELECT id, count(*) AS n, {k} AS lag, sum(x * l{k}) / CASE WHEN sum(x * x) > 1e-12 THEN sum(x * x) END AS r FROM l GROUP BY id"
        for k in (1, 2, 3)
    )
    + ")",
)
def _(spark, sf):
    return rounded(profile.acf_per_id(cleaned(spark, sf), "mood", 3))


@query(
    "pacf_per_id",
    f"""WITH {_ACF}, l AS (SELECT id, x, lag(x, 1) OVER {BY} AS l1, lag(x, 2) OVER {BY} AS l2 FROM x),
    r AS (SELECT id, sum(x * l1) / CASE WHEN sum(x * x) > 1e-12 THEN sum(x * x) END AS r1, sum(x * l2) / CASE WHEN sum(x * x) > 1e-12 THEN sum(x * x) END AS r2 FROM l GROUP BY id)
    SELECT id, 1 AS lag, {rd("CASE WHEN r2 IS NOT NULL THEN r1 END", "pacf")} FROM r UNION ALL
    SELECT id, 2, {rd("CASE WHEN abs(1 - r1 * r1) >= 1e-12 THEN (r2 - r1 * r1) / (1 - r1 * r1) END", "pacf")} FROM r""",
)
def _(spark, sf):
    return rounded(profile.pacf_per_id(cleaned(spark, sf), "mood", 2))


# Upper tail of the chi-squared law with ``lag`` degrees of freedom, x = t * t from sqrt(q) on, by
# Simpson's rule; 40 further on nothing is left.
_TAIL = """0.01::DOUBLE / 3 * list_sum([(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 2
  * exp((lag - 1) * ln(greatest(sqrt(q) + i * 0.01::DOUBLE, 1e-12)) - (sqrt(q) + i * 0.01::DOUBLE) ** 2 / 2 - lag / 2.0::DOUBLE * ln(2.0::DOUBLE) - lgamma(lag / 2.0::DOUBLE))
  FOR i IN range(0, 4001)])"""


@query(
    "ljung_box",
    f"""WITH {_ACF_POOLED}, n AS (SELECT count(*) AS n FROM p),
    q AS (SELECT lag::INT AS lag, n * (n + 2) * sum(r * r / (n - lag)) OVER (ORDER BY lag) AS q FROM a, n)
    SELECT lag, {rd("q", digits=4)}, {rd(_TAIL, "p_value", 4)} FROM q""",
)
def _(spark, sf):
    return rounded(profile.ljung_box(profile.acf_pooled(cleaned(spark, sf), "mood")), 4)


_G = "g AS (SELECT sum(mood * mood) AS a, sum(strain * strain) AS b, sum(spend * spend) AS c, sum(mood * strain) AS ab, sum(mood * spend) AS ac, sum(strain * spend) AS bc FROM filled WHERE mood IS NOT NULL AND strain IS NOT NULL AND spend IS NOT NULL), d AS (SELECT *, a * (b * c - bc * bc) - ab * (ab * c - bc * ac) + ac * (ab * bc - b * ac) AS det FROM g)"


@query(
    "vif",
    f"""WITH {FILLED}, {_G} SELECT 'mood' AS "column", {rd("a * (b * c - bc * bc) / det", "vif", 4)} FROM d
    UNION ALL SELECT 'strain', {rd("b * (a * c - ac * ac) / det", "vif", 4)} FROM d UNION ALL SELECT 'spend', {rd("c * (a * b - ab * ab) / det", "vif", 4)} FROM d""",
)
def _(spark, sf):
    return rounded(profile.vif(interpolated(spark, sf), ["mood", "strain", "spend"]), 4)


@query(
    "boxplot_by_variable",
    f"""WITH {M} SELECT variable, count(*) AS n, min(value) AS "min", {rd("quantile_cont(value, 0.25)", "q1")}, {rd("quantile_cont(value, 0.5)", "median")},
    {rd("quantile_cont(value, 0.75)", "q3")}, max(value) AS "max" FROM m GROUP BY variable""",
)
def _(spark, sf):
    return rounded(profile.boxplot_stats(measurements(spark, sf), ["variable"], "value"))


@query(
    "boxplot_by_id",
    f"""WITH {CLEAN} SELECT id, count(mood) AS n, min(mood) AS "min", {rd("quantile_cont(mood, 0.25)", "q1")}, {rd("quantile_cont(mood, 0.5)", "median")},
    {rd("quantile_cont(mood, 0.75)", "q3")}, max(mood) AS "max" FROM clean WHERE mood IS NOT NULL GROUP BY id""".replace(
        'min(mood) AS "min"', rd("min(mood)", '"min"')
    ).replace('max(mood) AS "max"', rd("max(mood)", '"max"')),
)
def _(spark, sf):
    return rounded(profile.boxplot_stats(cleaned(spark, sf), ["id"], "mood"))


@query(
    "imputation_report",
    f"""WITH {FILLED}, ff AS (SELECT coalesce(last_value(mood IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(mood IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM clean),
    s AS (SELECT 'original' AS method, mood AS v FROM clean UNION ALL SELECT 'linear', mood FROM filled UNION ALL SELECT 'fill', v FROM ff)
    SELECT method, count(v) AS n, {rd("avg(v)", "mean")}, {rd("stddev_samp(v)", "std")}, {rd("skewness(v)", "skew")}, {rd("quantile_cont(v, 0.5)", "median")} FROM s GROUP BY method""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood")
    return rounded(
        impute.imputation_report(
            {
                "original": rows,
                "linear": impute.interpolate_linear(rows, ["mood"]),
                "fill": impute.forward_backward_fill(rows, ["mood"]),
            },
            "mood",
        )
    )


@query(
    "quantiles_by_range_slices",
    f"""SELECT l_returnflag, 'l_extendedprice' AS "column", count(*) AS n, {rd("quantile_cont(l_extendedprice, 0.05)", "p05", 4)}, {rd("quantile_cont(l_extendedprice, 0.5)", "p50", 4)}, {rd("quantile_cont(l_extendedprice, 0.99)", "p99", 4)}
    FROM lineitem GROUP BY l_returnflag""",
)
def _(spark, sf):
    # The path for tables beyond one task: values ranked in range slices.
    found = scale.quantiles(
        table(spark, sf, "lineitem"),
        ["l_extendedprice"],
        [0.05, 0.5, 0.99],
        by=["l_returnflag"],
        limit=0,
    )
    q = F.col("q")
    return rounded(
        found.select(
            "l_returnflag", "column", "n", q[0].alias("p05"), q[1].alias("p50"), q[2].alias("p99")
        ),
        4,
    )


@query(
    "panel_size",
    f"WITH {PANEL} SELECT count(*) AS n, count(DISTINCT id) AS ids, {', '.join(f'count({c}) AS {c}' for c in ALL.split())} FROM panel",
)
def _(spark, sf):
    return panel(spark, sf).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("ids"),
        *[F.count(c).alias(c) for c in COLS],
    )
