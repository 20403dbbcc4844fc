"""Model-layer queries: preparation, neighbours, selection, fits and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrank.operators import groups, information, ml, neighbours, ranker, scale, splits
from panelrank.plans.cleaning import CleanOptions, clean_daily
from panelrank.plans.experiment import Experiment, run_experiment
from panelrank.plans.instances import FeatureOptions, build_instances, feature_names
from panelrank.plans.ranking import (
    RankingColumns,
    fit_and_rank,
    fit_pairs_and_rank,
    ranking_features,
)
from panelrank.queries.panel import (
    BOUNDS,
    BY,
    CLEAN,
    COLS,
    F7,
    FILLED,
    RULES,
    _EWSTD,
    _F3,
    _N5,
    _autocorr,
    _ffill,
    _roll,
    _rolling_sql,
    interpolated,
    measurements,
)
from panelrank.queries.ranking import (
    GROUP,
    INTER,
    TARGETS,
    TIE,
    interactions,
    sql_bucket,
    sql_uniform,
    with_destination,
    with_stars,
)
from panelrank.queries.registry import query, rd, rounded
from panelrank.sources.tables import table

# --- cleaning and features as one flow ----------------------------------------------------

ROLES = dict(
    rules=RULES,
    target="mood",
    bounds=BOUNDS,
    continuous=["mood", "strain"],
    durations=["spend", "clicks", "signups"],
    zero_fill_cols=["clicks", "signups"],
)


@query(
    "clean_daily_iqr_fill",
    f"""WITH {CLEAN}, q AS (SELECT quantile_cont(spend, 0.25) AS a, quantile_cont(spend, 0.75) AS b, quantile_cont(strain, 0.25) AS c, quantile_cont(strain, 0.75) AS d FROM clean),
    o AS (SELECT id, date, mood, CASE WHEN strain BETWEEN c - 1.5 * (d - c) AND d + 1.5 * (d - c) THEN strain END AS strain,
      CASE WHEN spend BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN spend END AS spend, clicks, signups FROM clean, q)
    SELECT id, date, {", ".join(rd(f"coalesce({_ffill(c)}, 0)", c) for c in COLS)} FROM o""",
)
def _(spark, sf):
    options = CleanOptions(**ROLES, outlier_cols=["spend", "strain"], outlier_strength=1.5)
    return rounded(clean_daily(measurements(spark, sf), options))


@query(
    "clean_daily_winsor_linear",
    f"""WITH {CLEAN}, q AS (SELECT quantile_cont(spend, 0.05) AS a, quantile_cont(spend, 0.95) AS b FROM clean),
    w AS (SELECT id, date, mood, strain, CASE WHEN spend < a THEN a WHEN spend > b THEN b ELSE spend END AS spend,
      CASE WHEN clicks > 2 THEN 2 ELSE clicks END AS clicks, CASE WHEN signups > 2 THEN 2 ELSE signups END AS signups FROM clean, q),
    r AS (SELECT *, count(mood) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM w),
    g AS (SELECT id, run, count(*) AS len FROM r WHERE mood IS NULL GROUP BY id, run),
    k AS (SELECT r.* FROM r LEFT JOIN g ON r.id = g.id AND r.run = g.run WHERE NOT (mood IS NULL AND coalesce(len, 0) > 3)),
    n AS (SELECT *, (row_number() OVER {BY})::DOUBLE AS rn FROM k),
    f AS (SELECT id, date, {", ".join(f"last_value({c} IGNORE NULLS) OVER b AS {c}_a, last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS {c}_ar, first_value({c} IGNORE NULLS) OVER f AS {c}_b, first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS {c}_br, {c}" for c in COLS)}, rn FROM n
      WINDOW b AS (PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT id, date, {", ".join(rd(f"coalesce({c}, {c}_a + ({c}_b - {c}_a) * (rn - {c}_ar) / nullif({c}_br - {c}_ar, 0), {c}_a, {c}_b, 0)", c) for c in COLS[:3])},
    {rd("ln(1 + " + "coalesce(clicks, clicks_a + (clicks_b - clicks_a) * (rn - clicks_ar) / nullif(clicks_br - clicks_ar, 0), clicks_a, clicks_b, 0)) + ln(1 + coalesce(signups, signups_a + (signups_b - signups_a) * (rn - signups_ar) / nullif(signups_br - signups_ar, 0), signups_a, signups_b, 0))", "counts")} FROM f""",
)
def _(spark, sf):
    roles = {**ROLES, "durations": ["clicks", "signups"]}
    options = CleanOptions(
        **roles,
        outlier_cols=["spend"],
        winsor=(5, 95),
        cap=2.0,
        delete_gaps_over=3,
        imputation="linear",
        log_durations=True,
        groups={"counts": ["clicks", "signups"]},
    )
    return rounded(clean_daily(measurements(spark, sf), options))


FEATURES = FeatureOptions(
    target="mood",
    cols=COLS,
    extra_lags={"strain": 2, "spend": 2},
    apps=["spend", "clicks", "signups"],
    productive=["spend"],
    leisure=["clicks", "signups"],
    pair=("strain", "mood"),
    product_with="strain",
    ratio=("spend", "clicks"),
    ema_cols=["mood", "strain", "spend"],
    change_cols=COLS,
    short_cols=["mood", "strain"],
    same_day_cols=["spend", "clicks"],
    level_cuts=(40.0, 60.0),
    volatility=True,
    momentum=True,
    autocorr=True,
    rmssd=True,
    adaptive=True,
    study_day=True,
    weekend_distance=True,
    missing_share=True,
    variation=True,
)


_SIGN = ", ".join(
    f"coalesce(sign(lag(mood, {i}) OVER {BY} - lag(mood, {i + 1}) OVER {BY}), 0) AS s{i}"
    for i in range(1, 8)
)
_RUN = (
    "CASE WHEN s1 = 0 THEN 0 "
    + " ".join(f"WHEN s{i + 1} <> s1 THEN {i}" for i in range(1, 7))
    + " ELSE 7 END"
)
_NEXT = "CASE n " + " ".join(f"WHEN {i} THEN s{i + 1}" for i in range(1, 7)) + " ELSE 0 END"
_ROLLED = [f"{c}_{a}" for c in COLS for a in ("mean", "std", "min", "max", "trend")]
_FLAT = {
    **{f"mood_lag{i}": f"lag(mood, {i}) OVER {BY}" for i in (1, 2, 3)},
    **{f"{c}_lag{i}": f"lag({c}, {i}) OVER {BY}" for c in ("strain", "spend") for i in (1, 2)},
    "mood_range": f"max(mood) OVER {F7} - min(mood) OVER {F7}",
    "mood_cv": f"CASE WHEN avg(mood) OVER {F7} > 0 THEN stddev_samp(mood) OVER {F7} / avg(mood) OVER {F7} ELSE 0 END",
    "mood_direction": f"sign(lag(mood, 1) OVER {BY} - lag(mood, 2) OVER {BY})",
    **{f"{c}_change": f"coalesce(lag({c}, 1) OVER {BY} - lag({c}, 2) OVER {BY}, 0)" for c in COLS},
    **{f"{c}_std3": f"stddev_samp({c}) OVER {_F3}" for c in ("mood", "strain")},
    **{
        f"{c}_same_day": f"CASE WHEN lead(date) OVER {BY} IS NOT NULL THEN {c} END"
        for c in ("spend", "clicks")
    },
    "missing_share_7": f"avg((5 - ({_N5})) / 5.0) OVER {F7}",
    **{f"{c}_{a}": _roll(c, a) for c in COLS for a in ("mean", "std", "min", "max", "trend")},
}
_EMAS = [f"{c}_ema{n}" for c in ("mood", "strain", "spend") for n in (3, 7)]


def _ema_cell(c, span):
    weight = f"power({1 - 2 / (span + 1)!r}, a.rn - 1 - b.rn)"
    return f"sum({weight} * b.{c}) / nullif(sum(CASE WHEN b.{c} IS NOT NULL THEN {weight} END), 0) AS {c}_ema{span}"


_TOTAL = "(coalesce(y_spend, 0) + coalesce(y_clicks, 0) + coalesce(y_signups, 0))"
_ENTROPY = " + ".join(
    f"CASE WHEN y_{c} > 0 THEN (y_{c} / {_TOTAL}) * ln(y_{c} / {_TOTAL}) ELSE 0 END"
    for c in ("spend", "clicks", "signups")
)
_DOW = "(isodow(date) - 1)"
_PLACE = """CASE WHEN abs(strain_mean) < 0.1 AND abs(mood_mean) < 0.1 THEN 0 WHEN mood_mean >= 0 AND strain_mean >= 0 THEN 1
  WHEN mood_mean < 0 AND strain_mean >= 0 THEN 2 WHEN mood_mean < 0 AND strain_mean < 0 THEN 3 ELSE 4 END"""
_INSTANCE_SQL = f"""WITH {FILLED}, rowed AS (SELECT *, row_number() OVER {BY} AS rn FROM filled),
flat AS (SELECT id, date, rn, mood AS target, (date - min(date) OVER (PARTITION BY id))::INT AS study_day,
  {", ".join(f"{sql} AS {name}" for name, sql in _FLAT.items())},
  {", ".join(f"lag({c}) OVER {BY} AS y_{c}" for c in ("spend", "clicks", "signups"))}, {_SIGN} FROM rowed),
moves AS (SELECT *, {_NEXT} AS after FROM (SELECT *, {_RUN} AS n FROM flat)),
emas AS (SELECT a.id, a.date, {", ".join(_ema_cell(c, n) for c in ("mood", "strain", "spend") for n in (3, 7))}
  FROM rowed a LEFT JOIN rowed b ON a.id = b.id AND b.rn < a.rn GROUP BY a.id, a.date),
shifted AS (SELECT id, date, mood, lag(mood, 1) OVER {BY} AS l1, lag(mood, 2) OVER {BY} AS l2 FROM filled),
auto AS (SELECT id, date, {_autocorr(1)}, {_autocorr(2)} FROM shifted),
steps AS (SELECT a.id, a.date, b.mood, lag(b.mood) OVER (PARTITION BY a.id, a.date ORDER BY b.rn) AS prev FROM rowed a LEFT JOIN rowed b
  ON a.id = b.id AND b.rn BETWEEN a.rn - 7 AND a.rn - 1 AND b.mood IS NOT NULL),
jumps AS (SELECT id, date, CASE WHEN count(mood) >= 3 THEN sqrt(avg((mood - prev) ** 2)) ELSE 0 END AS mood_rmssd FROM steps GROUP BY id, date),
{_EWSTD.replace("FROM clean", "FROM filled")}
SELECT id, date, study_day, {", ".join(rd(c) for c in ["target", *_FLAT, *_EMAS, "mood_rmssd"])}, mood_autocorr1, mood_autocorr2,
CASE WHEN s1 > 0 THEN n ELSE (after <> 0 AND s1 <> 0)::INT END AS up_days, CASE WHEN s1 < 0 THEN n ELSE (after <> 0 AND s1 <> 0)::INT END AS down_days,
CASE WHEN s1 > 0 AND n >= 2 THEN -1 WHEN s1 < 0 AND n >= 2 THEN 1 ELSE 0 END AS reversal,
CASE WHEN mood_lag1 - mood_lag2 > CASE WHEN mood_ewstd > 1e-9 THEN mood_ewstd * 0.5 ELSE 0.3 END THEN 1
     WHEN mood_lag1 - mood_lag2 < -CASE WHEN mood_ewstd > 1e-9 THEN mood_ewstd * 0.5 ELSE 0.3 END THEN -1 ELSE 0 END AS mood_adaptive,
((y_spend > 0 AND y_spend IS NOT NULL)::INT + (y_clicks > 0 AND y_clicks IS NOT NULL)::INT + (y_signups > 0 AND y_signups IS NOT NULL)::INT)::INT AS app_diversity,
{rd(f"-({_ENTROPY})", "app_entropy")}, {rd(f"sin(2 * pi() * {_DOW} / 7)", "dow_sin")}, {rd(f"cos(2 * pi() * {_DOW} / 7)", "dow_cos")}, ({_DOW} >= 5)::INT AS is_weekend,
(CASE WHEN {_DOW} >= 5 THEN 0 ELSE least((5 - {_DOW} + 7) % 7, ({_DOW} - 6 + 7) % 7) END)::INT AS weekend_distance,
CASE WHEN mood_mean < 40 THEN 0 WHEN mood_mean > 60 THEN 2 ELSE 1 END AS level, {rd("mood_mean * strain_mean", "target_product")},
{rd("CASE WHEN clicks_mean IS NOT NULL THEN spend_mean / greatest(clicks_mean, 0.001) END", "spend_per_clicks")},
{rd("sqrt(strain_mean * strain_mean + mood_mean * mood_mean)", "intensity")}, {rd("atan2(strain_mean, mood_mean)", "angle")},
{", ".join(f"({_PLACE} = {i})::INT AS quadrant_{i}" for i in (1, 2, 3, 4))},
{rd("coalesce(spend_mean, 0) / (1 + coalesce(clicks_mean, 0) + coalesce(signups_mean, 0))", "productive_balance")},
{", ".join(rd(f"CASE WHEN abs({c}_mean) > 0.001 THEN {c}_std / abs({c}_mean) ELSE 0 END", f"{c}_variation") for c in COLS)}
FROM moves JOIN emas USING (id, date) JOIN auto USING (id, date) JOIN jumps USING (id, date) JOIN ew USING (id, date) WHERE rn > 7 AND target IS NOT NULL"""


@query("build_instances", _INSTANCE_SQL)
def _(spark, sf):
    return rounded(build_instances(interpolated(spark, sf), FEATURES))


_NORMED = ", ".join(
    f"CASE WHEN stddev_samp({c}) OVER (PARTITION BY id) > 0 THEN ({c} - avg({c}) OVER (PARTITION BY id)) / stddev_samp({c}) OVER (PARTITION BY id) ELSE 0 END AS {c}"
    for c in COLS
)
_LAGS3 = ", ".join(f"lag(mood, {i}) OVER {BY} AS mood_lag{i}" for i in (1, 2, 3))
_CHANGE_KEEP = ", ".join(
    [
        rd("target - mood_lag1", "target"),
        rd("target", "target_level"),
        *[rd(f"mood_lag{i}") for i in (1, 2, 3)],
        rd(f"sin(2 * pi() * {_DOW} / 7)", "dow_sin"),
        rd(f"cos(2 * pi() * {_DOW} / 7)", "dow_cos"),
        f"({_DOW} >= 5)::INT AS is_weekend, ",
    ]
)


@query(
    "build_instances_as_change",
    f"WITH {FILLED}, norm AS (SELECT id, date, mood AS target, {_LAGS3}, {_NORMED} FROM filled), "
    + _rolling_sql(
        "norm",
        COLS,
        ("mean", "std", "min", "max", "trend"),
        (3, 7),
        extra="target, mood_lag1, mood_lag2, mood_lag3,",
    ).replace("{keep}", _CHANGE_KEEP)
    + " AND target IS NOT NULL AND mood_lag1 IS NOT NULL",
)
def _(spark, sf):
    options = FeatureOptions(target="mood", cols=COLS, sizes=(3, 7), normalise=True, as_change=True)
    return rounded(build_instances(interpolated(spark, sf), options))


# --- preparation --------------------------------------------------------------------------

LEAN = FeatureOptions(target="mood", cols=COLS, aggs=("mean", "std", "trend"))


def lean_instances(spark, sf):
    """A small instance table written once: model fits read it many times."""
    rows = scale.cut_lineage(build_instances(interpolated(spark, sf), LEAN))
    return splits.split_by_date(rows), feature_names(rows)


@query(
    "standardise",
    f"""WITH {FILLED}, r AS (SELECT id, date, avg(mood) OVER {F7} AS a, avg(spend) OVER {F7} AS b FROM filled),
    t AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM r WHERE date < DATE '2024-01-25')
    SELECT id, date, {rd("(a - ma) / sa", "a")}, {rd("(b - mb) / sb", "b")} FROM r, t""",
)
def _(spark, sf):
    from panelrank.operators.windows import before

    rows = interpolated(spark, sf).select(
        "id", "date", F.avg("mood").over(before(7)).alias("a"), F.avg("spend").over(before(7)).alias("b")
    )
    train = rows.filter(F.col("date") < F.lit("2024-01-25").cast("date"))
    return rounded(ml.standardise(rows, ml.scaling(train, ["a", "b"])))


@query(
    "class_weights",
    f"""WITH {INTER}, c AS (SELECT rel, count(*) AS n FROM inter GROUP BY rel)
    SELECT srch, line, item, supp, {rd("(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)", "weight")} FROM inter JOIN c USING (rel)""",
)
def _(spark, sf):
    rows = interactions(spark, sf).select("srch", *TIE, "rel")
    return rounded(ml.class_weights(rows, "rel").drop("rel"))


_MI_COLS = ["price", "score2", "qty"]
_MI_CUTS = ", ".join(
    f"list_distinct([round(v, 9) FOR v IN quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])]) AS k_{c}"
    for c in [*_MI_COLS, "score_b"]
)


@query(
    "mutual_information",
    f"""WITH {INTER}, k AS (SELECT {_MI_CUTS} FROM inter),
    b AS (SELECT {", ".join(f"len(list_filter(k_{c}, lambda v: round({c}, 9) >= v)) AS b_{c}" for c in [*_MI_COLS, "score_b"])} FROM inter, k),
    j AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, b_{c} AS x, b_score_b AS y, count(*) AS n FROM b GROUP BY ALL" for c in _MI_COLS)}),
    s AS (SELECT col, n, sum(n) OVER (PARTITION BY col) AS t, sum(n) OVER (PARTITION BY col, x) AS nx, sum(n) OVER (PARTITION BY col, y) AS ny FROM j)
    SELECT col AS "column", {rd("sum(n / t * ln(n * t / (nx * ny)))", "mutual_information")} FROM s GROUP BY col""",
)
def _(spark, sf):
    return rounded(ml.mutual_information(interactions(spark, sf), _MI_COLS, "score_b"))


def _within_sql(v: str) -> str:
    inside = f"CASE WHEN a.e > 0 THEN b.{v} > a.{v} - a.e AND b.{v} < a.{v} + a.e ELSE b.{v} = a.{v} END"
    return f"greatest(count(*) FILTER ({inside}) - 1, 0) + 1 AS n{v}"


def _digamma_sql(n: str) -> str:
    return f"(-0.5772156649015329::DOUBLE + coalesce(list_sum([1.0::DOUBLE / j FOR j IN range(1, {n})]), 0))"


_INFO = {"size": "p_size", "key": "p_partkey"}


@query(
    "neighbour_information",
    "WITH base AS (SELECT row_number() OVER () AS r, * FROM part), "
    + "pts AS ("
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS col, r, round({c}::DOUBLE / (SELECT stddev_pop({c}) FROM part), 9) AS x,
        round(p_retailprice::DOUBLE / (SELECT stddev_pop(p_retailprice::DOUBLE) FROM part), 9) AS y FROM base"""
        for name, c in _INFO.items()
    )
    + f"""), far AS (SELECT a.col, a.r, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d,
      row_number() OVER (PARTITION BY a.col, a.r ORDER BY greatest(abs(a.x - b.x), abs(a.y - b.y))) AS place
      FROM pts a JOIN pts b ON a.col = b.col AND a.r <> b.r),
    e AS (SELECT pts.*, d AS e FROM pts JOIN far USING (col, r) WHERE place = 3),
    c AS (SELECT a.col, a.r, {_within_sql("x")}, {_within_sql("y")} FROM e a JOIN e b USING (col) GROUP BY a.col, a.r),
    t AS (SELECT col, count(*) AS n, avg({_digamma_sql("nx")} + {_digamma_sql("ny")}) AS t FROM c GROUP BY col)
    SELECT col AS "column", n, {rd(f"greatest({_digamma_sql('3')} + {_digamma_sql('n')} - t, 0)", "mutual_information")} FROM t""",
)
def _(spark, sf):
    rows = table(spark, sf, "part").select(
        *[F.col(c).alias(name) for name, c in _INFO.items()], "p_retailprice"
    )
    return rounded(information.neighbour_information(rows, list(_INFO), "p_retailprice"))


@query(
    "contrast_rows",
    f"""WITH {INTER}, g AS (SELECT srch, avg(price) FILTER (rel = 0) AS mp, avg(score2) FILTER (rel = 0) AS m2 FROM inter GROUP BY srch),
    d AS (SELECT price - mp AS price, score2 - m2 AS score2, rel::DOUBLE AS weight FROM inter JOIN g USING (srch) WHERE rel > 0 AND mp IS NOT NULL)
    SELECT {rd("price", digits=4)}, {rd("score2", digits=4)}, 1.0::DOUBLE AS label, weight FROM d
    UNION ALL SELECT {rd("-price", "price", 4)}, {rd("-score2", "score2", 4)}, 0.0::DOUBLE, weight FROM d""",
)
def _(spark, sf):
    return rounded(
        ml.contrast_rows(interactions(spark, sf), GROUP, ["price", "score2"], "rel"), 4
    )


# --- neighbours ---------------------------------------------------------------------------


def parts_in_space(spark, sf):
    """Parts as points (size, price), split by hash."""
    rows = table(spark, sf, "part").select(
        "p_partkey",
        "p_type",
        (F.col("p_size") / 10).alias("x"),
        (F.col("p_retailprice") / 100).alias("z"),
    )
    return splits.split_groups(rows, "p_partkey")


_SPACE = f"""space AS (SELECT p_partkey, p_type, p_size / 10 AS x, p_retailprice / 100 AS z,
  CASE WHEN {sql_uniform("p_partkey")} < 0.8 THEN 'train' WHEN {sql_uniform("p_partkey")} < 0.9 THEN 'val' ELSE 'holdout' END AS part FROM part)"""


def _near_sql(left, right, extra="TRUE", k=5, name="near", cols="xz"):
    gap = "round(sqrt(" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in cols) + "), 9)"
    return f"""{name} AS (SELECT * FROM (SELECT a.p_partkey, b.p_partkey AS neighbour, b.p_type AS y, b.x AS bx, b.z AS bz, {gap} AS distance,
    row_number() OVER (PARTITION BY a.p_partkey ORDER BY {gap}, b.p_partkey)::INT AS place
    FROM space a JOIN space b ON {extra} WHERE {left} AND {right}) WHERE place <= {k})"""


@query(
    "nearest_rows",
    f"""WITH {_SPACE}, {_near_sql("a.part <> 'train'", "b.part = 'train'")} SELECT p_partkey, place, neighbour, {rd("distance")} FROM near""",
)
def _(spark, sf):
    rows = parts_in_space(spark, sf)
    found = neighbours.nearest_rows(
        rows.filter("part <> 'train'"), rows.filter("part = 'train'"), ["x", "z"], 5, "p_partkey", "p_partkey"
    )
    return rounded(found)


@query(
    "knn_classify",
    f"""WITH {_SPACE}, {_near_sql("a.part <> 'train'", "b.part = 'train'")},
    w AS (SELECT *, CASE WHEN min(distance) OVER (PARTITION BY p_partkey) = 0 THEN (distance = 0)::INT ELSE 1 / nullif(distance, 0) END AS w FROM near),
    v AS (SELECT p_partkey, y, round(sum(w), 9) AS votes FROM w GROUP BY p_partkey, y)
    SELECT p_partkey, prediction FROM (SELECT p_partkey, y AS prediction, row_number() OVER (PARTITION BY p_partkey ORDER BY votes DESC, y) AS rn FROM v) WHERE rn = 1""",
)
def _(spark, sf):
    rows = parts_in_space(spark, sf)
    return neighbours.knn_predict(
        rows.filter("part <> 'train'"), rows.filter("part = 'train'"), ["x", "z"], "p_type", "p_partkey", "classification"
    )


@query(
    "knn_regress",
    f"""WITH {_SPACE}, {_near_sql("a.part <> 'train'", "b.part = 'train'", cols="z")},
    w AS (SELECT near.*, s.x AS t, CASE WHEN min(distance) OVER (PARTITION BY near.p_partkey) = 0 THEN (distance = 0)::INT ELSE 1 / nullif(distance, 0) END AS w
      FROM near JOIN space s ON s.p_partkey = neighbour)
    SELECT p_partkey, {rd("sum(w * t) / sum(w)", "prediction")} FROM w GROUP BY p_partkey""",
)
def _(spark, sf):
    rows = parts_in_space(spark, sf)
    return rounded(
        neighbours.knn_predict(
            rows.filter("part <> 'train'"), rows.filter("part = 'train'"), ["z"], "x", "p_partkey", "regression"
        )
    )


@query(
    "smote",
    f"""WITH {_SPACE}, n AS (SELECT p_type, count(*) AS n FROM space GROUP BY p_type), big AS (SELECT max(n) AS top FROM n),
    c AS (SELECT space.*, (top - n) // n + ({sql_uniform("p_partkey")} < ((top - n) % n) / n)::INT AS copies FROM space JOIN n USING (p_type), big WHERE n < top),
    e AS (SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM c WHERE copies > 0),
    d AS (SELECT *, {sql_bucket(5, "p_partkey", "copy")} + 1 AS place, {sql_uniform("p_partkey", "copy", seed=43)} AS share FROM e),
    {_near_sql("TRUE", "TRUE", "a.p_type = b.p_type AND a.p_partkey <> b.p_partkey")}
    SELECT d.p_partkey, copy, p_type, {rd("x + share * (bx - x)", "x")}, {rd("z + share * (bz - z)", "z")} FROM d JOIN near ON near.p_partkey = d.p_partkey AND near.place = d.place""",
)
def _(spark, sf):
    return rounded(neighbours.smote(parts_in_space(spark, sf), ["x", "z"], "p_type", "p_partkey"))


# --- fits ---------------------------------------------------------------------------------


def _assembled(spark, sf, label="target"):
    rows, cols = lean_instances(spark, sf)
    train = rows.filter("part = 'train'")
    scales = ml.scaling(train.fillna(0.0, cols), cols)
    cuts = groups.class_cuts(train, "target")
    ready = ml.standardise(rows.fillna(0.0, cols), scales)
    ready = ready.withColumn("class", groups.cut_class(F.col("target"), cuts))
    ready = splits.group_kfold(ready, "id", 3)
    both = [
        ml.assemble(ready.filter(f"part = '{p}'"), cols, label, keep=["id", "date", "fold"])
        for p in ("train", "test")
    ]
    return (*both, cols)


def _reports(spark, sf, label, task, names):
    train, test, cols = _assembled(spark, sf, label)
    out = None
    for name, params in names.items():
        if name == "mlp":
            params = {"layers": ml.mlp_layers(len(cols), 3, (8,)), "seed": 7, "maxIter": 20}
        fitted = ml.fit_predict(train, test, ml.estimator(name, task, **params))
        row = ml.score(fitted, task).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return rounded(out, 4)


@query("regressors")
def _(spark, sf):
    return _reports(
        spark,
        sf,
        "target",
        "regression",
        {
            "ridge": {},
            "lasso": {},
            "elastic_net": {},
            "huber": {"maxIter": 20},
            "tree": {"maxDepth": 4, "seed": 7},
            "random_forest": {"numTrees": 10, "maxDepth": 5, "seed": 7},
            "boosting": {"maxIter": 5, "maxDepth": 3, "seed": 7},
        },
    )


@query("classifiers")
def _(spark, sf):
    return _reports(
        spark,
        sf,
        "class",
        "classification",
        {
            "logistic": {"maxIter": 20},
            "tree": {"maxDepth": 4, "seed": 7},
            "random_forest": {"numTrees": 10, "maxDepth": 5, "seed": 7},
            "naive_bayes": {},
            "linear_svm": {"maxIter": 10},
            "boosting": {"maxIter": 3, "maxDepth": 3, "seed": 7},
            "mlp": {},
        },
    )


@query("squared_and_absolute_loss")
def _(spark, sf):
    train, test, _ = _assembled(spark, sf)
    out = None
    for loss in ("squared", "absolute"):
        model = ml.estimator("boosting", "regression", lossType=loss, maxIter=5, maxDepth=3, seed=7)
        row = ml.score(ml.fit_predict(train, test, model), "regression")
        row = row.select(F.lit(loss).alias("loss"), "*")
        out = row if out is None else out.unionByName(row)
    return rounded(out, 4)


@query("grid_search")
def _(spark, sf):
    train, _, _ = _assembled(spark, sf, "class")
    model = ml.grid_search(
        train,
        ml.estimator("tree", "classification", seed=7),
        {"maxDepth": [2, 4]},
        "fold",
        3,
        ml.MacroF1(),
    )
    return rounded(ml.grid_scores(model, spark), 4)


@query("stacking")
def _(spark, sf):
    train, test, _ = _assembled(spark, sf)
    fitted = ml.stacking(
        train,
        test,
        {
            "tree": ml.estimator("tree", "regression", maxDepth=4, seed=7),
            "ridge": ml.estimator("ridge", "regression"),
        },
        ml.estimator("ridge", "regression"),
        "fold",
        3,
        ["id", "date"],
    )
    return rounded(ml.score(fitted, "regression"), 4)


@query("grid_search_squared_error")
def _(spark, sf):
    train, _, _ = _assembled(spark, sf)
    tree = ml.estimator("tree", "regression", seed=7)
    model = ml.grid_search(train, tree, {"maxDepth": [2, 4]}, "fold", 3)
    return rounded(ml.grid_scores(model, spark), 4)


@query("stacking_classes")
def _(spark, sf):
    train, test, _ = _assembled(spark, sf, "class")
    bases = {
        "tree": ml.estimator("tree", "classification", maxDepth=4, seed=7),
        "naive_bayes": ml.estimator("naive_bayes", "classification"),
    }
    final = ml.estimator("logistic", "classification", maxIter=20)
    fitted = ml.stacking_classes(train, test, bases, final, "fold", 3, ["id", "date"])
    return rounded(ml.score(fitted, "classification"), 4)


@query("refit_on_top_columns")
def _(spark, sf):
    train, test, cols = _assembled(spark, sf)
    model = ml.estimator("random_forest", "regression", numTrees=10, maxDepth=4, seed=7)
    _, fitted = ml.refit_on_top(train, test, cols, model, 5)
    return rounded(ml.score(fitted, "regression"), 4)


@query("top_by_importance")
def _(spark, sf):
    train, test, cols = _assembled(spark, sf)
    model = ml.estimator("random_forest", "regression", numTrees=10, maxDepth=4, seed=7).fit(train)
    names = ml.top_by_importance(model, cols, 5)
    return spark.createDataFrame(list(enumerate(names, 1)), "place int, column string")


def _train_and_test(spark, sf):
    rows, cols = lean_instances(spark, sf)
    return rows.filter("part = 'train'"), rows.filter("part = 'test'"), cols


@query("forward_selection")
def _(spark, sf):
    train, test, cols = _train_and_test(spark, sf)
    return rounded(ml.forward_selection(train, test, cols, "target", "mood_mean"), 4)


def _blocks(cols):
    return {c: [name for name in cols if name.startswith(f"{c}_")] for c in COLS}


@query("ablation")
def _(spark, sf):
    train, test, cols = _train_and_test(spark, sf)
    return rounded(ml.ablation(train, test, _blocks(cols), "target"), 4)


@query("incremental_blocks")
def _(spark, sf):
    train, test, cols = _train_and_test(spark, sf)
    return rounded(ml.incremental_blocks(train, test, _blocks(cols), "target"), 4)


@query("window_sweep")
def _(spark, sf):
    panel = scale.cut_lineage(interpolated(spark, sf))

    def build(size):
        return build_instances(
            panel, FeatureOptions(target="mood", cols=COLS, sizes=(size,), lags=0, aggs=("mean",))
        )

    return rounded(
        ml.window_sweep(
            build,
            range(1, 15),
            lambda _: [f"{c}_mean" for c in COLS],
            "target",
            F.col("date") < F.lit("2024-01-25").cast("date"),
        ),
        4,
    )


@query("pca")
def _(spark, sf):
    rows, cols = lean_instances(spark, sf)
    return rounded(ml.pca(rows, cols, ["id", "date"], 5), 3)


@query("cluster_models")
def _(spark, sf):
    train, test, _ = _assembled(spark, sf)
    clusters = ml.cluster_ids(interpolated(spark, sf), COLS)
    fitted = ml.cluster_models(train, test, clusters, lambda: ml.estimator("ridge", "regression"))
    return rounded(ml.score(fitted, "regression"), 4)


@query("per_id_models")
def _(spark, sf):
    rows, cols = lean_instances(spark, sf)
    return rounded(ml.per_id_models(rows, cols, "target"), 4)


@query("run_experiment")
def _(spark, sf):
    experiment = Experiment(
        features=LEAN,
        split="date",
        classifier="random_forest",
        classifier_params={"numTrees": 10, "maxDepth": 5, "seed": 7},
    )
    return rounded(run_experiment(interpolated(spark, sf), experiment, "lean"), 4)


# --- closed forms -------------------------------------------------------------------------

# One and two columns, where SQL can solve the normal equations by itself.
_CLOSED = f"""{FILLED}, rowed AS (SELECT id, date, mood AS y, coalesce(strain, 0) AS x,
  coalesce(spend, 0) AS w, date < DATE '2024-01-25' AS is_train FROM filled WHERE mood IS NOT NULL),
one AS (SELECT avg(x) AS mx, avg(w) AS mw, avg(y) AS my, var_pop(x) AS xx, var_pop(w) AS ww,
  covar_pop(x, w) AS xw, covar_pop(x, y) AS xy, covar_pop(w, y) AS wy FROM rowed WHERE is_train),
beta AS (SELECT *, (xy * ww - wy * xw) / (xx * ww - xw * xw) AS bx, (wy * xx - xy * xw) / (xx * ww - xw * xw) AS bw FROM one),
errors AS (SELECT avg((y - my) ** 2) AS e0, avg((y - my - xy / xx * (x - mx)) ** 2) AS ex,
  avg((y - my - wy / ww * (w - mw)) ** 2) AS ew, avg((y - my - bx * (x - mx) - bw * (w - mw)) ** 2) AS exw
  FROM rowed, beta WHERE NOT is_train)"""


def _closed_form_rows(spark, sf):
    rows = interpolated(spark, sf).filter("mood IS NOT NULL")
    early = F.col("date") < F.lit("2024-01-25").cast("date")
    return rows.filter(early), rows.filter(~early)


@query(
    "ablation_two_columns",
    f"""WITH {_CLOSED} SELECT 'all' AS features, 2 AS n, {rd("exw", "mse")} FROM errors
    UNION ALL SELECT 'without strain', 1, {rd("ew", "mse")} FROM errors
    UNION ALL SELECT 'without spend', 1, {rd("ex", "mse")} FROM errors""",
)
def _(spark, sf):
    train, test = _closed_form_rows(spark, sf)
    return rounded(ml.ablation(train, test, {"strain": ["strain"], "spend": ["spend"]}, "mood"))


@query(
    "incremental_two_columns",
    f"""WITH {_CLOSED} SELECT 0 AS step, 'strain' AS block, 1 AS n, {rd("ex", "mse")} FROM errors
    UNION ALL SELECT 1, 'spend', 2, {rd("exw", "mse")} FROM errors""",
)
def _(spark, sf):
    train, test = _closed_form_rows(spark, sf)
    blocks = {"strain": ["strain"], "spend": ["spend"]}
    return rounded(ml.incremental_blocks(train, test, blocks, "mood"))


@query(
    "forward_selection_two_columns",
    f"""WITH {_CLOSED} SELECT 0 AS step, 'strain' AS "column", {rd("ex", "mse")} FROM errors
    UNION ALL SELECT 1, 'spend', {rd("exw", "mse")} FROM errors WHERE exw < ex""",
)
def _(spark, sf):
    train, test = _closed_form_rows(spark, sf)
    return rounded(ml.forward_selection(train, test, ["strain", "spend"], "mood", "strain"))


@query(
    "per_id_models_one_column",
    f"""WITH {FILLED}, r AS (SELECT id, date, mood AS y, coalesce(strain, 0) AS x,
      row_number() OVER {BY} AS rn, floor(count(*) OVER (PARTITION BY id) * 0.8::DOUBLE)::INT AS cut,
      count(*) OVER (PARTITION BY id) AS n FROM filled WHERE mood IS NOT NULL),
    s AS (SELECT id, avg(x) AS mx, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sx, avg(y) AS my FROM r WHERE rn <= cut GROUP BY id),
    z AS (SELECT r.*, (x - mx) / sx AS z, my FROM r JOIN s USING (id)),
    b AS (SELECT id, sum(z * (y - my)) / (sum(z * z) + 1.0) AS beta FROM z WHERE rn <= cut GROUP BY id),
    e AS (SELECT id, count(*) AS n_test, avg((y - my - beta * z) ** 2) AS mse, avg(abs(y - my - beta * z)) AS mae, avg((y - my) ** 2) AS base
      FROM z JOIN b USING (id) WHERE rn > cut GROUP BY id),
    k AS (SELECT id, any_value(cut) AS cut, any_value(n) AS n FROM r GROUP BY id)
    SELECT id, cut AS n_train, (n - cut)::INT AS n_test, {", ".join(rd(f"CASE WHEN cut >= 5 THEN {a} END", b) for a, b in (("mse", "mse"), ("mae", "mae"), ("base", "baseline_mse")))},
    CASE WHEN cut < 5 OR cut = n THEN 'too few rows' END AS reason FROM k LEFT JOIN e USING (id)""",
)
def _(spark, sf):
    rows = interpolated(spark, sf)
    return rounded(ml.per_id_models(rows, ["strain"], "mood"))


# --- ranking flow -------------------------------------------------------------------------

RANKING = RankingColumns(
    group="srch",
    item="item",
    price="price",
    rel="rel",
    tie=TIE,
    targets=TARGETS,
    deltas=["stars", "score2"],
    prior_keys=[["item"], ["dest"], ["item", "dest"]],
)


def _pages(spark, sf):
    rows = interactions(spark, sf).select("srch", *TIE, "price", "score2", "rel", "clicked", "booked")
    return with_destination(with_stars(rows, spark, sf), spark, sf), rows.select("srch")


_PRIOR_KEYS = {"item": "item", "dest": "dest", "item_dest": "item, dest"}


def _prior_ctes(prefix, keys):
    sums = ", ".join(f"sum({t}) AS s_{t}" for t in TARGETS)
    again = ", ".join(f"sum(s_{t}) AS s_{t}" for t in TARGETS)
    return f"""f_{prefix} AS (SELECT {keys}, fold, count(*) AS n, {sums} FROM folded WHERE fold IS NOT NULL GROUP BY {keys}, fold),
    a_{prefix} AS (SELECT {keys}, sum(n) AS n, {again} FROM f_{prefix} GROUP BY {keys})"""


def _prior_columns(prefix):
    n = f"(coalesce(a_{prefix}.n, 0) - coalesce(f_{prefix}.n, 0))"
    rates = [
        rd(
            f"(coalesce(a_{prefix}.s_{t}, 0) - coalesce(f_{prefix}.s_{t}, 0) + 20 * g_{t}) / ({n} + 20.0)",
            f"{prefix}_{t}_rate",
        )
        for t in TARGETS
    ]
    return ", ".join([rd(f"ln(1 + {n})", f"{prefix}_impressions_log1p"), *rates])


def _prior_joins(prefix, keys):
    on = " AND ".join(f"a_{prefix}.{k} = folded.{k}" for k in keys.split(", "))
    own = " AND ".join(f"f_{prefix}.{k} = folded.{k}" for k in keys.split(", "))
    return f"LEFT JOIN a_{prefix} ON {on} LEFT JOIN f_{prefix} ON {own} AND f_{prefix}.fold = folded.fold"


_RANKING_SQL = f"""WITH {INTER}, wide AS (SELECT srch, line, item, supp, price, score2, rel, clicked, booked, p_size::DOUBLE AS stars, c_nationkey AS dest,
  rank() OVER (PARTITION BY srch ORDER BY price) AS price_rank, CASE WHEN {sql_uniform("srch")} < 0.8 THEN 'train' WHEN {sql_uniform("srch")} < 0.9 THEN 'val' ELSE 'holdout' END AS part
  FROM inter JOIN part ON p_partkey = item JOIN orders ON o_orderkey = srch JOIN customer ON c_custkey = o_custkey),
folded AS (SELECT *, CASE WHEN part = 'train' THEN {sql_bucket(5, "srch", seed=43)} END AS fold FROM wide),
g AS (SELECT avg(clicked) AS g_clicked, avg(booked) AS g_booked, avg(rel) / 5.0 AS g_rel FROM wide WHERE part = 'train'),
s AS (SELECT srch, avg(ln(1 + price)) AS m, stddev_samp(ln(1 + price)) AS sd, avg(stars) AS ms, avg(score2) AS m2 FROM wide GROUP BY srch),
{", ".join(_prior_ctes(p, keys) for p, keys in _PRIOR_KEYS.items())}
SELECT folded.srch, folded.line, folded.item, folded.supp, folded.dest, rel, clicked, booked, part, folded.fold,
{rd("price")}, {rd("score2")}, {rd("stars")}, {rd("(ln(1 + price) - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END", "price_z")},
{rd("stars - ms", "stars_delta")}, {rd("score2 - m2", "score2_delta")}, price_rank, {", ".join(_prior_columns(p) for p in _PRIOR_KEYS)}
FROM folded JOIN s USING (srch)
{" ".join(_prior_joins(p, keys) for p, keys in _PRIOR_KEYS.items())}, g"""


@query("ranking_features", _RANKING_SQL)
def _(spark, sf):
    rows, pages = _pages(spark, sf)
    return rounded(ranking_features(rows, RANKING, pages))


@query("ranker_quality")
def _(spark, sf):
    rows, pages = _pages(spark, sf)
    return rounded(fit_and_rank(rows, RANKING, pages)[1], 3)


@query("ranker_submission")
def _(spark, sf):
    rows, pages = _pages(spark, sf)
    return fit_and_rank(rows, RANKING, pages)[0]


_SCORE = "0.0 + price * -0.0001::DOUBLE + score2 * 2.0::DOUBLE"


@query(
    "pair_gradient",
    f"""WITH {INTER}, s AS (SELECT srch, line, item, supp, rel, price::DOUBLE AS price, score2::DOUBLE AS score2, {_SCORE} AS s FROM inter),
    p AS (SELECT *, row_number() OVER (PARTITION BY srch ORDER BY s DESC, line, item, supp) AS place,
      row_number() OVER (PARTITION BY srch ORDER BY rel DESC) AS best FROM s),
    ideal AS (SELECT srch, sum(rel / log2(best + 1)) AS ideal FROM p WHERE best <= 5 GROUP BY srch HAVING max(rel) > 0),
    pairs AS (SELECT (a.rel - b.rel) * abs(CASE WHEN a.place <= 5 THEN 1 / log2(a.place + 1) ELSE 0 END - 1 / log2(b.place + 1)) / ideal AS delta,
      a.s - b.s AS gap, a.price - b.price AS d0, a.score2 - b.score2 AS d1 FROM p a JOIN p b USING (srch) JOIN ideal USING (srch) WHERE b.place <= 5 AND a.rel > b.rel),
    t AS (SELECT *, 1 / (1 + exp(gap)) AS wrong FROM pairs),
    g AS (SELECT count(*) AS pairs, sum(delta * (greatest(-gap, 0) + ln(1 + exp(-abs(gap))))) AS loss, sum(-delta * wrong * d0) AS s0, sum(-delta * wrong * d1) AS s1,
      sum(delta * wrong * (1 - wrong) * d0 * d0) AS b0, sum(delta * wrong * (1 - wrong) * d1 * d1) AS b1 FROM t)
    SELECT pairs, {rd("loss", digits=3)}, 'price' AS "column", {rd("s0", "slope", 3)}, {rd("b0 / 1e6", "bend", 3)} FROM g
    UNION ALL SELECT pairs, {rd("loss", digits=3)}, 'score2', {rd("s1", "slope", 3)}, {rd("b1 / 1e6", "bend", 3)} FROM g""",
)
def _(spark, sf):
    cols = ["price", "score2"]
    found = ranker.pairs(
        interactions(spark, sf), GROUP, cols, "rel", TIE, {"price": -0.0001, "score2": 2.0}
    )
    return rounded(ranker.gradient(found, cols).withColumn("bend", F.col("bend") / 1e6), 3)


@query("pair_ranker_quality")
def _(spark, sf):
    rows, pages = _pages(spark, sf)
    return rounded(fit_pairs_and_rank(rows, RANKING, pages, steps=2), 3)
