"""Queries over the measurement panel derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrank.functions import scalar
from panelrank.functions.stats import keep_missing
from panelrank.operators import clean, impute, joins, rollup, windows
from panelrank.queries.registry import query, rd, rds, rounded
from panelrank.sources.tables import table

# Stand-in for a measurement study: the target is a daily mean, the rest sensors and counts.
RULES = {
    "mood": ("view", "mean"),
    "strain": ("error", "mean"),
    "spend": ("purchase", "sum"),
    "clicks": ("click", "count"),
    "signups": ("signup", "count"),
}
COLS = list(RULES)
BOUNDS = {"mood": (1.0, 200.0), "strain": (1.0, 200.0)}


def measurements(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("id"),
        F.col("ts").alias("time"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("variable"),
        "value",
    )


def daily(spark, sf):
    return rollup.daily_rollup(measurements(spark, sf), RULES)


def panel(spark, sf):
    return rollup.calendar_fill(daily(spark, sf))


def cleaned(spark, sf):
    return clean.null_out_of_range(panel(spark, sf), BOUNDS)


def interpolated(spark, sf):
    return impute.interpolate_linear(cleaned(spark, sf), COLS)


M = """m AS (SELECT user_id AS id, ts AS time, ts::DATE AS date, event_type AS variable, value FROM events)"""
DAILY = f"""{M},
daily AS (
  SELECT id, date,
    avg(value) FILTER (variable = 'view') AS mood,
    avg(value) FILTER (variable = 'error') AS strain,
    CASE WHEN count(*) FILTER (variable = 'purchase') > 0
         THEN coalesce(sum(value) FILTER (variable = 'purchase'), 0) END AS spend,
    CASE WHEN count(*) FILTER (variable = 'click') > 0
         THEN (count(value) FILTER (variable = 'click'))::DOUBLE END AS clicks,
    CASE WHEN count(*) FILTER (variable = 'signup') > 0
         THEN (count(value) FILTER (variable = 'signup'))::DOUBLE END AS signups
  FROM m GROUP BY id, date)"""
PANEL = f"""{DAILY},
cal AS (
  SELECT id, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
  FROM daily GROUP BY id),
panel AS (SELECT cal.id, cal.date, mood, strain, spend, clicks, signups FROM cal LEFT JOIN daily USING (id, date))"""
CLEAN = f"""{PANEL},
clean AS (
  SELECT id, date, CASE WHEN mood BETWEEN 1 AND 200 THEN mood END AS mood,
         CASE WHEN strain BETWEEN 1 AND 200 THEN strain END AS strain, spend, clicks, signups
  FROM panel)"""


def _interp_sql(source: str, cols: list[str]) -> str:
    """previous/next present value and row per column, then a straight line between them."""
    marks = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER b AS {c}_a, "
        f"last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS {c}_ar, "
        f"first_value({c} IGNORE NULLS) OVER f AS {c}_b, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS {c}_br"
        for c in cols
    )
    values = ", ".join(
        f"coalesce({c}, {c}_a + ({c}_b - {c}_a) * (rn - {c}_ar) / nullif({c}_br - {c}_ar, 0), {c}_a, {c}_b) AS {c}"
        for c in cols
    )
    return f"""numbered AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY date))::DOUBLE AS rn FROM {source}),
marks AS (SELECT *, {marks} FROM numbered
  WINDOW b AS (PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT id, date, {values} FROM marks)"""


FILLED = f"{CLEAN}, {_interp_sql('clean', COLS)}"
ALL = "mood strain spend clicks signups"
F7 = "(PARTITION BY id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
BY = "(PARTITION BY id ORDER BY date)"
SKEW = (
    "CASE WHEN count({x}) OVER {w} >= 3 AND var_pop({x}) OVER {w} > 0 "
    "THEN skewness({x}) OVER {w} ELSE 0 END"
)
KURT = (
    "CASE WHEN count({x}) OVER {w} >= 4 AND var_pop({x}) OVER {w} > 0 "
    "THEN kurtosis({x}) OVER {w} ELSE 0 END"
)


# --- sources, rollups and calendars -------------------------------------------------------


@query("daily_rollup", f"WITH {DAILY} SELECT id, date, {rds(ALL)} FROM daily")
def _(spark, sf):
    return rounded(daily(spark, sf))


@query(
    "daily_rollup_sum_or_mean",
    f"""WITH {M} SELECT id, date,
    {rd("avg(value) FILTER (variable = 'view')", "view_mean")},
    {rd("avg(value) FILTER (variable = 'error')", "error_mean")},
    {rd("avg(value) FILTER (variable = 'purchase')", "purchase_mean")},
    {rd("sum(value) FILTER (variable = 'click')", "click_sum")},
    {rd("sum(value) FILTER (variable = 'signup')", "signup_sum")}
    FROM m GROUP BY id, date""",
)
def _(spark, sf):
    rules = {f"{v}_mean": (v, "mean") for v in ("view", "error", "purchase")}
    rules |= {f"{v}_sum": (v, "sum") for v in ("click", "signup")}
    return rounded(rollup.daily_rollup(measurements(spark, sf), rules))


_RESAMPLE = """WITH {m},
once AS (SELECT id, variable, time, avg(value) AS value FROM m GROUP BY id, variable, time),
bins AS (SELECT id, variable, time_bucket(INTERVAL {hours} HOURS, time, TIMESTAMP '1970-01-01') AS slot, {agg}(value) AS value
         FROM once GROUP BY 1, 2, 3),
cal AS (SELECT id, variable, unnest(generate_series(min(slot), max(slot), INTERVAL {hours} HOURS)) AS slot
        FROM bins GROUP BY id, variable)
SELECT id, variable, slot, {value} FROM cal LEFT JOIN bins USING (id, variable, slot)"""


@query("resample_6h", _RESAMPLE.format(m=M, hours=6, agg="avg", value=rd("value")))
def _(spark, sf):
    return rounded(rollup.resample(measurements(spark, sf), "6 HOURS", "mean"))


@query(
    "resample_day_sum",
    _RESAMPLE.format(m=M, hours=24, agg="sum", value=rd("coalesce(value, 0)", "value")),
)
def _(spark, sf):
    return rounded(rollup.resample(measurements(spark, sf), "24 HOURS", "sum"))


@query("calendar_fill", f"WITH {PANEL} SELECT id, date, {rds(ALL)} FROM panel")
def _(spark, sf):
    return rounded(panel(spark, sf))


@query(
    "calendar_fill_global",
    f"""WITH {DAILY},
    days AS (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM daily),
    ids AS (SELECT DISTINCT id FROM daily)
    SELECT id, date, {rds(ALL)} FROM ids CROSS JOIN days LEFT JOIN daily USING (id, date)""",
)
def _(spark, sf):
    return rounded(rollup.calendar_fill(daily(spark, sf), "global"))


@query(
    "calendar_fill_target_range",
    f"""WITH {DAILY},
    cal AS (SELECT id, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
            FROM daily WHERE mood IS NOT NULL GROUP BY id)
    SELECT id, date, {rds(ALL)} FROM cal LEFT JOIN daily USING (id, date)""",
)
def _(spark, sf):
    return rounded(rollup.calendar_fill(daily(spark, sf), "target", "mood"))


@query(
    "first_last_by_time",
    f"""WITH {M} SELECT id, date, {rd("arg_min(value, (time, value))", "first_value")},
    {rd("arg_max(value, (time, value))", "last_value")} FROM m WHERE variable = 'view' GROUP BY id, date""",
)
def _(spark, sf):
    return rounded(rollup.first_last_by_time(measurements(spark, sf), "view"))


@query(
    "time_of_day_means",
    f"""WITH {M}, t AS (SELECT id, date, avg(value) FILTER (hour(time) BETWEEN 8 AND 12) AS morning,
      avg(value) FILTER (hour(time) BETWEEN 18 AND 22) AS evening FROM m WHERE variable = 'view' GROUP BY id, date)
    SELECT id, date, {rds("morning evening")}, {rd("evening - morning", "day_slope")} FROM t
    WHERE morning IS NOT NULL OR evening IS NOT NULL""",
)
def _(spark, sf):
    return rounded(rollup.time_of_day_means(measurements(spark, sf), "view"))


@query(
    "day_night_split",
    f"""WITH {M} SELECT id, date,
    {rd("sum(value) FILTER (variable = 'purchase' AND hour(time) >= 7 AND hour(time) < 22)", "purchase_day")},
    {rd("sum(value) FILTER (variable = 'purchase' AND NOT (hour(time) >= 7 AND hour(time) < 22))", "purchase_night")},
    {rd("avg(value) FILTER (variable = 'view' AND hour(time) >= 7 AND hour(time) < 22)", "view_day")},
    {rd("avg(value) FILTER (variable = 'view' AND NOT (hour(time) >= 7 AND hour(time) < 22))", "view_night")}
    FROM m WHERE variable IN ('purchase', 'view') GROUP BY id, date""",
)
def _(spark, sf):
    return rounded(
        rollup.day_night_split(measurements(spark, sf), {"purchase": "sum", "view": "mean"})
    )


@query(
    "bed_wake_sleep",
    f"""WITH {M}, b AS (SELECT id, date,
      max(CASE WHEN hour(time) >= 18 THEN hour(time) WHEN hour(time) < 5 THEN hour(time) + 24 END)::DOUBLE AS bed_time,
      min(CASE WHEN hour(time) >= 5 AND hour(time) < 13 THEN hour(time) END)::DOUBLE AS wake_time
      FROM m GROUP BY id, date),
    cal AS (SELECT id, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM b GROUP BY id),
    p AS (SELECT id, date, bed_time, wake_time, lag(bed_time) OVER {BY} AS prev FROM cal LEFT JOIN b USING (id, date))
    SELECT id, date, bed_time, wake_time,
      CASE WHEN prev >= 15 AND 24 - prev + wake_time > 0 AND 24 - prev + wake_time < 16 THEN 24 - prev + wake_time END AS sleep_hours
    FROM p""",
)
def _(spark, sf):
    days = rollup.calendar_fill(rollup.bed_wake(measurements(spark, sf)))
    return rollup.sleep_duration(days)


@query(
    "measures_per_day",
    f"""WITH {M}, d AS (SELECT id, date, count(*) AS measures FROM m GROUP BY id, date)
    SELECT id, count(*) AS days, {rd("avg(measures)", "mean_measures")}, max(measures) AS max_measures FROM d GROUP BY id""",
)
def _(spark, sf):
    return rounded(rollup.days_per_id(measurements(spark, sf)))


# --- cleaning -----------------------------------------------------------------------------


@query("null_out_of_range", f"WITH {CLEAN} SELECT id, date, {rds(ALL)} FROM clean")
def _(spark, sf):
    return rounded(cleaned(spark, sf))


# Events hold no negatives, so the sign rules run on values centred on 20.
SHIFT = "shifted AS (SELECT id, time, variable, value - 20 AS value FROM m)"


def _shifted(spark, sf):
    return measurements(spark, sf).select(
        "id", "time", "variable", (F.col("value") - 20).alias("value")
    )


@query(
    "null_negatives",
    f"WITH {M}, {SHIFT} SELECT id, time, variable, {rd('CASE WHEN value >= 0 THEN value END', 'value')} FROM shifted",
)
def _(spark, sf):
    return rounded(clean.null_negatives(_shifted(spark, sf), ["value"]))


@query(
    "null_all_negatives",
    f"""WITH {PANEL} SELECT id, date, {rd("mood - 50", "mood")},
    {rd("CASE WHEN strain - 50 >= 0 THEN strain - 50 END", "strain")},
    {rd("CASE WHEN spend - 50 >= 0 THEN spend - 50 END", "spend")} FROM panel""",
)
def _(spark, sf):
    rows = panel(spark, sf).select(
        "id", "date", *[(F.col(c) - 50).alias(c) for c in ("mood", "strain", "spend")]
    )
    return rounded(clean.null_all_negatives(rows, exempt=["mood"]))


@query(
    "repair_negatives",
    f"""WITH {M}, {SHIFT} SELECT id, time, variable,
    {rd("CASE WHEN value < 0 THEN CASE WHEN abs(value) <= 15 THEN abs(value) END ELSE value END", "value")} FROM shifted""",
)
def _(spark, sf):
    return rounded(clean.repair_negatives(_shifted(spark, sf), ["value"], cutoff=15.0))


@query(
    "cap_values",
    f"""WITH {PANEL} SELECT id, date, {rd("CASE WHEN spend > 100 THEN 100 ELSE spend END", "spend")},
    {rd("CASE WHEN strain > 100 THEN 100 ELSE strain END", "strain")} FROM panel""",
)
def _(spark, sf):
    rows = panel(spark, sf).select("id", "date", "spend", "strain")
    return rounded(clean.cap_values(rows, ["spend", "strain"], 100.0))


def _sparse_sql(c):
    return f"SELECT '{c}' AS \"column\", {rd(f'avg(CASE WHEN coalesce({c}, 0) = 0 THEN 1.0 ELSE 0.0 END)', 'sparse_share')} FROM panel"


@query("sparse_shares", f"WITH {PANEL} " + " UNION ALL ".join(_sparse_sql(c) for c in COLS))
def _(spark, sf):
    return rounded(clean.sparse_shares(panel(spark, sf), COLS))


@query(
    "drop_sparse_columns",
    f"WITH {PANEL} SELECT id, date, {rds('spend clicks')} FROM panel",
)
def _(spark, sf):
    rows = panel(spark, sf).select(
        "id",
        "date",
        "spend",
        "clicks",
        F.when(F.col("mood") > 250, F.col("mood")).alias("rare_mood"),
        F.when(F.col("strain") > 250, F.col("strain")).alias("rare_strain"),
    )
    return rounded(
        clean.drop_sparse_columns(rows, ["spend", "clicks", "rare_mood", "rare_strain"], 0.8)
    )


@query(
    "group_columns",
    f"""WITH {PANEL} SELECT id, date, {rd("mood")}, {rd("coalesce(strain, 0) + coalesce(spend, 0)", "load")},
    {rd("coalesce(clicks, 0) + coalesce(signups, 0)", "activity")} FROM panel""",
)
def _(spark, sf):
    return rounded(
        clean.group_columns(
            panel(spark, sf), {"load": ["strain", "spend"], "activity": ["clicks", "signups"]}
        )
    )


@query(
    "merge_low_density",
    f"""WITH {PANEL}, z AS (SELECT id, date, coalesce(strain, 0) AS strain, coalesce(spend, 0) AS spend,
       coalesce(clicks, 0) AS clicks, coalesce(signups, 0) AS signups FROM panel),
    d AS (SELECT *, avg(CASE WHEN spend > 0 THEN 1.0 ELSE 0.0 END) OVER w < 0.35 AS t1,
       avg(CASE WHEN clicks > 0 THEN 1.0 ELSE 0.0 END) OVER w < 0.35 AS t2,
       avg(CASE WHEN signups > 0 THEN 1.0 ELSE 0.0 END) OVER w < 0.35 AS t3 FROM z WINDOW w AS (PARTITION BY id))
    SELECT id, date, {rd("strain + CASE WHEN t1 THEN spend ELSE 0 END + CASE WHEN t2 THEN clicks ELSE 0 END + CASE WHEN t3 THEN signups ELSE 0 END", "strain")},
    {rd("CASE WHEN t1 THEN 0 ELSE spend END", "spend")}, {rd("CASE WHEN t2 THEN 0 ELSE clicks END", "clicks")},
    {rd("CASE WHEN t3 THEN 0 ELSE signups END", "signups")} FROM d""",
)
def _(spark, sf):
    cols = ["strain", "spend", "clicks", "signups"]
    rows = clean.fill_zero(panel(spark, sf).select("id", "date", *cols), cols)
    return rounded(clean.merge_low_density(rows, cols[1:], "strain", 0.35))


@query(
    "conditional_zero_fill",
    f"""WITH {PANEL}, a AS (SELECT *, (mood IS NOT NULL)::INT + (strain IS NOT NULL)::INT + (spend IS NOT NULL)::INT AS n FROM panel)
    SELECT id, date, {rds("mood strain spend")}, {rd("CASE WHEN clicks IS NULL AND n >= 2 THEN 0 ELSE clicks END", "clicks")},
    {rd("CASE WHEN signups IS NULL AND n >= 2 THEN 0 ELSE signups END", "signups")} FROM a""",
)
def _(spark, sf):
    return rounded(
        clean.conditional_zero_fill(
            panel(spark, sf), ["clicks", "signups"], ["mood", "strain", "spend"], 2
        )
    )


@query(
    "fill_zero",
    f"WITH {PANEL} SELECT id, date, "
    + ", ".join(rd(f"coalesce({c}, 0)", c) for c in COLS)
    + " FROM panel",
)
def _(spark, sf):
    return rounded(clean.fill_zero(panel(spark, sf), COLS))


@query(
    "log1p_columns",
    f"WITH {PANEL} SELECT id, date, {rd('ln(1 + CASE WHEN spend - 20 < 0 THEN 0 ELSE spend - 20 END)', 'spend')} FROM panel",
)
def _(spark, sf):
    rows = panel(spark, sf).select("id", "date", (F.col("spend") - 20).alias("spend"))
    return rounded(clean.log1p_columns(rows, ["spend"]))


@query(
    "power_transform_nonzero",
    f"""WITH {PANEL}, z AS (SELECT id, date, coalesce(spend, 0) AS spend, coalesce(strain, 0) AS strain FROM panel)
    SELECT id, date, {rd("CASE WHEN spend > 0 THEN ln(1 + spend) ELSE spend END", "spend")},
    {rd("CASE WHEN strain > 0 THEN sqrt(strain) ELSE strain END", "strain")} FROM z""",
)
def _(spark, sf):
    rows = clean.fill_zero(
        panel(spark, sf).select("id", "date", "spend", "strain"), ["spend", "strain"]
    )
    return rounded(clean.power_transform_nonzero(rows, ["spend"], ["strain"]))


@query(
    "presence_flag",
    f"WITH {PANEL} SELECT id, date, (mood IS NOT NULL)::INT AS has_mood FROM panel",
)
def _(spark, sf):
    return clean.presence_flag(panel(spark, sf), "mood", "has_mood").select(
        "id", "date", "has_mood"
    )


_N5 = " + ".join(f"({c} IS NOT NULL)::INT" for c in COLS)
_S5 = " + ".join(f"coalesce({c}, 0)" for c in COLS)


@query(
    "row_family_stats",
    f"WITH {PANEL} SELECT id, date, {_N5} AS family_count, {rd(f'({_S5}) / nullif({_N5}, 0)', 'family_mean')} FROM panel",
)
def _(spark, sf):
    return rounded(
        clean.row_family_stats(panel(spark, sf), COLS, "family").select(
            "id", "date", "family_count", "family_mean"
        )
    )


@query(
    "drop_missing",
    f"WITH {PANEL} SELECT id, date, {rds('mood strain')} FROM panel WHERE mood IS NOT NULL AND strain IS NOT NULL",
)
def _(spark, sf):
    return rounded(
        clean.drop_missing(panel(spark, sf), ["mood", "strain"]).select(
            "id", "date", "mood", "strain"
        )
    )


@query(
    "clean_for_model",
    f"WITH {PANEL} SELECT id, date, {rd('coalesce(mood, 0)', 'mood')}, {rd('coalesce(strain, 0)', 'strain')} FROM panel",
)
def _(spark, sf):
    rows = panel(spark, sf).select(
        "id",
        "date",
        F.coalesce("mood", F.lit(float("nan"))).alias("mood"),
        F.coalesce("strain", F.lit(float("inf"))).alias("strain"),
    )
    return rounded(clean.clean_for_model(rows, ["mood", "strain"]))


@query(
    "to_numeric",
    """SELECT event_id, TRY_CAST(regexp_extract(props, ': (.*)\\}', 1) AS DOUBLE) AS k,
    TRY_CAST(event_type AS DOUBLE) AS kind FROM events""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        F.regexp_extract("props", r": (.*)\}", 1).alias("k"),
        F.col("event_type").alias("kind"),
    )
    return clean.to_numeric(rows, ["k", "kind"])


@query(
    "type_label",
    f"""WITH {M} SELECT variable, CASE WHEN variable IN ('view', 'error') THEN 'self_report'
      WHEN variable = 'purchase' THEN 'sensor' ELSE 'other' END AS kind, count(*) AS n FROM m GROUP BY 1, 2""",
)
def _(spark, sf):
    labels = {"view": "self_report", "error": "self_report", "purchase": "sensor"}
    return (
        clean.type_label(measurements(spark, sf), labels)
        .groupBy("variable", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "downcast",
    "SELECT l_orderkey::INT AS l_orderkey, l_linenumber, round(l_quantity, 2) + 0.0 AS l_quantity FROM lineitem",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(clean.downcast(rows), 2)


def _fence(c, mult):
    return (
        f"CASE WHEN {c} BETWEEN (SELECT q1_{c} - {mult} * (q3_{c} - q1_{c}) FROM q) "
        f"AND (SELECT q3_{c} + {mult} * (q3_{c} - q1_{c}) FROM q) THEN {c} END"
    )


def _quartiles(cols, lo=0.25, hi=0.75):
    return ", ".join(
        f"quantile_cont({c}, {lo}) AS q1_{c}, quantile_cont({c}, {hi}) AS q3_{c}" for c in cols
    )


@query(
    "iqr_filter",
    f"""WITH {PANEL}, q AS (SELECT {_quartiles(["strain", "spend", "clicks"])} FROM panel)
    SELECT id, date, {", ".join(rd(_fence(c, 1.5), c) for c in ("strain", "spend", "clicks"))} FROM panel""",
)
def _(spark, sf):
    cols = ["strain", "spend", "clicks"]
    return rounded(clean.iqr_filter(panel(spark, sf).select("id", "date", *cols), cols, 1.5))


@query(
    "iqr_filter_long",
    f"""WITH {M}, q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY variable)
    SELECT id, time, variable, {rd("CASE WHEN value BETWEEN greatest(0, q1 - 1.5 * (q3 - q1)) AND q3 + 1.5 * (q3 - q1) THEN value END", "value")}
    FROM m JOIN q USING (variable)""",
)
def _(spark, sf):
    rows = measurements(spark, sf).drop("date")
    return rounded(clean.iqr_filter_long(rows, 1.5))


@query(
    "iqr_filter_long_upper",
    f"""WITH {M}, q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY variable)
    SELECT id, time, variable, {rd("CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END", "value")} FROM m JOIN q USING (variable)""",
)
def _(spark, sf):
    rows = measurements(spark, sf).drop("date")
    return rounded(clean.iqr_filter_long(rows, 1.5, upper_only=True))


@query(
    "zscore_filter",
    f"""WITH {PANEL}, s AS (SELECT avg(strain) AS m1, stddev_samp(strain) AS s1, avg(spend) AS m2, stddev_samp(spend) AS s2 FROM panel)
    SELECT id, date, {rd("CASE WHEN abs((strain - m1) / s1) <= 2 THEN strain END", "strain")},
    {rd("CASE WHEN abs((spend - m2) / s2) <= 2 THEN spend END", "spend")} FROM panel, s""",
)
def _(spark, sf):
    rows = panel(spark, sf).select("id", "date", "strain", "spend")
    return rounded(clean.zscore_filter(rows, ["strain", "spend"], 2.0))


@query(
    "winsorize",
    f"""WITH {PANEL}, q AS (SELECT {_quartiles(["strain", "spend"], 0.05, 0.95)} FROM panel)
    SELECT id, date, """
    + ", ".join(
        rd(f"CASE WHEN {c} < q1_{c} THEN q1_{c} WHEN {c} > q3_{c} THEN q3_{c} ELSE {c} END", c)
        for c in ("strain", "spend")
    )
    + " FROM panel, q",
)
def _(spark, sf):
    rows = panel(spark, sf).select("id", "date", "strain", "spend")
    return rounded(clean.winsorize(rows, ["strain", "spend"]))


@query(
    "trim_top_quantile_if_sparse",
    """WITH q AS (SELECT min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.99) AS p FROM events),
    b AS (SELECT count(DISTINCT least(floor((value - lo) / (hi - lo) * 30), 29)) AS filled FROM events, q)
    SELECT event_id, value FROM events, q, b WHERE (30 - filled) / 30.0 <= 0.05 OR value <= p""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return clean.trim_top_quantile_if_sparse(rows, "value", empty=0.05)


@query("combine_parts", f"WITH {DAILY} SELECT id, date, {rds(ALL)} FROM daily")
def _(spark, sf):
    # Per-variable rollups joined in full give the same rows as one conditional aggregate.
    rows = measurements(spark, sf)
    parts = [rollup.daily_rollup(rows, {name: rule}) for name, rule in RULES.items()]
    return rounded(joins.combine_parts(parts, ["id", "date"]))


@query(
    "pair_variables",
    f"""WITH {M}, h AS (SELECT id, date, variable, sum(value) AS value FROM m GROUP BY ALL)
    SELECT a.id, a.date, {rd("a.value", '"view"')}, {rd("b.value", "error")} FROM h a JOIN h b ON a.id = b.id AND a.date = b.date WHERE a.variable = 'view' AND b.variable = 'error'""",
)
def _(spark, sf):
    rows = measurements(spark, sf).groupBy("id", "date", "variable")
    rows = rows.agg(F.sum("value").alias("value"))
    return rounded(joins.pair_variables(rows, "view", "error", ["id", "date"]))


# --- filling and gaps ---------------------------------------------------------------------

_SO_FAR = "(PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_FROM_HERE = "(PARTITION BY id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _ffill(c):
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER {_SO_FAR}, "
        f"first_value({c} IGNORE NULLS) OVER {_FROM_HERE})"
    )


@query(
    "forward_backward_fill",
    f"WITH {CLEAN} SELECT id, date, " + ", ".join(rd(_ffill(c), c) for c in COLS) + " FROM clean",
)
def _(spark, sf):
    return rounded(impute.forward_backward_fill(cleaned(spark, sf), COLS))


@query("interpolate_linear", f"WITH {FILLED} SELECT id, date, {rds(ALL)} FROM filled")
def _(spark, sf):
    return rounded(interpolated(spark, sf))


@query(
    "impute_hybrid",
    f"""WITH {FILLED} SELECT f.id, f.date, {rd("f.mood", "mood")}, {rd("f.strain", "strain")}, {rd("c.spend", "spend")} FROM filled f
    JOIN (SELECT id, date, {_ffill("spend")} AS spend FROM clean) c ON f.id = c.id AND f.date = c.date""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood", "strain", "spend")
    return rounded(impute.impute_hybrid(rows, ["mood", "strain"], ["spend"]))


_RUNS = f"""{CLEAN},
r AS (SELECT id, date, mood, count(mood) OVER {_SO_FAR} AS run FROM clean),
gaps AS (SELECT id, run, min(date) AS gap_start, max(date) AS gap_end, count(*) AS gap_days FROM r WHERE mood IS NULL GROUP BY id, run)"""


@query("gap_runs", f"WITH {_RUNS} SELECT id, gap_start, gap_end, gap_days FROM gaps")
def _(spark, sf):
    return impute.gap_runs(cleaned(spark, sf), "mood")


@query(
    "gap_lengths",
    f"""WITH {_RUNS} SELECT id, count(*) AS gaps, max(gap_days) AS longest_gap, {rd("avg(gap_days)", "mean_gap")},
    count(*) FILTER (gap_days > 7) AS long_gaps FROM gaps GROUP BY id""",
)
def _(spark, sf):
    return rounded(impute.gap_lengths(cleaned(spark, sf), "mood"))


@query(
    "long_gap_mask",
    f"""WITH {_RUNS} SELECT r.id, r.date, r.mood IS NULL AND coalesce(gap_days, 0) > 3 AS in_long_gap
    FROM r LEFT JOIN gaps ON r.id = gaps.id AND r.run = gaps.run""",
)
def _(spark, sf):
    return impute.long_gap_mask(cleaned(spark, sf), "mood", 3).select("id", "date", "in_long_gap")


@query(
    "restore_long_gaps",
    f"""WITH {_RUNS}, {_interp_sql("clean", ["mood"])} SELECT f.id, f.date,
    {rd("CASE WHEN NOT (r.mood IS NULL AND coalesce(gap_days, 0) > 3) THEN f.mood END", "mood")}
    FROM filled f JOIN r ON f.id = r.id AND f.date = r.date LEFT JOIN gaps ON r.id = gaps.id AND r.run = gaps.run""",
)
def _(spark, sf):
    marked = impute.long_gap_mask(cleaned(spark, sf).select("id", "date", "mood"), "mood", 3)
    filled = impute.interpolate_linear(marked, ["mood"])
    return rounded(
        impute.restore_long_gaps(filled, ["mood"], ["in_long_gap"]).drop("in_long_gap")
    )


@query(
    "delete_long_gaps",
    f"""WITH {_RUNS} SELECT r.id, r.date, {rd("r.mood", "mood")} FROM r LEFT JOIN gaps ON r.id = gaps.id AND r.run = gaps.run
    WHERE NOT (r.mood IS NULL AND coalesce(gap_days, 0) > 2)""",
)
def _(spark, sf):
    return rounded(
        impute.delete_long_gaps(cleaned(spark, sf).select("id", "date", "mood"), "mood", 2)
    )


@query(
    "median_fill",
    f"""WITH {CLEAN}, i AS (SELECT id, quantile_cont(mood, 0.5) AS a FROM clean GROUP BY id),
    t AS (SELECT quantile_cont(mood, 0.5) AS b FROM clean)
    SELECT clean.id, date, {rd("coalesce(mood, a, b)", "mood")}, {rd("coalesce(spend, 0)", "spend")} FROM clean JOIN i USING (id), t""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood", "spend")
    return rounded(impute.median_fill(rows, ["mood"], zero=["spend"]))


_KNN_PAIR = " + ".join(f"coalesce((a.{c} - b.{c}) ** 2, 0)" for c in COLS)
_KNN_COMMON = " + ".join(f"(a.{c} IS NOT NULL AND b.{c} IS NOT NULL)::INT" for c in COLS)
_KNN_COLS = " UNION ALL ".join(
    f"""SELECT a.id, a.date, '{c}' AS col, b.{c} AS v, b.date AS bdate,
    round((({_KNN_PAIR}) * 5.0 / nullif({_KNN_COMMON}, 0))::DOUBLE, 9) AS d
    FROM z a JOIN z b ON a.id = b.id AND a.date <> b.date WHERE a.{c} IS NULL AND b.{c} IS NOT NULL"""
    for c in COLS
)
_KNN_FILL = ", ".join(
    rd(
        f"coalesce(z.{c}, (SELECT avg(v) FILTER (d IS NOT NULL) FROM k WHERE k.id = z.id AND k.date = z.date AND col = '{c}'), n_{c})",
        c,
    )
    for c in COLS
)


@query(
    "impute_knn",
    f"""WITH {CLEAN}, {", ".join(f"n{c} AS (SELECT id, avg({c}) AS n_{c} FROM clean GROUP BY id)" for c in COLS)},
    z AS (SELECT id, date, {", ".join(f"CASE WHEN n_{c} IS NULL THEN 0 ELSE {c} END AS {c}, n_{c}" for c in COLS)}
      FROM clean {" ".join(f"JOIN n{c} USING (id)" for c in COLS)}),
    pairs AS ({_KNN_COLS}),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, date, col ORDER BY d NULLS LAST, bdate) AS rn FROM pairs) WHERE rn <= 3)
    SELECT id, date, {_KNN_FILL} FROM z""",
)
def _(spark, sf):
    return rounded(impute.impute_knn(cleaned(spark, sf), COLS, 3))


@query("impute_regression")
def _(spark, sf):
    return rounded(impute.impute_regression(cleaned(spark, sf), COLS), 4)


@query("impute_evidence")
def _(spark, sf):
    return rounded(impute.impute_evidence(cleaned(spark, sf), COLS, longest=3), 4)


# --- row windows --------------------------------------------------------------------------


def _roll(c, agg, w=F7):
    simple = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    if agg in simple:
        return f"{simple[agg]}({c}) OVER {w}"
    if agg == "median":
        return f"quantile_cont({c}, 0.5) OVER {w}"
    if agg == "trend":
        return f"CASE WHEN count({c}) OVER {w} >= 2 THEN regr_slope({c}, rn) OVER {w} ELSE 0 END"
    if agg == "skew":
        return SKEW.format(x=c, w=w)
    return KURT.format(x=c, w=w)


def _rolling_sql(source, cols, aggs, sizes=(7,), extra=""):
    feats = ", ".join(
        f"{_roll(c, a, f'(PARTITION BY id ORDER BY date ROWS BETWEEN {s} PRECEDING AND 1 PRECEDING)')} AS {c}_{a}{f'_w{s}' if len(sizes) > 1 else ''}"
        for s in sizes
        for c in cols
        for a in aggs
    )
    names = " ".join(
        f"{c}_{a}{f'_w{s}' if len(sizes) > 1 else ''}" for s in sizes for c in cols for a in aggs
    )
    return f"""rowed AS (SELECT *, row_number() OVER {BY} AS rn FROM {source}),
    feats AS (SELECT id, date, rn, {extra} {feats} FROM rowed)
    SELECT id, date, {"{keep}"} {rds(names)} FROM feats WHERE rn > {max(sizes)}"""


_BASE_AGGS = ("mean", "std", "min", "max", "trend")


@query(
    "rolling_features",
    f"WITH {CLEAN}, " + _rolling_sql("clean", COLS, _BASE_AGGS).replace("{keep}", ""),
)
def _(spark, sf):
    return rounded(windows.rolling_features(cleaned(spark, sf), COLS))


@query(
    "rolling_multi_window",
    f"WITH {CLEAN}, "
    + _rolling_sql("clean", ["mood", "strain"], ("mean", "std"), (3, 7, 14)).replace("{keep}", ""),
)
def _(spark, sf):
    return rounded(
        windows.rolling_features(cleaned(spark, sf), ["mood", "strain"], (3, 7, 14), ("mean", "std"))
    )


@query(
    "rolling_median",
    f"WITH {CLEAN}, " + _rolling_sql("clean", ["mood", "spend"], ("median",)).replace("{keep}", ""),
)
def _(spark, sf):
    return rounded(
        windows.rolling_features(cleaned(spark, sf), ["mood", "spend"], aggs=("median",))
    )


@query(
    "rolling_trend",
    f"WITH {CLEAN}, " + _rolling_sql("clean", ["mood", "spend"], ("trend",)).replace("{keep}", ""),
)
def _(spark, sf):
    return rounded(
        windows.rolling_features(cleaned(spark, sf), ["mood", "spend"], aggs=("trend",))
    )


@query(
    "closed_trend",
    f"""WITH {CLEAN}, p AS (SELECT *, row_number() OVER {BY} AS rn, {", ".join(f"CASE WHEN {c} IS NOT NULL THEN count({c}) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS p_{c}" for c in ("mood", "spend"))} FROM clean),
    t AS (SELECT id, date, rn, {", ".join(f"regr_slope({c}, p_{c}) OVER {F7} AS {c}_trend" for c in ("mood", "spend"))} FROM p)
    SELECT id, date, {rds("mood_trend spend_trend")} FROM t WHERE rn > 7""",
)
def _(spark, sf):
    return rounded(windows.closed_trend(cleaned(spark, sf), ["mood", "spend"]))


@query(
    "ema_early_value",
    f"""WITH {CLEAN}, r AS (SELECT id, date, row_number() OVER {BY} AS rn,
      CASE WHEN row_number() OVER {BY} = 1 THEN 1e30::DOUBLE ELSE mood END AS mood FROM clean)
    SELECT a.id, a.date, {rd("log10(sum(power(0.75, a.rn - 1 - b.rn) * b.mood) / sum(CASE WHEN b.mood IS NOT NULL THEN power(0.75, a.rn - 1 - b.rn) END))", "mood_ema7")} FROM r a LEFT JOIN r b ON a.id = b.id AND b.rn < a.rn GROUP BY a.id, a.date""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood")
    first = F.row_number().over(windows.by_id()) == 1
    rows = rows.withColumn("mood", F.when(first, 1e30).otherwise(F.col("mood")))
    found = windows.ema(rows, ["mood"], (7,)).drop("mood")
    return rounded(found.withColumn("mood_ema7", F.log10("mood_ema7")))


@query(
    "rolling_skew_kurt",
    f"WITH {FILLED}, "
    + _rolling_sql("filled", ["mood", "spend"], ("skew", "kurtosis")).replace("{keep}", ""),
)
def _(spark, sf):
    rows = interpolated(spark, sf)
    return rounded(windows.rolling_features(rows, ["mood", "spend"], aggs=("skew", "kurtosis")))


@query(
    "instance_table",
    f"WITH {FILLED}, labelled AS (SELECT f.*, c.mood AS raw FROM filled f JOIN clean c ON f.id = c.id AND f.date = c.date), "
    + _rolling_sql(
        "labelled",
        COLS,
        _BASE_AGGS,
        extra=f"raw AS target, lag(mood, 1) OVER {BY} AS mood_lag1, lag(mood, 2) OVER {BY} AS mood_lag2, lag(mood, 3) OVER {BY} AS mood_lag3,",
    ).replace("{keep}", rds("target mood_lag1 mood_lag2 mood_lag3") + ",")
    + " AND target IS NOT NULL",
)
def instance_table(spark, sf):
    """Measurements to modelling rows: rollup, calendar, bounds, interpolation, windows, lags."""
    rows = cleaned(spark, sf).withColumn("target", F.col("mood"))
    rows = impute.interpolate_linear(rows, COLS)
    keep = {"target": F.col("target"), **windows.lag_columns("mood", 3)}
    built = windows.rolling_features(rows, COLS, keep=keep)
    return rounded(clean.drop_missing(built, ["target"]))


@query(
    "lags",
    f"WITH {CLEAN}, l AS (SELECT id, date, "
    + ", ".join(f"lag(mood, {i}) OVER {BY} AS mood_lag{i}" for i in (1, 2, 3))
    + f" FROM clean) SELECT id, date, {rds('mood_lag1 mood_lag2 mood_lag3')} FROM l",
)
def _(spark, sf):
    return rounded(
        windows.lags(cleaned(spark, sf).select("id", "date", "mood"), "mood", 3).drop("mood")
    )


@query(
    "lead_change",
    f"WITH {CLEAN}, l AS (SELECT id, date, mood, lead(mood) OVER {BY} AS mood_next FROM clean) "
    f"SELECT id, date, {rd('mood_next')}, {rd('mood_next - mood', 'mood_next_change')} FROM l",
)
def _(spark, sf):
    rows = windows.lead_change(cleaned(spark, sf).select("id", "date", "mood"), "mood")
    return rounded(rows.drop("mood"))


@query(
    "target_as_change",
    f"""WITH {CLEAN}, l AS (SELECT id, date, mood, mood - lag(mood) OVER {BY} AS mood_change FROM clean)
    SELECT id, date, {rds("mood mood_change")} FROM l WHERE mood_change IS NOT NULL""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood")
    rows = rows.withColumn("mood_change", F.col("mood") - F.lag("mood").over(windows.by_id()))
    return rounded(clean.drop_missing(rows, ["mood_change"]))


_EMA = """WITH {clean}, r AS (SELECT id, date, mood, spend, row_number() OVER {by} AS rn FROM clean)
SELECT a.id, a.date, {cols} FROM r a LEFT JOIN r b ON a.id = b.id AND b.rn < a.rn GROUP BY a.id, a.date"""


def _ema_col(c, span):
    d = 1 - 2 / (span + 1)
    w = f"power({d!r}, a.rn - 1 - b.rn)"
    return rd(
        f"sum({w} * b.{c}) / nullif(sum(CASE WHEN b.{c} IS NOT NULL THEN {w} END), 0)",
        f"{c}_ema{span}",
    )


@query(
    "ema",
    _EMA.format(
        clean=CLEAN,
        by=BY,
        cols=", ".join(_ema_col(c, s) for c in ("mood", "spend") for s in (3, 7)),
    ),
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood", "spend")
    return rounded(windows.ema(rows, ["mood", "spend"]).drop("mood", "spend"))


@query(
    "ema_weighted_mean",
    f"""WITH {CLEAN}, r AS (SELECT id, date, mood, row_number() OVER {BY} AS rn FROM clean)
    SELECT a.id, a.date, {rd("sum(power(0.75, a.rn - 1 - b.rn) * b.mood) / sum(CASE WHEN b.mood IS NOT NULL THEN power(0.75, a.rn - 1 - b.rn) END)", "mood_ewmean")}
    FROM r a LEFT JOIN r b ON a.id = b.id AND b.rn BETWEEN a.rn - 7 AND a.rn - 1 GROUP BY a.id, a.date""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood")
    return rounded(windows.ema_weighted_mean(rows, ["mood"]).drop("mood"))


_EWSTD = f"""r AS (SELECT id, date, mood, row_number() OVER {BY} AS rn FROM clean),
w AS (SELECT a.id, a.date, power(0.75, a.rn - 1 - b.rn) AS w, b.mood AS x FROM r a LEFT JOIN r b
  ON a.id = b.id AND b.rn BETWEEN a.rn - 7 AND a.rn - 1 AND b.mood IS NOT NULL),
g AS (SELECT id, date, sum(w) AS sw, sum(w * w) AS sww, sum(w * x) / sum(w) AS mean FROM w GROUP BY id, date),
s AS (SELECT id, date, any_value(sw) AS sw, any_value(sww) AS sww, sum(w * (x - mean) ** 2) AS ss FROM w JOIN g USING (id, date) GROUP BY id, date),
ew AS (SELECT id, date, CASE WHEN sw * sw - sww > 1e-12 THEN sqrt(ss / sw * sw * sw / (sw * sw - sww)) END AS mood_ewstd FROM s)"""


@query("ewm_std", f"WITH {CLEAN}, {_EWSTD} SELECT id, date, {rd('mood_ewstd')} FROM ew")
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood")
    return rounded(windows.ewm_std(rows, ["mood"]).drop("mood"))


@query(
    "adaptive_direction",
    f"""WITH {CLEAN}, {_EWSTD}, c AS (SELECT id, date, lag(mood, 1) OVER {BY} - lag(mood, 2) OVER {BY} AS ch FROM clean),
    t AS (SELECT id, date, ch, CASE WHEN mood_ewstd > 1e-9 THEN mood_ewstd * 0.5 ELSE 0.3 END AS lim FROM c JOIN ew USING (id, date))
    SELECT id, date, CASE WHEN ch > lim THEN 1 WHEN ch < -lim THEN -1 ELSE 0 END AS mood_adaptive FROM t""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood")
    return windows.adaptive_direction(rows, "mood").drop("mood")


@query(
    "volatility",
    f"""WITH {CLEAN} SELECT id, date, {rd(f"max(mood) OVER {F7} - min(mood) OVER {F7}", "mood_range")},
    {rd(f"CASE WHEN avg(mood) OVER {F7} > 0 THEN stddev_samp(mood) OVER {F7} / avg(mood) OVER {F7} ELSE 0 END", "mood_cv")},
    sign(lag(mood, 1) OVER {BY} - lag(mood, 2) OVER {BY})::DOUBLE AS mood_direction FROM clean""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood")
    return rounded(windows.volatility(rows, "mood").drop("mood"))


_SIGNS = ", ".join(
    f"coalesce(sign(lag(spend, {i}) OVER {BY} - lag(spend, {i + 1}) OVER {BY}), 0) AS s{i}"
    for i in range(1, 8)
)
_LENGTH = (
    "CASE WHEN s1 = 0 THEN 0 "
    + " ".join(f"WHEN s{i + 1} <> s1 THEN {i}" for i in range(1, 7))
    + " ELSE 7 END"
)
_AFTER = "CASE n " + " ".join(f"WHEN {i} THEN s{i + 1}" for i in range(1, 7)) + " ELSE 0 END"


def _momentum_sql(exact):
    extra = "(after <> 0 AND s1 <> 0)::INT" if exact else "0"
    return f"""WITH {FILLED}, s AS (SELECT id, date, {_SIGNS} FROM filled),
    l AS (SELECT *, {_LENGTH} AS n FROM s), a AS (SELECT *, {_AFTER} AS after FROM l),
    c AS (SELECT id, date, CASE WHEN s1 > 0 THEN n ELSE {extra} END AS up_days, CASE WHEN s1 < 0 THEN n ELSE {extra} END AS down_days FROM a)
    SELECT id, date, up_days::INT AS up_days, down_days::INT AS down_days,
    CASE WHEN up_days >= 2 THEN -1 WHEN down_days >= 2 THEN 1 ELSE 0 END AS reversal FROM c"""


@query("momentum", _momentum_sql(True))
def _(spark, sf):
    rows = interpolated(spark, sf).select("id", "date", "spend")
    return windows.momentum(rows, "spend").drop("spend")


@query("momentum_clean_stop", _momentum_sql(False))
def _(spark, sf):
    rows = interpolated(spark, sf).select("id", "date", "spend")
    return windows.momentum(rows, "spend", exact=False).drop("spend")


@query(
    "run_lengths",
    f"""WITH {FILLED}, s AS (SELECT id, date, coalesce(sign(mood - lag(mood) OVER {BY}), 0) AS mv FROM filled),
    c AS (SELECT *, CASE WHEN mv = lag(mv) OVER {BY} THEN 0 ELSE 1 END AS fresh FROM s),
    g AS (SELECT *, sum(fresh) OVER {_SO_FAR} AS run FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY date) AS len FROM g)
    SELECT id, date, coalesce(lag(CASE WHEN mv > 0 THEN len ELSE 0 END) OVER {BY}, 0)::INT AS up_run,
    coalesce(lag(CASE WHEN mv < 0 THEN len ELSE 0 END) OVER {BY}, 0)::INT AS down_run FROM n""",
)
def _(spark, sf):
    rows = interpolated(spark, sf).select("id", "date", "mood")
    return windows.run_lengths(rows, "mood").drop("mood")


@query(
    "mean_reversion",
    f"WITH {CLEAN} SELECT id, date, {rd(f'lag(mood) OVER {BY} - avg(mood) OVER {F7}', 'mood_reversion')} FROM clean",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood")
    return rounded(windows.mean_reversion(rows, "mood").drop("mood"))


@query(
    "day_change",
    f"WITH {CLEAN} SELECT id, date, "
    + ", ".join(
        rd(f"coalesce(lag({c}, 1) OVER {BY} - lag({c}, 2) OVER {BY}, 0)", f"{c}_change")
        for c in COLS
    )
    + " FROM clean",
)
def _(spark, sf):
    return rounded(windows.day_change(cleaned(spark, sf), COLS).drop(*COLS))


def _autocorr(k):
    w = f"(PARTITION BY id ORDER BY date ROWS BETWEEN {7 - k} PRECEDING AND 1 PRECEDING)"
    return rd(
        f"CASE WHEN count(mood) OVER {F7} = 7 AND stddev_pop(mood) OVER {F7} > 1e-12 AND stddev_pop(mood) OVER {w} > 1e-12 "
        f"AND stddev_pop(l{k}) OVER {w} > 1e-12 THEN corr(mood, l{k}) OVER {w} ELSE 0 END",
        f"mood_autocorr{k}",
    )


@query(
    "rolling_autocorr",
    f"WITH {FILLED}, s AS (SELECT id, date, mood, lag(mood, 1) OVER {BY} AS l1, lag(mood, 2) OVER {BY} AS l2 FROM filled) "
    f"SELECT id, date, {_autocorr(1)}, {_autocorr(2)} FROM s",
)
def _(spark, sf):
    rows = interpolated(spark, sf).select("id", "date", "mood")
    return rounded(windows.rolling_autocorr(rows, "mood").drop("mood"))


@query(
    "rmssd",
    f"""WITH {CLEAN}, r AS (SELECT id, date, mood, row_number() OVER {BY} AS rn FROM clean),
    p AS (SELECT a.id, a.date, b.mood, lag(b.mood) OVER (PARTITION BY a.id, a.date ORDER BY b.rn) AS prev FROM r a LEFT JOIN r b
      ON a.id = b.id AND b.rn BETWEEN a.rn - 7 AND a.rn - 1 AND b.mood IS NOT NULL)
    SELECT id, date, {rd("CASE WHEN count(mood) >= 3 THEN sqrt(avg((mood - prev) ** 2)) ELSE 0 END", "mood_rmssd")} FROM p GROUP BY id, date""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood")
    return rounded(windows.rmssd(rows, "mood").drop("mood"))


_F3 = "(PARTITION BY id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@query(
    "short_std",
    f"WITH {CLEAN} SELECT id, date, "
    + ", ".join(rd(f"stddev_samp({c}) OVER {_F3}", f"{c}_std3") for c in ("mood", "strain", "spend"))
    + " FROM clean",
)
def _(spark, sf):
    cols = ["mood", "strain", "spend"]
    rows = cleaned(spark, sf).select("id", "date", *cols)
    return rounded(windows.short_std(rows, cols).drop(*cols))


@query(
    "study_day",
    f"WITH {PANEL} SELECT id, date, (date - min(date) OVER (PARTITION BY id))::INT AS study_day FROM panel",
)
def _(spark, sf):
    return windows.study_day(panel(spark, sf)).select("id", "date", "study_day")


@query(
    "same_day",
    f"WITH {PANEL} SELECT id, date, {rd(f'CASE WHEN lead(date) OVER {BY} IS NOT NULL THEN spend END', 'spend_same_day')} FROM panel",
)
def _(spark, sf):
    rows = panel(spark, sf).select("id", "date", "spend")
    return rounded(windows.same_day(rows, ["spend"]).drop("spend"))


@query(
    "missing_share",
    f"WITH {CLEAN}, g AS (SELECT id, date, (5 - ({_N5})) / 5.0 AS gone FROM clean) "
    f"SELECT id, date, {rd(f'avg(gone) OVER {F7}', 'missing_share_7')} FROM g",
)
def _(spark, sf):
    return rounded(windows.missing_share(cleaned(spark, sf), COLS).drop(*COLS))


def _z(c):
    w = "(PARTITION BY id)"
    return rd(
        f"CASE WHEN stddev_samp({c}) OVER {w} > 0 THEN ({c} - avg({c}) OVER {w}) / stddev_samp({c}) OVER {w} ELSE 0 END",
        c,
    )


@query(
    "zscore_per_id",
    f"WITH {CLEAN} SELECT id, date, {_z('mood')}, {_z('spend')} FROM clean",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood", "spend")
    return rounded(windows.zscore_per_id(rows, ["mood", "spend"]))


@query(
    "minmax_per_id",
    f"""WITH {CLEAN}, t AS (SELECT id, date, mood, date < DATE '2024-01-25' AS tr, CASE WHEN date < DATE '2024-01-25' THEN mood END AS x FROM clean),
    e AS (SELECT *, min(x) OVER (PARTITION BY id) AS lo, max(x) OVER (PARTITION BY id) AS hi, min(x) OVER () AS glo, max(x) OVER () AS ghi FROM t)
    SELECT id, date, {rd("CASE WHEN tr THEN (mood - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END ELSE (mood - glo) / (ghi - glo) END", "mood")} FROM e""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood")
    return rounded(
        windows.minmax_per_id(rows, ["mood"], F.col("date") < F.lit("2024-01-25").cast("date"))
    )


@query(
    "sequences",
    f"""WITH {FILLED}, r AS (SELECT f.id, f.date, c.mood AS raw, f.mood, f.spend, row_number() OVER (PARTITION BY f.id ORDER BY f.date) AS rn
      FROM filled f JOIN clean c ON f.id = c.id AND f.date = c.date)
    SELECT a.id, a.date, (b.rn - a.rn + 7)::INT AS step, {rd("b.mood::FLOAT", "mood", 3)}, {rd("b.spend::FLOAT", "spend", 3)}, {rd("a.raw", "target", 3)}
    FROM r a JOIN r b ON a.id = b.id AND b.rn BETWEEN a.rn - 7 AND a.rn - 1 WHERE a.rn > 7 AND a.raw IS NOT NULL""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).withColumn("raw", F.col("mood")).select(
        "id", "date", "mood", "spend", "raw"
    )
    rows = windows.sequences(impute.interpolate_linear(rows, ["mood", "spend"]), ["mood", "spend"], "raw")
    steps = rows.select("id", "date", F.posexplode("sequence").alias("step", "v"), "target")
    cells = steps.select(
        "id", "date", "step", F.col("v")[0].alias("mood"), F.col("v")[1].alias("spend"), "target"
    )
    return rounded(cells, 3)


@query(
    "explode_windows",
    f"""WITH {CLEAN}, r AS (SELECT id, date, mood, row_number() OVER {BY} AS rn FROM clean)
    SELECT a.id, a.rn::INT AS window_row, b.date, CASE WHEN a.rn = b.rn THEN 'test' ELSE 'train' END AS part, {rd("b.mood", "mood")}
    FROM r a JOIN r b ON a.id = b.id AND b.rn BETWEEN a.rn - 7 AND a.rn WHERE a.rn > 7""",
)
def _(spark, sf):
    return rounded(windows.explode_windows(cleaned(spark, sf), ["mood"]))


# --- row features -------------------------------------------------------------------------

_DOW = "(isodow(date) - 1)"


@query(
    "cyclic_weekday",
    f"""WITH {PANEL} SELECT id, date, {rd(f"sin(2 * pi() * {_DOW} / 7)", "dow_sin")}, {rd(f"cos(2 * pi() * {_DOW} / 7)", "dow_cos")},
    ({_DOW} >= 5)::INT AS is_weekend,
    (CASE WHEN {_DOW} >= 5 THEN 0 ELSE least((5 - {_DOW} + 7) % 7, ({_DOW} - 6 + 7) % 7) END)::INT AS weekend_distance FROM panel""",
)
def _(spark, sf):
    day = F.col("date")
    return rounded(
        panel(spark, sf).select(
            "id",
            "date",
            scalar.weekday_sin(day).alias("dow_sin"),
            scalar.weekday_cos(day).alias("dow_cos"),
            scalar.is_weekend(day).alias("is_weekend"),
            scalar.weekend_distance(day).alias("weekend_distance"),
        )
    )


@query(
    "interactions_and_ratios",
    f"""WITH {FILLED}, f AS (SELECT id, date, avg(mood) OVER {F7} AS a, avg(strain) OVER {F7} AS b, avg(spend) OVER {F7} AS c, avg(clicks) OVER {F7} AS d FROM filled)
    SELECT id, date, {rd("a * b", "product")}, {rd("c / greatest(d, 0.001)", "ratio")}, {rd("c + d", "total")}, {rd("d / greatest(c + 0.001, 0.001)", "share")}
    FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL""",
)
def _(spark, sf):
    cols = ["mood", "strain", "spend", "clicks"]
    means = interpolated(spark, sf).select(
        "id", "date", *[F.avg(c).over(windows.before(7)).alias(f"{c}_mean") for c in cols]
    )
    a, b, c, d = (F.col(f"{x}_mean") for x in cols)
    return rounded(
        clean.drop_missing(means, [f"{x}_mean" for x in cols]).select(
            "id",
            "date",
            (a * b).alias("product"),
            scalar.floored_ratio(c, d).alias("ratio"),
            (c + d).alias("total"),
            scalar.floored_ratio(d, c + 0.001).alias("share"),
        )
    )


@query(
    "level_and_quadrant",
    f"""WITH {PANEL}, p AS (SELECT id, date, mood, (mood - 50) / 100 AS h, (strain - 50) / 100 AS v FROM panel WHERE mood IS NOT NULL AND strain IS NOT NULL)
    SELECT id, date, CASE WHEN mood < 40 THEN 0 WHEN mood > 60 THEN 2 ELSE 1 END AS level,
    {rd("sqrt(v * v + h * h)", "intensity")}, {rd("atan2(v, h)", "angle")},
    CASE WHEN abs(v) < 0.1 AND abs(h) < 0.1 THEN 0 WHEN h >= 0 AND v >= 0 THEN 1 WHEN h < 0 AND v >= 0 THEN 2 WHEN h < 0 AND v < 0 THEN 3 ELSE 4 END AS quadrant
    FROM p""",
)
def _(spark, sf):
    rows = clean.drop_missing(panel(spark, sf), ["mood", "strain"])
    v, h = (F.col("strain") - 50) / 100, (F.col("mood") - 50) / 100
    return rounded(
        rows.select(
            "id",
            "date",
            scalar.level(F.col("mood"), 40, 60).alias("level"),
            scalar.intensity(v, h).alias("intensity"),
            scalar.angle(v, h).alias("angle"),
            scalar.quadrant(v, h).alias("quadrant"),
        )
    )


def _share(c):
    total = "(coalesce(spend, 0) + coalesce(clicks, 0) + coalesce(signups, 0))"
    return f"CASE WHEN {c} > 0 THEN ({c} / {total}) * ln({c} / {total}) ELSE 0 END"


@query(
    "app_diversity_entropy",
    f"""WITH {PANEL}, y AS (SELECT id, date, lag(spend) OVER {BY} AS spend, lag(clicks) OVER {BY} AS clicks, lag(signups) OVER {BY} AS signups FROM panel)
    SELECT id, date, (CASE WHEN spend > 0 THEN 1 ELSE 0 END + CASE WHEN clicks > 0 THEN 1 ELSE 0 END + CASE WHEN signups > 0 THEN 1 ELSE 0 END)::INT AS diversity,
    {rd(f"-({_share('spend')} + {_share('clicks')} + {_share('signups')})", "entropy")},
    {rd("coalesce(spend, 0) / (coalesce(clicks, 0) + coalesce(signups, 0) + 1)", "balance")} FROM y""",
)
def _(spark, sf):
    cols = ["spend", "clicks", "signups"]
    rows = panel(spark, sf).select(
        "id", "date", *[F.lag(c).over(windows.by_id()).alias(c) for c in cols]
    )
    x = [F.col(c) for c in cols]
    return rounded(
        rows.select(
            "id",
            "date",
            scalar.positive_count(x).alias("diversity"),
            scalar.entropy(x).alias("entropy"),
            scalar.balance(x[:1], x[1:]).alias("balance"),
        )
    )


@query(
    "variation",
    f"""WITH {CLEAN} SELECT id, date,
    {rd(f"CASE WHEN abs(avg(mood) OVER {F7}) > 0.001 THEN stddev_samp(mood) OVER {F7} / abs(avg(mood) OVER {F7}) ELSE 0 END", "mood_variation")} FROM clean""",
)
def _(spark, sf):
    rows = cleaned(spark, sf)
    frame = windows.before(7)
    return rounded(
        rows.select(
            "id",
            "date",
            scalar.variation(F.avg("mood").over(frame), F.stddev_samp("mood").over(frame)).alias(
                "mood_variation"
            ),
        )
    )


@query(
    "log_then_roll",
    f"""WITH {CLEAN}, g AS (SELECT id, date, ln(1 + spend) AS spend FROM clean)
    SELECT id, date, {rd(f"avg(spend) OVER {F7}", "spend_mean")} FROM g""",
)
def _(spark, sf):
    x = F.col("spend")
    rows = cleaned(spark, sf).select(
        "id", "date", keep_missing(x, F.log1p(F.greatest(x, F.lit(0.0)))).alias("spend")
    )
    return rounded(
        rows.select("id", "date", F.avg("spend").over(windows.before(7)).alias("spend_mean"))
    )


@query(
    "hour_profile",
    f"""WITH {M} SELECT hour(time)::INT AS hour, min(strftime(time, '%H:%M')) AS first_seen, count(*) AS n, {rd("avg(value)", "mean_value")}
    FROM m WHERE variable = 'view' GROUP BY 1""",
)
def _(spark, sf):
    rows = measurements(spark, sf).filter(F.col("variable") == "view")
    return rounded(
        rows.groupBy(F.hour("time").alias("hour")).agg(
            F.min(F.date_format("time", "HH:mm")).alias("first_seen"),
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean_value"),
        )
    )


