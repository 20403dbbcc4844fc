"""Splits, evaluation reports and tests on the panel and on a prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrank.operators import groups, metrics, scale, significance, splits
from panelrank.queries.panel import CLEAN, cleaned, measurements
from panelrank.queries.ranking import sql_bucket, sql_uniform
from panelrank.queries.registry import query, rd, rds, rounded
from panelrank.sources.tables import table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def predictions(spark, sf):
    """Quantity as truth with two linear guesses; orders split 80/10/10."""
    rows = table(spark, sf, "lineitem").select(
        *KEY,
        F.col("l_quantity").alias("y"),
        (25 + 0.5 * (F.col("l_quantity") - 25) + 10 * (F.col("l_discount") - 0.05)).alias("a"),
        (25 + 0.3 * (F.col("l_quantity") - 25) + 100 * (F.col("l_tax") - 0.04)).alias("b"),
    )
    return splits.split_groups(scale.spread(rows, "l_orderkey"), "l_orderkey")


def classified(spark, sf):
    """Classes by training terciles for the truth and both guesses."""
    rows = predictions(spark, sf)
    cuts = groups.class_cuts(rows.filter(F.col("part") == "train"), "y")
    return rows.withColumns(
        {f"{c}_class": groups.cut_class(F.col(c), cuts) for c in ("y", "a", "b")}
    )


PRED = f"""pred AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS y,
  25 + 0.5::DOUBLE * (l_quantity - 25) + 10 * (l_discount - 0.05::DOUBLE) AS a, 25 + 0.3::DOUBLE * (l_quantity - 25) + 100 * (l_tax - 0.04::DOUBLE) AS b,
  CASE WHEN {sql_uniform("l_orderkey")} < 0.8 THEN 'train' WHEN {sql_uniform("l_orderkey")} < 0.9 THEN 'val' ELSE 'holdout' END AS part FROM lineitem),
cuts AS (SELECT quantile_cont(y, 0.3333) AS q1, quantile_cont(y, 0.6667) AS q2 FROM pred WHERE part = 'train'),
classed AS (SELECT pred.*, {", ".join(f"((({c} >= q1)::INT + ({c} >= q2)::INT))::INT AS {c}_class" for c in "yab")} FROM pred, cuts)"""


def _scores_sql(source, truth, guess, by=""):
    """CTEs cs (class scores) and cr (accuracy, macro F1)."""
    b = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""cc AS (SELECT {b}{truth} AS t, {guess} AS p, count(*) AS n FROM {source} GROUP BY {b}{truth}, {guess}),
sides AS (SELECT {b}t AS label, n AS a, 0 AS p, CASE WHEN t = p THEN n ELSE 0 END AS h FROM cc UNION ALL SELECT {b}p, 0, n, 0 FROM cc),
cs AS (SELECT {b}label, sum(a)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits, coalesce(sum(h) / nullif(sum(p), 0), 0) AS "precision",
  coalesce(sum(h) / nullif(sum(a), 0), 0) AS recall, coalesce(2.0 * sum(h) / nullif(sum(a) + sum(p), 0), 0) AS f1 FROM sides GROUP BY {b}label),
cr AS (SELECT {b}sum(support)::BIGINT AS n, sum(hits) / sum(support) AS accuracy, avg(f1) AS f1_macro FROM cs {group})"""


_REG = """count(*) AS n, avg(({y} - {p}) ** 2) AS mse, sqrt(avg(({y} - {p}) ** 2)) AS rmse, avg(abs({y} - {p})) AS mae,
CASE WHEN var_pop({y}) > 1e-9 THEN 1 - avg(({y} - {p}) ** 2) / var_pop({y}) END AS r2"""


# --- splits -------------------------------------------------------------------------------

_DAYS = f"""{CLEAN}, days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM clean))"""


@query(
    "split_by_date",
    f"""WITH {_DAYS} SELECT id, clean.date, CASE WHEN clean.date < (SELECT date FROM days WHERE i = floor(n * (1 - 0.2::DOUBLE))) THEN 'train' ELSE 'test' END AS part FROM clean""",
)
def _(spark, sf):
    return splits.split_by_date(cleaned(spark, sf).select("id", "date"))


@query(
    "split_leave_groups_out",
    f"""WITH {CLEAN}, held AS (SELECT id FROM (SELECT DISTINCT id FROM clean) ORDER BY md5(concat_ws('-', id::VARCHAR, '42')) LIMIT 5)
    SELECT id, date, CASE WHEN id IN (SELECT id FROM held) THEN 'test' ELSE 'train' END AS part FROM clean""",
)
def _(spark, sf):
    return splits.split_leave_groups_out(cleaned(spark, sf).select("id", "date"), "id")


@query(
    "split_per_id",
    f"""WITH {CLEAN} SELECT id, date, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY date) <= floor(count(*) OVER (PARTITION BY id) * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM clean""",
)
def _(spark, sf):
    return splits.split_per_id(cleaned(spark, sf).select("id", "date"))


@query(
    "leave_one_group_out",
    f"WITH {CLEAN} SELECT id, date, id AS fold FROM clean",
)
def _(spark, sf):
    return splits.leave_one_group_out(cleaned(spark, sf).select("id", "date"), "id")


def _windows_sql(step, length, last, least_train, least_test):
    return f"""WITH {_DAYS}, w AS (SELECT ((a.i - floor(a.n * 0.6::DOUBLE)) / {step})::INT AS split, a.date AS test_start, b.date AS test_end FROM days a
      JOIN days b ON b.i = least(a.i + {length}, a.n - 1) WHERE a.i >= floor(a.n * 0.6::DOUBLE) AND (a.i - floor(a.n * 0.6::DOUBLE)) % {step} = 0 AND a.i < a.n - {last}),
    d AS (SELECT date, count(*) AS n FROM clean GROUP BY date)
    SELECT split, test_start, test_end, sum(CASE WHEN date < test_start THEN n ELSE 0 END)::BIGINT AS n_train, sum(CASE WHEN date >= test_start THEN n ELSE 0 END)::BIGINT AS n_test
    FROM w JOIN d ON date <= test_end GROUP BY ALL HAVING n_train >= {least_train} AND n_test >= {least_test}"""


@query("sliding_splits", _windows_sql(2, 5, 5, 100, 10))
def _(spark, sf):
    return splits.sliding_splits(cleaned(spark, sf), window_days=5, step_days=2)


@query("walk_forward", _windows_sql(7, 7, 1, 100, 5))
def _(spark, sf):
    return splits.walk_forward(cleaned(spark, sf))


@query(
    "balanced_kfold",
    f"""WITH RECURSIVE sizes AS (SELECT user_id AS id, count(*)::BIGINT AS n, md5(concat_ws('-', user_id::VARCHAR, '42'))[1:8] AS code FROM events GROUP BY user_id),
    queue AS (SELECT *, row_number() OVER (ORDER BY n DESC, code, id) AS i, row_number() OVER (PARTITION BY n ORDER BY code, id) AS place FROM sizes),
    step(i, n, fold, loads) AS (
      SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[]
      UNION ALL SELECT q.i, q.n, list_position(loads, list_min(loads))::BIGINT - 1,
        list_transform(loads, lambda l, p: CASE WHEN p = list_position(loads, list_min(loads)) THEN l + q.n ELSE l END) FROM step JOIN queue q ON q.i = step.i + 1),
    ends AS (SELECT n, fold, sum(count(*)) OVER (PARTITION BY n ORDER BY fold) AS upto FROM step WHERE i > 0 GROUP BY n, fold)
    SELECT events.user_id AS id, ts AS time, (SELECT min(fold) FROM ends WHERE ends.n = queue.n AND place <= upto)::INT AS fold FROM events JOIN queue ON id = user_id""",
)
def _(spark, sf):
    rows = measurements(spark, sf).select("id", "time")
    return splits.balanced_kfold(rows, "id", 5)


@query(
    "stratified_holdout",
    f"""WITH {CLEAN}, s AS (SELECT id, row_number() OVER (ORDER BY avg(mood), id) AS rn FROM clean GROUP BY id HAVING avg(mood) IS NOT NULL),
    held AS (SELECT id FROM s WHERE rn % 5 = 3 AND rn <= 23)
    SELECT id, date, CASE WHEN id IN (SELECT id FROM held) THEN 'test' ELSE 'train' END AS part FROM clean""",
)
def _(spark, sf):
    rows = cleaned(spark, sf).select("id", "date", "mood")
    return splits.stratified_holdout(rows, "id", "mood").drop("mood")


@query(
    "time_series_folds",
    f"""WITH {_DAYS}, c AS (SELECT (i - (n - 5 * (n // 6))) AS p, (n // 6) AS size, date FROM days)
    SELECT id, clean.date, (CASE WHEN p < 0 THEN 0 ELSE least(p // size + 1, 5) END)::INT AS block FROM clean JOIN c ON clean.date = c.date""",
)
def _(spark, sf):
    return splits.time_series_folds(cleaned(spark, sf).select("id", "date"))


@query(
    "tail_validation",
    f"""WITH {CLEAN}, r AS (SELECT id, date, row_number() OVER (ORDER BY id, date) - 1 AS i, count(*) OVER () AS n FROM clean)
    SELECT id, date, CASE WHEN i < floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'validation' END AS part FROM r""",
)
def _(spark, sf):
    return splits.tail_validation(cleaned(spark, sf).select("id", "date"), ["id", "date"])


# --- class cuts and reports ---------------------------------------------------------------


@query(
    "terciles",
    f"""WITH {PRED} SELECT part, y_class, count(*) AS n FROM classed GROUP BY part, y_class""",
)
def _(spark, sf):
    return classified(spark, sf).groupBy("part", "y_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "quintiles_and_median",
    f"""WITH {PRED}, q AS (SELECT quantile_cont(y, [0.2, 0.4, 0.6, 0.8, 0.5]) AS q FROM pred WHERE part = 'train')
    SELECT ((y >= q[1])::INT + (y >= q[2])::INT + (y >= q[3])::INT + (y >= q[4])::INT)::INT AS quintile, (y >= q[5])::INT AS upper_half, count(*) AS n FROM pred, q GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = predictions(spark, sf)
    train = rows.filter(F.col("part") == "train")
    cuts = groups.class_cuts(train, "y", [*groups.QUINTILES, *groups.MEDIAN])
    y = F.col("y")
    return rows.groupBy(
        groups.cut_class(y, cuts[:4]).alias("quintile"),
        groups.cut_class(y, cuts[4:]).alias("upper_half"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "confusion_counts",
    f"WITH {PRED} SELECT y_class AS truth, a_class AS pred, count(*) AS n FROM classed WHERE part = 'holdout' GROUP BY 1, 2",
)
def _(spark, sf):
    rows = classified(spark, sf).filter(F.col("part") == "holdout")
    return metrics.confusion_counts(rows, "y_class", "a_class")


@query(
    "class_scores",
    f"""WITH {PRED}, {_scores_sql("classed", "y_class", "a_class")} SELECT label, support, predicted, hits, {rd('"precision"')}, {rds("recall f1")} FROM cs""",
)
def _(spark, sf):
    counts = metrics.confusion_counts(classified(spark, sf), "y_class", "a_class")
    return rounded(metrics.class_scores(counts))


@query(
    "classification_report",
    f"WITH {PRED}, {_scores_sql('classed', 'y_class', 'a_class', 'part')} SELECT part, n, {rds('accuracy f1_macro')} FROM cr",
)
def _(spark, sf):
    counts = metrics.confusion_counts(classified(spark, sf), "y_class", "a_class", by=["part"])
    return rounded(metrics.classification_report(counts, by=["part"]))


@query(
    "regression_report",
    f"WITH {PRED}, r AS (SELECT part, {_REG.format(y='y', p='a')} FROM pred GROUP BY part) SELECT part, n, {rds('mse rmse mae r2')} FROM r",
)
def _(spark, sf):
    rows = predictions(spark, sf)
    return rounded(metrics.regression_report(rows, F.col("y"), F.col("a"), by=["part"]))


@query(
    "baselines",
    f"""WITH {PRED}, major AS (SELECT y_class AS c FROM classed WHERE part = 'train' GROUP BY y_class ORDER BY count(*) DESC, y_class LIMIT 1),
    mean AS (SELECT avg(y) AS m FROM pred WHERE part = 'train'), t AS (SELECT y, y_class, c, m FROM classed, major, mean WHERE part = 'holdout'),
    {_scores_sql("t", "y_class", "c")}, r AS (SELECT {_REG.format(y="y", p="m")} FROM t)
    SELECT cr.n, {rds("accuracy f1_macro mse rmse mae r2")} FROM cr, r""",
)
def _(spark, sf):
    rows = predictions(spark, sf)
    train = rows.filter(F.col("part") == "train")
    cuts = groups.class_cuts(train, "y")
    return rounded(metrics.baselines(train, rows.filter(F.col("part") == "holdout"), "y", cuts))


@query(
    "per_group_report",
    f"""WITH {PRED}, {_scores_sql("classed", "y_class", "a_class", "l_suppkey")},
    r AS (SELECT l_suppkey, {_REG.format(y="y", p="a")}, avg(y) AS mean, stddev_pop(y) AS std FROM classed GROUP BY l_suppkey)
    SELECT l_suppkey, r.n, {rds("mse rmse mae r2 accuracy f1_macro mean std")} FROM r JOIN cr USING (l_suppkey)""",
)
def _(spark, sf):
    return rounded(
        metrics.per_group_report(
            classified(spark, sf), "l_suppkey", "y", "a", "y_class", "a_class"
        )
    )


@query(
    "residual_stats",
    f"""WITH {PRED}, e AS (SELECT y - a AS e FROM pred WHERE part = 'holdout'), m AS (SELECT count(*) AS n, avg(e) AS mu, stddev_pop(e) AS sd FROM e)
    SELECT count(*) AS n, {rd("avg(e)", "mean")}, {rd("quantile_cont(e, 0.5)", "median")}, {rd("stddev_pop(e)", "std")}, {rd("avg(((e - mu) / sd) ** 3)", "skew")},
    {rd("kurtosis_pop(e)", "kurtosis")}, {rd("max(abs(e))", "max_abs")}, {rd("avg((abs(e) <= 0.5)::INT)", "within_half")}, {rd("avg((abs(e) <= 1)::INT)", "within_one")},
    count(*) FILTER (abs(e) > 1) AS beyond_one FROM e, m""",
)
def _(spark, sf):
    rows = predictions(spark, sf).filter(F.col("part") == "holdout")
    return rounded(metrics.residual_stats(rows, "y", "a"))


@query(
    "prediction_diff",
    f"""WITH {PRED} SELECT {rd("avg(abs(a - b))", "mean_diff")}, {rd("max(abs(a - b))", "max_diff")}, {rd("corr(a, b)", "corr")} FROM pred""",
)
def _(spark, sf):
    return rounded(metrics.prediction_diff(predictions(spark, sf), "a", "b"))


@query(
    "hardest_share",
    f"""WITH {PRED}, h AS (SELECT *, row_number() OVER (ORDER BY abs(y - a) DESC, {", ".join(KEY)}) <= greatest(1, floor((SELECT count(*) FROM pred) * 0.1::DOUBLE)) AS hard FROM pred)
    SELECT hard, count(*) AS n, {rd("avg((y - a) ** 2)", "mse_first")}, {rd("avg((y - b) ** 2)", "mse_second")} FROM h GROUP BY hard""",
)
def _(spark, sf):
    return rounded(metrics.hardest_share(predictions(spark, sf), "y", "a", "b", KEY))


_SWEEP_PAIRS = ", ".join(
    f"({lo}, {hi})" for lo in (25, 30, 33, 35, 40) for hi in (60, 65, 67, 70, 75)
)


@query(
    "threshold_sweep",
    f"""WITH {PRED}, pc(low, high) AS (VALUES {_SWEEP_PAIRS}),
    qs AS (SELECT p, CASE p {" ".join(f"WHEN {p} THEN (SELECT quantile_cont(y, {p / 100!r}) FROM pred WHERE part = 'train')" for p in (25, 30, 33, 35, 40, 60, 65, 67, 70, 75))} END AS cut
      FROM (SELECT unnest([25, 30, 33, 35, 40, 60, 65, 67, 70, 75]) AS p)),
    pairs AS (SELECT low::DOUBLE AS low, high::DOUBLE AS high, l.cut AS cut_low, h.cut AS cut_high FROM pc JOIN qs l ON l.p = low JOIN qs h ON h.p = high),
    x AS (SELECT low, high, cut_low, cut_high, (y >= cut_low)::INT + (y >= cut_high)::INT AS t, (a >= cut_low)::INT + (a >= cut_high)::INT AS p FROM pred, pairs WHERE part = 'holdout'),
    {_scores_sql("x", "t", "p", "low, high, cut_low, cut_high")} SELECT low, high, {rds("cut_low cut_high accuracy f1_macro")} FROM cr""",
)
def _(spark, sf):
    rows = predictions(spark, sf)
    return rounded(
        metrics.threshold_sweep(
            rows.filter(F.col("part") == "holdout"), rows.filter(F.col("part") == "train"), "y", "a"
        )
    )


@query(
    "summary_mean_std",
    f"""WITH {PRED}, r AS (SELECT part, {_REG.format(y="y", p="a")} FROM pred GROUP BY part)
    SELECT {rd("avg(mae)", "mae_mean")}, {rd("avg(r2)", "r2_mean")}, {rd("stddev_pop(mae)", "mae_std")}, {rd("stddev_pop(r2)", "r2_std")} FROM r""",
)
def _(spark, sf):
    report = metrics.regression_report(
        predictions(spark, sf), F.col("y"), F.col("a"), by=["part"]
    )
    return rounded(metrics.summary_mean_std(report, ["mae", "r2"]))


@query(
    "seed_summary",
    f"""WITH {PRED}, f AS (SELECT *, {sql_bucket(5, "l_orderkey", seed=3)} AS fold FROM pred), r AS (SELECT fold, {_REG.format(y="y", p="(a + b) / 2")} FROM f GROUP BY fold)
    SELECT {rd("avg(mae)", "mae_mean")}, {rd("avg(r2)", "r2_mean")}, {rd("stddev_samp(mae)", "mae_std")}, {rd("stddev_samp(r2)", "r2_std")} FROM r""",
)
def _(spark, sf):
    rows = splits.group_kfold(predictions(spark, sf), "l_orderkey", 5, seed=3)
    report = metrics.regression_report(
        rows, F.col("y"), metrics.row_mean(["a", "b"]), by=["fold"]
    )
    return rounded(metrics.seed_summary(report, ["mae", "r2"]))


# --- tests and intervals ------------------------------------------------------------------


def _steps(n: int) -> str:
    """Weights of Simpson's rule: 1, 4, 2, 4, ..., 4, 1."""
    return f"CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def erfc_sql(z: str) -> str:
    """Complementary error function: the integral of the bell curve from z on, by Simpson's rule."""
    terms = f"[({_steps(2000)}) * exp(-1 * pow(({z}) + i * 0.005::DOUBLE, 2)) FOR i IN range(0, 2001)]"
    return f"(2 / sqrt(pi()) * 0.005::DOUBLE / 3 * list_sum({terms}))"


_EXACT = """least(1.0::DOUBLE, 2 * list_sum([exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1)
  - (only_a + only_b) * ln(2.0::DOUBLE)) FOR i IN range(0, least(only_a, only_b) + 1)]))"""


@query(
    "mcnemar",
    f"""WITH {PRED}, c AS (SELECT count(*) FILTER (a_class = y_class AND b_class = y_class) AS both, count(*) FILTER (a_class = y_class AND b_class <> y_class) AS only_a,
      count(*) FILTER (a_class <> y_class AND b_class = y_class) AS only_b, count(*) FILTER (a_class <> y_class AND b_class <> y_class) AS neither FROM classed WHERE part = 'holdout')
    SELECT "both", only_a, only_b, neither, {rd("chi2")}, {rd(erfc_sql("sqrt(chi2 / 2)"), "p_value")}, {rd(_EXACT, "p_exact")}
    FROM (SELECT *, coalesce((only_a - only_b) ** 2 / nullif(only_a + only_b, 0), 0) AS chi2 FROM c)""",
)
def _(spark, sf):
    rows = classified(spark, sf).filter(F.col("part") == "holdout")
    tested = significance.mcnemar(rows, "y_class", "a_class", "b_class")
    return rounded(tested)


@query(
    "wilcoxon",
    f"""WITH {PRED}, d AS (SELECT round(abs(y - a) - abs(y - b), 12) AS d FROM pred WHERE part = 'holdout'), nz AS (SELECT d, abs(d) AS s FROM d WHERE d <> 0),
    r AS (SELECT d, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY s) AS t FROM nz),
    g AS (SELECT count(*) AS pairs, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus, sum((t * t - 1))::DOUBLE AS ties FROM r)
    SELECT pairs, {rd("w_plus", digits=2)}, {rd("w_minus", digits=2)},
    {rd("(least(w_plus, w_minus) - pairs::DOUBLE * (pairs + 1) / 4) / sqrt(pairs::DOUBLE * (pairs + 1) * (2 * pairs + 1) / 24 - ties / 48)", "z", 2)},
    {rd(erfc_sql("abs(least(w_plus, w_minus) - pairs::DOUBLE * (pairs + 1) / 4) / sqrt(pairs::DOUBLE * (pairs + 1) * (2 * pairs + 1) / 24 - ties / 48) / sqrt(2.0::DOUBLE)"), "p_value", 2)} FROM g""",
)
def _(spark, sf):
    rows = predictions(spark, sf).filter(F.col("part") == "holdout")
    errors = rows.select(
        F.abs(F.col("y") - F.col("a")).alias("ea"), F.abs(F.col("y") - F.col("b")).alias("eb")
    )
    return rounded(significance.wilcoxon_signed_rank(errors, "ea", "eb"), 2)


# The SQL draws its own pairs, numbers and weights, and sums the distribution up by itself.
_PRIME = 2**31 - 1
DRAWS = f"""po(k, term, below) AS (SELECT 0, exp(-1.0::DOUBLE), exp(-1.0::DOUBLE)
  UNION ALL SELECT k + 1, term / (k + 1), below + term / (k + 1) FROM po WHERE below * {_PRIME} < {_PRIME - 1} AND term > 1e-18),
draw_cuts AS (SELECT list(below * {_PRIME}) AS levels FROM po WHERE below * {_PRIME} < {_PRIME - 1}),
draw_pairs AS (SELECT r AS replicate, 1 + ('0x' || md5('a-' || r || '-42')[1:8])::BIGINT % {_PRIME - 1} AS a,
  ('0x' || md5('b-' || r || '-42')[1:8])::BIGINT % {_PRIME} AS b FROM (SELECT unnest(range(0, 200))::INT AS r))"""


def drawn_sql(key, number="number"):
    """Columns ``number`` of a row and its weight in a replicate (with ``draw_pairs`` and ``draw_cuts``)."""
    named = ", ".join(f"{c}::VARCHAR" for c in key)
    return (
        f"('0x' || md5(concat_ws('-', {named}, '42'))[1:8])::BIGINT % {_PRIME}",
        f"len(list_filter(levels, lambda c: ({number} * draw_pairs.a + draw_pairs.b) % {_PRIME} >= c))",
    )


_NUMBER, _WEIGHT = drawn_sql(KEY)
_BOOT = f"""{PRED}, {DRAWS}, drawn AS (SELECT numbered.*, replicate, {_WEIGHT} AS w
  FROM (SELECT *, {_NUMBER} AS number FROM classed WHERE part = 'holdout') numbered, draw_pairs, draw_cuts),
bc AS (SELECT replicate, y_class AS t, a_class AS p, sum(w) AS n FROM drawn WHERE w > 0 GROUP BY ALL),
bs AS (SELECT replicate, t AS label, n AS a, 0 AS p, CASE WHEN t = p THEN n ELSE 0 END AS h FROM bc UNION ALL SELECT replicate, p, 0, n, 0 FROM bc),
bl AS (SELECT replicate, label, sum(a) AS a, sum(h) AS h, 2.0 * sum(h) / nullif(sum(a) + sum(p), 0) AS f1 FROM bs GROUP BY ALL),
br AS (SELECT replicate, sum(w * (y - a) ** 2) AS sse, sum(w * y * y) - sum(w * y) ** 2 / sum(w) AS tot FROM drawn WHERE w > 0 GROUP BY replicate),
boot AS (SELECT replicate, sum(h) / sum(a) AS accuracy, avg(coalesce(f1, 0)) AS f1_macro FROM bl GROUP BY replicate),
reports AS (SELECT replicate, accuracy, f1_macro, 1 - sse / tot AS r2 FROM boot JOIN br USING (replicate))"""


def _bootstrap(spark, sf):
    rows = classified(spark, sf).filter(F.col("part") == "holdout")
    return significance.bootstrap_reports(rows, KEY, "y", "a", "y_class", "a_class")


@query(
    "bootstrap_reports",
    f"WITH RECURSIVE {_BOOT} SELECT replicate, {rds('accuracy f1_macro r2')} FROM reports",
)
def _(spark, sf):
    return rounded(_bootstrap(spark, sf))


@query(
    "bootstrap_ci",
    f"WITH RECURSIVE {_BOOT} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {rd(f'avg({m})', 'mean')}, {rd(f'quantile_cont({m}, 0.025)', 'lower')}, {rd(f'quantile_cont({m}, 0.975)', 'upper')} FROM reports"
        for m in ("f1_macro", "accuracy", "r2")
    ),
)
def _(spark, sf):
    return rounded(significance.bootstrap_ci(_bootstrap(spark, sf)))


@query(
    "accuracy_normal_ci",
    f"""WITH {PRED}, c AS (SELECT count(*) AS n, avg((y_class = a_class)::INT) AS accuracy FROM classed WHERE part = 'holdout')
    SELECT n, {rd("accuracy")}, {rd("accuracy - 1.96 * sqrt(accuracy * (1 - accuracy) / n)", "lower")}, {rd("accuracy + 1.96 * sqrt(accuracy * (1 - accuracy) / n)", "upper")} FROM c""",
)
def _(spark, sf):
    rows = classified(spark, sf).filter(F.col("part") == "holdout")
    return rounded(significance.accuracy_normal_ci(rows, "y_class", "a_class"))


@query(
    "estimate_632",
    f"""WITH {PRED}, r AS (SELECT part, {_REG.format(y="y", p="a")} FROM pred GROUP BY part)
    SELECT """
    + ", ".join(
        rd(
            f"0.368::DOUBLE * (SELECT {m} FROM r WHERE part = 'train') + 0.632::DOUBLE * (SELECT {m} FROM r WHERE part = 'holdout')",
            m,
        )
        for m in ("mae", "r2")
    ),
)
def _(spark, sf):
    rows = predictions(spark, sf)
    parts = [
        metrics.regression_report(rows.filter(F.col("part") == p), F.col("y"), F.col("a"))
        for p in ("train", "holdout")
    ]
    return rounded(significance.estimate_632(parts[0], parts[1], ["mae", "r2"]))
