"""Linear models over many splits: windows, held-out ids, penalties, resampled tables.

Rows with two columns have SQL that solves the normal equations; the same operators over all
features of the instance table are held against plain solvers in the tests.
"""

from __future__ import annotations

from panelrank.operators import linear, splits
from panelrank.queries.models import _closed_form_rows, lean_instances
from panelrank.queries.panel import FILLED, interpolated
from panelrank.queries.ranking import sql_bucket
from panelrank.queries.registry import query, rd, rds, rounded
from panelrank.queries.reports import DRAWS, drawn_sql

_ROWED = f"""{FILLED}, rowed AS (SELECT id, date, mood AS y, coalesce(strain, 0) AS x,
  coalesce(spend, 0) AS w FROM filled WHERE mood IS NOT NULL)"""
_MOMENTS = """count(*) AS n_train, avg(x) AS mx, avg(w) AS mw, avg(y) AS my, var_pop(x) AS xx, var_pop(w) AS ww,
  covar_pop(x, w) AS xw, covar_pop(x, y) AS xy, covar_pop(w, y) AS wy"""
_BETA = "(xy * ww - wy * xw) / (xx * ww - xw * xw) AS bx, (wy * xx - xy * xw) / (xx * ww - xw * xw) AS bw"
_ERRORS = """count(*) AS n_test, avg((y - my - bx * (x - mx) - bw * (w - mw)) ** 2) AS mse,
  var_pop(y) AS spread, avg((y - my) ** 2) AS baseline_mse"""
_SCORES = f"{rd('mse')}, {rd('CASE WHEN spread > 1e-12 THEN 1 - mse / spread END', 'r2')}, {rd('baseline_mse')}"
_PAIR = ["strain", "spend"]


def _rows(spark, sf):
    return interpolated(spark, sf).filter("mood IS NOT NULL")


def _windows_sql(length: int, step: int, last: int, least_train: int, least_test: int) -> str:
    start = "floor(a.n * 0.6::DOUBLE)::INT"
    return f"""WITH {_ROWED}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
    FROM (SELECT DISTINCT date FROM rowed)),
  win AS (SELECT ((a.i - {start}) // {step})::INT AS split, a.date AS test_start, b.date AS test_end
    FROM d a JOIN d b ON b.i = least(a.i + {length}, a.n - 1)
    WHERE a.i >= {start} AND a.i < a.n - {last} AND (a.i - {start}) % {step} = 0),
  fit AS (SELECT split, {_MOMENTS} FROM win JOIN rowed ON date < test_start GROUP BY split),
  beta AS (SELECT *, {_BETA} FROM fit),
  scored AS (SELECT split, test_start, test_end, any_value(n_train) AS n_train, {_ERRORS}
    FROM win JOIN beta USING (split) JOIN rowed ON date BETWEEN test_start AND test_end
    GROUP BY split, test_start, test_end),
  kept AS (SELECT * FROM scored WHERE n_train >= {least_train} AND n_test >= {least_test})"""


_KEPT = f"SELECT split, test_start, test_end, n_train, n_test, {_SCORES} FROM kept"
_SUMMARY = f"""SELECT count(*) AS n_splits, {rd("avg(mse)", "mse_mean")}, {rd("stddev_pop(mse)", "mse_std")},
  {rd("avg(1 - mse / spread)", "r2_mean")}, {rd("stddev_pop(1 - mse / spread)", "r2_std")}"""
_FORWARD, _SLIDING = _windows_sql(7, 7, 1, 100, 5), _windows_sql(5, 2, 5, 100, 10)


def _walked(spark, sf):
    rows = _rows(spark, sf)
    return linear.over_windows(rows, splits.walk_forward(rows), _PAIR, "mood")


def _slid(spark, sf):
    rows = _rows(spark, sf)
    return linear.over_windows(rows, splits.sliding_splits(rows, 5, 2), _PAIR, "mood")


@query("walk_forward_errors", f"{_FORWARD} {_KEPT}")
def _(spark, sf):
    return rounded(_walked(spark, sf))


@query("walk_forward_summary", f"{_FORWARD} {_SUMMARY} FROM kept")
def _(spark, sf):
    return rounded(linear.mean_and_spread(_walked(spark, sf)))


@query("sliding_errors", f"{_SLIDING} {_KEPT}")
def _(spark, sf):
    return rounded(_slid(spark, sf))


@query("sliding_summary", f"{_SLIDING} {_SUMMARY} FROM kept")
def _(spark, sf):
    return rounded(linear.mean_and_spread(_slid(spark, sf)))


_HELD_OUT = f"""WITH {_ROWED}, ids AS (SELECT DISTINCT id AS held FROM rowed),
  fit AS (SELECT held, {_MOMENTS} FROM ids JOIN rowed ON id <> held GROUP BY held),
  beta AS (SELECT *, {_BETA} FROM fit),
  scored AS (SELECT held AS id, any_value(n_train) AS n_train, {_ERRORS}
    FROM beta JOIN rowed ON id = held GROUP BY held)"""


@query(
    "leave_one_id_out",
    f"""{_HELD_OUT} SELECT id, n_train, n_test, CASE WHEN n_test >= 3 THEN 2 END AS n_columns,
    {rd("CASE WHEN n_test >= 3 THEN mse END", "mse")}, {rd("CASE WHEN n_test >= 3 AND spread > 1e-12 THEN 1 - mse / spread END", "r2")},
    {rd("CASE WHEN n_test >= 3 THEN baseline_mse END", "baseline_mse")} FROM scored""",
)
def _(spark, sf):
    return rounded(linear.leave_groups_out(_rows(spark, sf), "id", _PAIR, "mood"))


@query("leave_one_id_out_summary", f"{_HELD_OUT} {_SUMMARY} FROM scored WHERE n_test >= 3")
def _(spark, sf):
    return rounded(linear.mean_and_spread(linear.leave_groups_out(_rows(spark, sf), "id", _PAIR, "mood")))


# --- penalties ----------------------------------------------------------------------------

PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0)
_FOLDED = f"{_ROWED}, folded AS (SELECT *, {sql_bucket(5, 'id')} AS fold FROM rowed), folds AS (SELECT DISTINCT fold AS held FROM folded)"
_TRIED = f"(SELECT unnest([{', '.join(f'{p!r}::DOUBLE' for p in PENALTIES)}]) AS penalty)"
_CHOSEN = f"""per AS (SELECT l1_share, penalty, count(*)::INT AS folds, avg(e) AS mse, stddev_pop(e) AS mse_std FROM errs GROUP BY l1_share, penalty)
SELECT l1_share, penalty, folds, {rds("mse mse_std")},
  row_number() OVER (PARTITION BY l1_share ORDER BY round(mse, 12), penalty DESC) = 1 AS chosen FROM per"""


def _folded(spark, sf):
    return splits.group_kfold(_rows(spark, sf), "id", 5)


@query(
    "penalty_path_one_column",
    f"""WITH {_FOLDED}, fit AS (SELECT held, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) / stddev_pop(x) AS c
      FROM folds JOIN folded ON fold <> held GROUP BY held),
    beta AS (SELECT *, sign(c) * greatest(abs(c) - penalty * l1_share, 0) / (1 + penalty * (1 - l1_share)) / sx AS b
      FROM fit, {_TRIED}, (SELECT unnest([0.0::DOUBLE, 0.5, 1.0]) AS l1_share)),
    errs AS (SELECT held, l1_share, penalty, avg((y - my - b * (x - mx)) ** 2) AS e FROM beta JOIN folded ON fold = held GROUP BY ALL),
    {_CHOSEN}""",
)
def _(spark, sf):
    return rounded(
        linear.penalty_path(_folded(spark, sf), ["strain"], "mood", "fold", (0.0, 0.5, 1.0), PENALTIES)
    )


@query(
    "penalty_path_two_columns",
    f"""WITH {_FOLDED}, fit AS (SELECT held, {_MOMENTS} FROM folds JOIN folded ON fold <> held GROUP BY held),
    std AS (SELECT *, xy / sqrt(xx) AS cx, wy / sqrt(ww) AS cw, xw / sqrt(xx * ww) AS r FROM fit),
    beta AS (SELECT *, 0.0::DOUBLE AS l1_share, (cx * (1 + penalty) - r * cw) / ((1 + penalty) ** 2 - r * r) / sqrt(xx) AS bx,
      (cw * (1 + penalty) - r * cx) / ((1 + penalty) ** 2 - r * r) / sqrt(ww) AS bw FROM std, {_TRIED}),
    errs AS (SELECT held, l1_share, penalty, avg((y - my - bx * (x - mx) - bw * (w - mw)) ** 2) AS e
      FROM beta JOIN folded ON fold = held GROUP BY ALL),
    {_CHOSEN}""",
)
def _(spark, sf):
    return rounded(linear.penalty_path(_folded(spark, sf), _PAIR, "mood", "fold", (0.0,), PENALTIES))


_KINDS = {
    "lasso": ((1.0,), PENALTIES),
    "ridge": ((0.0,), PENALTIES),
    "elastic net": ((0.1, 0.3, 0.5, 0.7, 0.9), PENALTIES),
}


@query(
    "penalised_models_one_column",
    f"""WITH {_FOLDED}, early AS (SELECT * FROM folded WHERE date < DATE '2024-01-25'),
    kinds(model, l1_share) AS (VALUES ('lasso', 1.0::DOUBLE), ('ridge', 0.0), ('elastic net', 0.1), ('elastic net', 0.3),
      ('elastic net', 0.5), ('elastic net', 0.7), ('elastic net', 0.9)),
    sets AS (SELECT DISTINCT fold AS held FROM early UNION ALL SELECT -1),
    fit AS (SELECT held, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) / stddev_pop(x) AS c
      FROM sets JOIN early ON fold <> held GROUP BY held),
    beta AS (SELECT *, sign(c) * greatest(abs(c) - penalty * l1_share, 0) / (1 + penalty * (1 - l1_share)) / sx AS b FROM fit, {_TRIED}, kinds),
    errs AS (SELECT model, l1_share, penalty, held, avg((y - my - b * (x - mx)) ** 2) AS e FROM beta JOIN early ON fold = held GROUP BY ALL),
    per AS (SELECT model, l1_share, penalty, avg(e) AS cv_mse FROM errs GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(cv_mse, 12), l1_share, penalty DESC) AS place FROM per) WHERE place = 1),
    scored AS (SELECT model, l1_share, penalty, any_value(cv_mse) AS cv_mse, any_value((b <> 0)::INT) AS n_columns,
      avg((y - my - b * (x - mx)) ** 2) AS mse, var_pop(y) AS spread, avg((y - my) ** 2) AS baseline_mse
      FROM best JOIN beta USING (model, l1_share, penalty), folded WHERE held = -1 AND date >= DATE '2024-01-25' GROUP BY ALL)
    SELECT model, l1_share, penalty, {rd("cv_mse")}, n_columns, {_SCORES} FROM scored""",
)
def _(spark, sf):
    train, test = _closed_form_rows(spark, sf)
    train = splits.group_kfold(train, "id", 5)
    return rounded(linear.penalised_models(train, test, ["strain"], "mood", "fold", _KINDS))


# --- bootstrap ----------------------------------------------------------------------------

_NUMBER, _WEIGHT = drawn_sql(["id", "date"])
_DRAWN = f"""{_ROWED}, {DRAWS}, drawn AS (SELECT x, w, y, replicate, {_WEIGHT} AS n
  FROM (SELECT *, {_NUMBER} AS number FROM rowed), draw_pairs, draw_cuts),
sums AS (SELECT replicate, sum(n)::BIGINT AS n_in, sum(n * x) / sum(n) AS mx, sum(n * w) / sum(n) AS mw, sum(n * y) / sum(n) AS my
  FROM drawn GROUP BY replicate),
fit AS (SELECT replicate, any_value(n_in) AS n_in, any_value(mx) AS mx, any_value(mw) AS mw, any_value(my) AS my,
  sum(n * (x - mx) ** 2) AS xx, sum(n * (w - mw) ** 2) AS ww, sum(n * (x - mx) * (w - mw)) AS xw,
  sum(n * (x - mx) * (y - my)) AS xy, sum(n * (w - mw) * (y - my)) AS wy FROM drawn JOIN sums USING (replicate) GROUP BY replicate),
beta AS (SELECT *, {_BETA} FROM fit),
scored AS (SELECT replicate, any_value(n_in) AS n_in, count(*) FILTER (n = 0) AS n_out,
  sum(n * (y - my - bx * (x - mx) - bw * (w - mw)) ** 2) / any_value(n_in) AS mse_in,
  avg((y - my - bx * (x - mx) - bw * (w - mw)) ** 2) FILTER (n = 0) AS mse, var_pop(y) FILTER (n = 0) AS spread,
  avg((y - my) ** 2) FILTER (n = 0) AS baseline_mse FROM drawn JOIN beta USING (replicate) GROUP BY replicate)"""


def _resampled(spark, sf):
    rows = _rows(spark, sf)
    return rows, linear.out_of_bag(rows, _PAIR, "mood", ["id", "date"])


@query(
    "out_of_bag_refits",
    f"""WITH RECURSIVE {_DRAWN} SELECT replicate, n_in, n_out, {rd('mse_in', digits=4)}, {rd('mse', digits=4)},
    {rd('CASE WHEN spread > 1e-12 THEN 1 - mse / spread END', 'r2', 4)}, {rd('baseline_mse', digits=4)} FROM scored""",
)
def _(spark, sf):
    return rounded(_resampled(spark, sf)[1], 4)


@query(
    "estimate_632_refits",
    f"""WITH RECURSIVE {_DRAWN}, whole AS (SELECT {_MOMENTS} FROM rowed), wb AS (SELECT *, {_BETA} FROM whole),
    own AS (SELECT {_ERRORS} FROM rowed, wb), oob AS (SELECT count(mse) AS replicates, avg(mse) AS mse_oob, avg(1 - mse / spread) AS r2_oob FROM scored)
    SELECT replicates, {rd("mse", "mse_train")}, {rd("mse_oob")}, {rd("0.368::DOUBLE * mse + 0.632::DOUBLE * mse_oob", "mse_632")},
    {rd("1 - mse / spread", "r2_train")}, {rd("r2_oob")}, {rd("0.368::DOUBLE * (1 - mse / spread) + 0.632::DOUBLE * r2_oob", "r2_632")} FROM own, oob""",
)
def _(spark, sf):
    rows, found = _resampled(spark, sf)
    return rounded(linear.estimate_632(rows, found, _PAIR, "mood"))


# --- all features -------------------------------------------------------------------------


@query("walk_forward_models")
def _(spark, sf):
    rows, cols = lean_instances(spark, sf)
    rows = rows.drop("part")
    return rounded(linear.over_windows(rows, splits.walk_forward(rows), cols, "target"), 4)


@query("leave_one_id_out_models")
def _(spark, sf):
    rows, cols = lean_instances(spark, sf)
    return rounded(
        linear.leave_groups_out(rows, "id", cols, "target", strongest=15, shrink=(0.5, 0.5)), 4
    )


@query("penalised_models")
def _(spark, sf):
    rows, cols = lean_instances(spark, sf)
    rows = splits.group_kfold(rows, "id", 5)
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    grids = {k: (shares, None if k != "ridge" else PENALTIES) for k, (shares, _) in _KINDS.items()}
    return rounded(linear.penalised_models(train, test, cols, "target", "fold", grids), 4)


@query("out_of_bag_models")
def _(spark, sf):
    rows, cols = lean_instances(spark, sf)
    return rounded(linear.out_of_bag(rows, cols, "target", ["id", "date"]), 4)
