"""Queries over panels of users' days: within fits of many regimes and patterns of missing values, and what the screening makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.operators import boosting, screening, within
from assaygrid.plans.registry import query
from assaygrid.plans.tabular import DAILY, daily, r6

_PANEL = DAILY + ", panel AS (SELECT user_id, CAST(user_id % 3 AS VARCHAR) AS regime, day, c1, CASE WHEN day % 5 <> 0 THEN c2 END AS c2, c3, total FROM daily)"
_SPECS = [("c2", "total"), ("day", "total"), ("day", "c1"), ("c3", "c2")]


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days in three regimes, c2 missing on every fifth day."""
    d = daily(spark, sf_dir)
    return d.select("user_id", (F.col("user_id") % 3).cast("string").alias("regime"), "day", "c1", F.when(F.col("day") % 5 != 0, F.col("c2")).alias("c2"), "c3", "total", (F.col("user_id") * 1_000_000 + F.col("day").cast("long")).alias("row_id"))


def _fit_sql(x: str, y: str) -> str:
    return f"""SELECT regime, '{y}' AS outcome, '{x}' AS input, n, g AS n_entities, least_obs, most_obs, round(b, 6) + 0.0 AS slope, round(sqrt(meat * g / (g - 1.0)) / xx, 6) + 0.0 AS clustered_se, round(b * b * xx / yy, 6) + 0.0 AS within_r2,
  round(1 - off / spread, 5) + 0.0 AS between_r2, round(1 - far / all_y, 5) + 0.0 AS overall_r2, round(sqrt((yy - b * b * xx) / n), 6) + 0.0 AS rmse, round(n * (ln(2 * pi() * (yy - b * b * xx) / n) + 1) + 4, 3) + 0.0 AS aic
FROM (SELECT regime, any_value(n) AS n, any_value(g) AS g, min(size) AS least_obs, max(size) AS most_obs, any_value(b) AS b, any_value(xx) AS xx, any_value(yy) AS yy, sum(u * u) AS meat, sum((ym - my - b * (xm - mx)) ** 2) AS off, any_value(all_y) AS all_y, any_value(far) AS far, regr_syy(ym, ym) AS spread
  FROM (SELECT w.regime, w.user_id, count(*) AS size, sum(xd * (yd - b * xd)) AS u, any_value(xm) AS xm, any_value(ym) AS ym, any_value(s.mx) AS mx, any_value(s.my) AS my, any_value(b) AS b, any_value(xx) AS xx, any_value(yy) AS yy, any_value(n) AS n, any_value(g) AS g, any_value(all_y) AS all_y, any_value(all_y - 2 * b * all_xy + b * b * all_x) AS far
    FROM (SELECT *, x - xm AS xd, y - ym AS yd FROM (SELECT regime, user_id, x, y, avg(x) OVER e AS xm, avg(y) OVER e AS ym FROM (SELECT regime, user_id, {x} AS x, {y} AS y FROM panel WHERE {x} IS NOT NULL AND {y} IS NOT NULL) WINDOW e AS (PARTITION BY regime, user_id))) w
    JOIN (SELECT regime, sum(xd * yd) / sum(xd * xd) AS b, sum(xd * xd) AS xx, sum(yd * yd) AS yy, count(*) AS n, count(DISTINCT user_id) AS g, avg(x) AS mx, avg(y) AS my, regr_syy(y, y) AS all_y, regr_sxx(x, x) AS all_x, regr_sxy(y, x) AS all_xy
      FROM (SELECT regime, user_id, x, y, x - avg(x) OVER e AS xd, y - avg(y) OVER e AS yd FROM (SELECT regime, user_id, {x} AS x, {y} AS y FROM panel WHERE {x} IS NOT NULL AND {y} IS NOT NULL) WINDOW e AS (PARTITION BY regime, user_id)) GROUP BY regime) s USING (regime)
    GROUP BY w.regime, w.user_id) GROUP BY regime)"""


@query(_PANEL + " " + " UNION ALL ".join(_fit_sql(x, y) for x, y in _SPECS))
def within_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve fits of three regimes, with different patterns of missing values, from one aggregate by entity."""
    m = within.entity_moments(user_panel(spark, sf_dir), ["day", "c1", "c2", "c3", "total"], "user_id", "regime")
    specs = [(g, y, [x]) for x, y in _SPECS for g in ("0", "1", "2")]
    rows = [
        (f.regime, f.y, f.x[0], f.n, f.n_entities, f.least_obs, f.most_obs, round(f.coefficients[f.x[0]], 6) + 0.0, round(f.clustered_se[f.x[0]], 6) + 0.0, round(f.within_r2, 6) + 0.0, round(f.between_r2, 5) + 0.0, round(f.overall_r2, 5) + 0.0, round(f.rmse, 6) + 0.0, round(f.aic, 3) + 0.0)
        for f in within.within_fits(m, specs, always=("day", "c2", "c3")).values()
    ]
    return spark.createDataFrame(rows, "regime string, outcome string, input string, n long, n_entities long, least_obs long, most_obs long, slope double, clustered_se double, within_r2 double, between_r2 double, overall_r2 double, rmse double, aic double")


@query(
    _PANEL
    + ", long AS (SELECT regime, user_id, unnest(['c1', 'c2', 'c3', 'day', 'total']) AS name, unnest([c1, c2, c3, day, total]) AS v FROM panel), m AS (SELECT *, avg(v) OVER (PARTITION BY regime, name, user_id) AS em FROM long) "
    + "SELECT regime, name, coalesce(var_samp(v - em) / nullif(var_samp(v), 0), 0) >= 0.05 AS varies_within, round(var_samp(em) / var_samp(v), 4) + 0.0 AS icc FROM m GROUP BY 1, 2"
)
def panel_soundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What varies within users and how much of each column is between them, for every regime at once."""
    names = ["c1", "c2", "c3", "day", "total"]
    parts = within.panel_parts(user_panel(spark, sf_dir), names, names, "user_id", ["day"], "regime")
    return spark.createDataFrame([(g, c, c in p.within, p.icc[c] + 0.0) for g, p in parts.items() for c in names], "regime string, name string, varies_within boolean, icc double")


@query()
def panel_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screening with its panel half, all regimes in the same passes."""
    return screening.screen(user_panel(spark, sf_dir), ["c1", "c2", "c3"], ["total"], "row_id", time="day", regime="regime", entity="user_id").withColumn("score", r6(F.col("score")))


_BOOSTED = ["c1", "c2", "c3", "day"]


@query(
    _PANEL
    + """, base AS (SELECT avg(total) AS m FROM panel WHERE total IS NOT NULL), rows AS (SELECT m - total AS g, c1, c2, c3, day FROM panel, base WHERE total IS NOT NULL),
long AS (SELECT g, unnest([0, 1, 2, 3]) AS f, unnest([c1, c2, c3, day]) AS v FROM rows), sizes AS (SELECT f, count(v) AS n, min(v) AS low FROM long GROUP BY f),
ranked AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS k FROM long WHERE v IS NOT NULL),
cuts AS (SELECT DISTINCT r.f, r.v AS cut FROM ranked r JOIN (SELECT f, low, CAST(floor(CAST(i AS DOUBLE) / 255 * (n - 1)) AS BIGINT) AS k FROM sizes, range(1, 255) t(i)) s ON s.f = r.f AND s.k = r.k AND r.v > s.low),
known AS (SELECT c.f, cut, sum(g) AS a, count(*) AS b FROM cuts c JOIN long l ON l.f = c.f AND l.v < c.cut GROUP BY 1, 2),
missing AS (SELECT f, coalesce(sum(g) FILTER (WHERE v IS NULL), 0) AS mg, count(*) FILTER (WHERE v IS NULL) AS mh, sum(g) AS tg, count(*) AS th FROM long GROUP BY f),
sides AS (SELECT k.f, cut, side, a + side * mg AS a, b + side * mh AS b, tg, th FROM known k JOIN missing USING (f), (SELECT unnest([1, 0]) AS side)),
worth AS (SELECT *, sign(a) * greatest(abs(a) - 0.1, 0) AS sa, sign(tg - a) * greatest(abs(tg - a) - 0.1, 0) AS sb, sign(tg) * greatest(abs(tg) - 0.1, 0) AS st FROM sides WHERE b >= 3 AND th - b >= 3),
gains AS (SELECT *, 0.5 * (sa * sa / (b + 1) + sb * sb / (th - b + 1) - st * st / (th + 1)) AS gain FROM worth)
SELECT ['c1', 'c2', 'c3', 'day'][f + 1] AS input, cut AS threshold, side = 1 AS missing_left, round(gain, 3) + 0.0 AS gain, round(-0.05 * sa / (b + 1), 6) + 0.0 AS left_value, round(-0.05 * sb / (th - b + 1), 6) + 0.0 AS right_value
FROM gains ORDER BY round(gain, 6) DESC, f, cut, side DESC LIMIT 1"""
)
def boosted_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of boosted trees over inputs with gaps: where it cuts, which way missing values go, what it gains."""
    m = boosting.boost(user_panel(spark, sf_dir), "total", _BOOSTED, rounds=1, depth=1, rows=1.0, columns=1.0)
    s, tree = m.trees[0].nodes[0], m.trees[0].nodes
    return spark.createDataFrame([(_BOOSTED[s.feature], s.threshold, s.missing_left, round(s.gain, 3) + 0.0, round(tree[s.left], 6) + 0.0, round(tree[s.right], 6) + 0.0)], "input string, threshold double, missing_left boolean, gain double, left_value double, right_value double")


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees over inputs with gaps, and what each input is worth."""
    m = boosting.boost(user_panel(spark, sf_dir), "total", _BOOSTED)
    return spark.createDataFrame([(m.n, m.r_squared, m.adj_r_squared, m.importances(), m.significant())], "n long, r_squared double, adj_r_squared double, importances map<string,double>, significant array<string>")
