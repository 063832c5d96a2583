"""The queries of the panel operators over the star schema, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import metrics as M
from ..functions.stats import PROBIT, PROBIT_TAIL, averaged_rank, order_statistic, quantiles, upper_rank
from ..operators import allocation as A
from ..operators import backtest as B
from ..operators import calibrate as K
from ..operators import diagnostics as D
from ..operators import ensemble as E
from ..operators import fractional as G
from ..operators import pairs as Q
from ..operators import panel as P
from ..sources import tables as S
from ..sources.shared import held
from .registry import FRAGMENTS, query

CUTOFFS = [date(2000, 4, 1), date(2000, 10, 1), date(2001, 4, 1)]
EXTENDED = [date(1999 + (1 + 2 * i) // 12, (1 + 2 * i) % 12 + 1, 1) for i in range(14)]
FULL_START = date(1996, 3, 1)
MODELS = ["exp24", "mean3", "naive"]

FRAGMENTS |= {
    "panel": """SELECT n_name AS key, r_name AS block, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
      round(sum(l_extendedprice), 2) AS liq_t, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 4) AS oil_t,
      round(avg(l_tax) * 1000, 6) AS p_res, CAST(24 * count(DISTINCT CAST(l_shipdate AS DATE)) AS DOUBLE) AS hours
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE l_shipdate < TIMESTAMP '2001-11-01' GROUP BY 1, 2, 3""",
    "rates": """SELECT *, day(last_day(date)) AS days, liq_t / day(last_day(date)) AS liq_tpd, oil_t / day(last_day(date)) AS oil_tpd,
      CASE WHEN liq_t > 0 THEN 1 - oil_t / liq_t END AS wct FROM panel""",
    "grid": """SELECT key, block, CAST(m AS DATE) AS date FROM (SELECT DISTINCT key, block FROM panel)
      CROSS JOIN (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS m FROM panel)""",
    "complete": """SELECT g.key, g.block, g.date, r.liq_t, r.oil_t, r.p_res, r.hours, r.days, r.liq_tpd, r.oil_tpd, r.wct,
      CASE WHEN r.key IS NOT NULL THEN 1 END AS weff FROM grid g LEFT JOIN rates r ON g.key = r.key AND g.date = r.date""",
    "injection": """SELECT n_name AS inj, r_name AS block, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, round(sum(l_quantity), 2) AS winj_m3
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate < TIMESTAMP '2001-11-01' GROUP BY 1, 2, 3""",
    "sites": """SELECT n_name AS key, r_name AS block, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(floor(n_nationkey / 5) AS DOUBLE) AS y, perm
      FROM (SELECT s_nationkey, round(avg(s_acctbal) + 2000, 6) AS perm FROM supplier GROUP BY 1) JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "injectors": """SELECT n_name AS inj, r_name AS block, n_nationkey % 5 + 0.5 AS x, CAST(floor(n_nationkey / 5) AS DOUBLE) AS y, CASE WHEN n_nationkey % 5 <> 0 THEN perm END AS perm
      FROM (SELECT c_nationkey, round(avg(c_acctbal) + 2000, 6) AS perm FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "imputed": "SELECT * REPLACE (coalesce(perm, avg(perm) OVER (PARTITION BY block)) AS perm) FROM injectors",
    "pairs": """SELECT p.key, p.block, i.inj, p.perm AS kp, i.perm AS ki, sqrt((p.x - i.x) * (p.x - i.x) + (p.y - i.y) * (p.y - i.y)) AS d FROM sites p JOIN imputed i USING (block)""",
    "hydro": "SELECT inj, key, w / sum(w) OVER (PARTITION BY inj) AS w FROM (SELECT inj, key, 2 * kp * ki / (kp + ki) / (d * d) AS w FROM pairs)",
    "distance": "SELECT inj, key, w / sum(w) OVER (PARTITION BY inj) AS w FROM (SELECT inj, key, 1 / (d * d) AS w FROM pairs)",
    "alloc": "SELECT key, date, sum(w * winj_m3) AS alloc FROM injection JOIN hydro USING (inj) GROUP BY 1, 2",
    "ext": "SELECT CAST(unnest(generate_series(DATE '1999-02-01', DATE '2001-04-01', INTERVAL 2 MONTH)) AS DATE) AS cutoff",
    "canon": "SELECT unnest([DATE '2000-04-01', DATE '2000-10-01', DATE '2001-04-01']) AS cutoff",
    "horizon": "SELECT unnest(range(1, 7)) AS step",
    "tails": """SELECT cutoff, key, block, date, liq_tpd AS v, row_number() OVER (PARTITION BY cutoff, key ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY cutoff, key) AS n_all
      FROM rates JOIN ext ON date <= cutoff WHERE liq_tpd IS NOT NULL""",
    "fits": """SELECT cutoff, key, 'naive' AS model, NULL AS b0, NULL AS b1, NULL AS n, greatest(v, 0) AS flat FROM tails WHERE r = 1 AND n_all >= 12
      UNION ALL SELECT cutoff, key, 'mean3', NULL, NULL, NULL, avg(v) FROM tails WHERE r <= 3 AND n_all >= 12 GROUP BY 1, 2
      UNION ALL SELECT cutoff, key, 'exp24', regr_intercept(ln(greatest(v, 1e-6)), least(n_all, 24) - r), regr_slope(ln(greatest(v, 1e-6)), least(n_all, 24) - r), min(least(n_all, 24)), NULL
      FROM tails WHERE r <= 24 AND n_all >= 12 GROUP BY 1, 2""",
    "forecasts": """SELECT cutoff, key, model, step, CAST(cutoff + to_months(CAST(step AS INT)) AS DATE) AS date, coalesce(flat, exp(b0 + b1 * (n - 1 + step))) AS y_pred FROM fits CROSS JOIN horizon""",
    "scored": "SELECT f.*, t.liq_tpd AS y_true, t.block FROM forecasts f JOIN rates t ON f.key = t.key AND f.date = t.date",
    "matrix": """SELECT cutoff, key, block, step, date, any_value(y_true) AS y_true, max(y_pred) FILTER (model = 'exp24') AS exp24, max(y_pred) FILTER (model = 'mean3') AS mean3,
      max(y_pred) FILTER (model = 'naive') AS naive FROM scored GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 3""",
    "trainw": """SELECT cutoff, model, (sum(ae) OVER m - ae) / (sum(ay) OVER m - ay) AS wape FROM
      (SELECT cutoff, model, sum(abs(y_true - y_pred)) AS ae, sum(abs(y_true)) AS ay FROM scored GROUP BY 1, 2) WINDOW m AS (PARTITION BY model)""",
    "intervals": "SELECT cutoff, key, block, step, date, y_true, naive AS y_pred, naive AS q50, least(exp24, mean3, naive) * 0.97 AS q10, greatest(exp24, mean3, naive) * 1.03 AS q90 FROM matrix",
    "calib": """SELECT f.cutoff AS fold, c.* FROM intervals c JOIN (SELECT DISTINCT cutoff FROM intervals) f
      ON abs(year(f.cutoff) * 12 + month(f.cutoff) - year(c.cutoff) * 12 - month(c.cutoff)) >= 6""",
    "flow": """SELECT c.key, c.block, c.date, c.liq_tpd AS liq, c.oil_tpd AS oil, c.wct,
      coalesce(sum(a.alloc) OVER (PARTITION BY c.key ORDER BY c.date), 0) AS w_cum FROM rates c LEFT JOIN alloc a ON c.key = a.key AND c.date = a.date""",
    "gpoints": """SELECT cutoff, key, block, ln(w_cum) AS lw, ln(wct / (1 - wct)) AS lwor, row_number() OVER (PARTITION BY cutoff, key ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY cutoff, key) AS n_all
      FROM flow JOIN ext ON date <= cutoff WHERE liq > 0 AND wct > 0.01 AND wct < 0.999 AND w_cum > 0""",
    "gentil": """SELECT l.cutoff, l.key, coalesce(g.n, 0) AS n, g.ln_alpha, g.beta, CASE WHEN coalesce(g.n, 0) < 6 THEN l.fo END AS fo_const
      FROM (SELECT cutoff, key, greatest(max_by(1 - wct, date), 0) AS fo FROM flow JOIN ext ON date <= cutoff WHERE liq > 0 GROUP BY 1, 2) l
      LEFT JOIN (SELECT cutoff, key, count(*) AS n, CASE WHEN count(*) >= 6 THEN regr_intercept(lwor, lw) END AS ln_alpha, CASE WHEN count(*) >= 6 THEN regr_slope(lwor, lw) END AS beta
      FROM gpoints WHERE r <= 48 GROUP BY 1, 2) g ON l.cutoff = g.cutoff AND l.key = g.key""",
    "errors2": """SELECT a.key, a.cutoff, a.step, (a.y_true - a.y_pred) / greatest(abs(a.y_pred), 1e-9) AS a, (b.y_true - b.y_pred) / greatest(abs(b.y_pred), 1e-9) AS b
      FROM scored a JOIN scored b ON a.key = b.key AND a.cutoff = b.cutoff AND a.step = b.step WHERE a.model = 'naive' AND b.model = 'exp24'""",
}


# Frames that several queries share.


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return P.rates(S.panel(spark, sf))


def complete(spark: SparkSession, sf: str) -> DataFrame:
    return P.complete(rates(spark, sf).withColumn("weff", F.lit(1)))


def flow(spark: SparkSession, sf: str) -> DataFrame:
    alloc = A.allocate(S.injection(spark, sf), hydro(spark, sf))
    joined = rates(spark, sf).join(alloc, ["key", "date"], "left")
    return P.cumulative(joined, "alloc", out="w_cum").select("key", "block", "date", F.col("liq_tpd").alias("liq"), F.col("oil_tpd").alias("oil"), "wct", "w_cum")


def hydro(spark: SparkSession, sf: str) -> DataFrame:
    return A.hydro_weights(S.sites(spark, sf), S.injector_sites(spark, sf))


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    df = rates(spark, sf)
    mean3 = B.context_tail(df, EXTENDED, 3, "liq_tpd").groupBy("cutoff", "key").agg(F.avg("liq_tpd").alias("y_pred"))
    parts = {"naive": B.naive(df, EXTENDED, "liq_tpd"), "mean3": C.expand_horizon(mean3), "exp24": B.exponential(df, EXTENDED, "liq_tpd")}
    every = [d.select("cutoff", "key", F.lit(m).alias("model"), "step", "date", "y_pred") for m, d in parts.items()]
    return every[0].unionByName(every[1]).unionByName(every[2])


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """All models' forecasts beside the truth, made once in an application; so is the matrix of them."""
    return held(spark, "scored", sf, lambda: _scored(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    truth = rates(spark, sf).select("key", "block", "date", F.col("liq_tpd").alias("y_true"))
    return forecasts(spark, sf).join(truth, ["key", "date"])


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    return held(spark, "matrix", sf, lambda: B.model_matrix(scored(spark, sf), MODELS, ("cutoff", "key", "block", "step", "date", "y_true")))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    low, high = F.least(*MODELS) * 0.97, F.greatest(*MODELS) * 1.03
    return matrix(spark, sf).select("cutoff", "key", "block", "step", "date", "y_true", F.col("naive").alias("y_pred"), F.col("naive").alias("q50"), low.alias("q10"), high.alias("q90"))


# Panel.


@query("key block date liq_t:2 oil_t:4 p_res:6 hours:1", "SELECT * FROM panel", "panel")
def panel_monthly(spark, sf):
    return S.panel(spark, sf)


@query("key date days:i liq_tpd:4 oil_tpd:4", "SELECT * FROM rates", "rates")
def panel_rates(spark, sf):
    return rates(spark, sf)


@query("key date wct:8", "SELECT * FROM rates", "rates")
def panel_watercut(spark, sf):
    return rates(spark, sf)


@query("key block date weff:i liq_tpd:4", "SELECT * FROM complete", "complete")
def panel_grid_complete(spark, sf):
    return complete(spark, sf)


@query(
    "key date liq:4 oil:4",
    "SELECT key, date, CASE WHEN s > 0 THEN coalesce(liq_tpd, 0) END AS liq, CASE WHEN s > 0 THEN coalesce(oil_tpd, 0) END AS oil FROM (SELECT *, sum(coalesce(CASE WHEN liq_t > 5000 THEN 1 END, 0)) OVER (PARTITION BY key ORDER BY date) AS s FROM complete)",
    "complete",
)
def panel_started_mask(spark, sf):
    df = complete(spark, sf).select("key", "date", F.when(F.col("liq_t") > 5000, 1).alias("weff"), F.coalesce("liq_tpd", F.lit(0.0)).alias("liq"), F.coalesce("oil_tpd", F.lit(0.0)).alias("oil"))
    return P.started(df, "liq", "oil")


@query("key date cum:2", "SELECT key, date, coalesce(sum(liq_t) OVER (PARTITION BY key ORDER BY date), 0) AS cum FROM complete", "complete")
def panel_cumulative(spark, sf):
    return P.cumulative(complete(spark, sf), "liq_t")


@query("key date cum:2", "SELECT key, date, coalesce(sum(liq_t) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM complete", "complete")
def panel_cumulative_exclusive(spark, sf):
    return P.cumulative(complete(spark, sf), "liq_t", exclusive=True)


@query("key date age_m:i", "SELECT key, date, count(liq_t) OVER (PARTITION BY key ORDER BY date) AS age_m FROM complete", "complete")
def panel_age(spark, sf):
    return P.age(complete(spark, sf), "liq_t")


_WIDE = ["NATION_0", "NATION_6", "NATION_12"]


@query("date NATION_0:4 NATION_6:4 NATION_12:4", "SELECT date, " + ", ".join(f"max(liq_tpd) FILTER (key = '{k}') AS {k}" for k in _WIDE) + " FROM rates GROUP BY date", "rates")
def panel_pivot(spark, sf):
    return P.pivot(rates(spark, sf), "liq_tpd", _WIDE)


@query("date key value:4", "SELECT date, key, liq_tpd AS value FROM rates WHERE key IN ('NATION_0', 'NATION_6', 'NATION_12')", "rates")
def panel_unpivot(spark, sf):
    return P.unpivot(P.pivot(rates(spark, sf), "liq_tpd", _WIDE), _WIDE).where("value is not null")


_GAPPY = "SELECT key, date, row_number() OVER (PARTITION BY key ORDER BY date) AS n, CASE WHEN month(date) % 4 <> 1 THEN liq_tpd END AS v FROM complete"


def _gappy(spark, sf):
    return complete(spark, sf).select("key", "date", F.when(F.month("date") % 4 != 1, F.col("liq_tpd")).alias("v"))


@query(
    "key date filled:4",
    f"SELECT key, date, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY date), first_value(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM ({_GAPPY})",
    "complete",
)
def panel_ffill_bfill(spark, sf):
    return P.fill(_gappy(spark, sf), "v", backward=True)


@query(
    "key date filled:4",
    f"""SELECT key, date, coalesce(v, va + (vb - va) * (n - na) / nullif(nb - na, 0), va, vb) AS filled FROM (
      SELECT *, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER b AS na, last_value(v IGNORE NULLS) OVER b AS va,
        first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER a AS nb, first_value(v IGNORE NULLS) OVER a AS vb FROM ({_GAPPY})
      WINDOW b AS (PARTITION BY key ORDER BY date), a AS (PARTITION BY key ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "complete",
)
def panel_interpolate(spark, sf):
    return P.interpolate(_gappy(spark, sf), "v")


@query(
    "key date " + " ".join(f"lag{k}:4" for k in (1, 2, 3, 4, 5, 6, 12)) + " mean3:4 mean6:4",
    "SELECT key, date, " + ", ".join(f"lag(liq_tpd, {k}) OVER w AS lag{k}" for k in (1, 2, 3, 4, 5, 6, 12)) + "".join(f", CASE WHEN count(liq_tpd) OVER m{k} = {k} THEN avg(liq_tpd) OVER m{k} END AS mean{k}" for k in (3, 6))
    + " FROM complete WINDOW w AS (PARTITION BY key ORDER BY date)" + "".join(f", m{k} AS (PARTITION BY key ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (3, 6)),
    "complete",
)
def panel_lags_rolling(spark, sf):
    return P.lags(complete(spark, sf), "liq_tpd")


@query("key date uptime:8 eff_rate:4", "SELECT key, date, hours / (24 * days) AS uptime, CASE WHEN hours >= 24 THEN liq_t / (hours / 24) END AS eff_rate FROM rates", "rates")
def panel_uptime_rate(spark, sf):
    return P.uptime(rates(spark, sf))


@query(
    "month wNATION_6:4 wNATION_12:4 iNATION_6:2 iNATION_12:2",
    "SELECT strftime(date, '%Y-%m-%d') AS month, max(v) FILTER (c = 'wNATION_6') AS wNATION_6, max(v) FILTER (c = 'wNATION_12') AS wNATION_12, max(v) FILTER (c = 'iNATION_6') AS iNATION_6, max(v) FILTER (c = 'iNATION_12') AS iNATION_12 FROM (SELECT date, 'w' || key AS c, liq_tpd AS v FROM rates UNION ALL SELECT date, 'i' || inj, winj_m3 FROM injection) GROUP BY date",
    "rates injection",
)
def panel_wide_export(spark, sf):
    rows = rates(spark, sf).select("date", F.concat(F.lit("w"), "key").alias("c"), F.col("liq_tpd").alias("v"))
    rows = rows.unionByName(S.injection(spark, sf).select("date", F.concat(F.lit("i"), "inj").alias("c"), F.col("winj_m3").alias("v")))
    return P.pivot(rows, "v", ["wNATION_6", "wNATION_12", "iNATION_6", "iNATION_12"], key="c").withColumn("month", F.date_format("date", "yyyy-MM-dd"))


@query("key date weight:8", "SELECT key, date, pow(0.5, (count(*) OVER (PARTITION BY key) - row_number() OVER (PARTITION BY key ORDER BY date)) / 24.0) AS weight FROM complete", "complete")
def panel_recency_weights(spark, sf):
    return P.recency(complete(spark, sf))


@query("key first_date last_date n_valid:i last_value:4", "SELECT key, min(date) AS first_date, max(date) AS last_date, count(*) AS n_valid, max_by(liq_tpd, date) AS last_value FROM rates GROUP BY key", "rates")
def panel_first_last_valid(spark, sf):
    return rates(spark, sf).groupBy("key").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_valid"), F.max_by("liq_tpd", "date").alias("last_value"))


@query("block start", "SELECT block, max(f) AS start FROM (SELECT block, key, min(date) AS f FROM rates GROUP BY 1, 2) GROUP BY 1", "rates")
def panel_block_start(spark, sf):
    return rates(spark, sf).groupBy("block", "key").agg(F.min("date").alias("f")).groupBy("block").agg(F.max("f").alias("start"))


# Calendar.


@query("cutoff n:i", "SELECT cutoff, count(*) AS n FROM ext JOIN rates ON date <= cutoff GROUP BY 1", "ext rates")
def cutoffs_extended(spark, sf):
    """The cutoffs that the panel has months at, every second month, with the rows that each knows."""
    df = rates(spark, sf)
    return B.contexts(df, EXTENDED).groupBy("cutoff").agg(F.count("*").alias("n"))


@query("key cutoff step:i date", "SELECT key, cutoff, step, CAST(cutoff + to_months(CAST(step AS INT)) AS DATE) AS date FROM (SELECT key, max(date) AS cutoff FROM rates GROUP BY 1) CROSS JOIN horizon", "rates horizon")
def horizon_expand(spark, sf):
    """The months after each series' last one."""
    return C.expand_horizon(rates(spark, sf).groupBy("key").agg(F.max("date").alias("cutoff")))


@query("key date cutoff d:i", "SELECT key, date, cutoff, abs(year(date) * 12 + month(date) - year(cutoff) * 12 - month(cutoff)) AS d FROM rates CROSS JOIN ext", "ext rates")
def month_distance(spark, sf):
    """How many months each row is from each cutoff."""
    each = rates(spark, sf).withColumn("cutoff", F.explode(F.array(*(F.lit(c) for c in EXTENDED))))
    return each.withColumn("d", C.month_distance("date", "cutoff"))


@query("key date t_days:i", "SELECT key, date, date - min(date) OVER w + day(last_day(min(date) OVER w)) AS t_days FROM rates WINDOW w AS (PARTITION BY key)", "rates")
def time_axis_days(spark, sf):
    return C.time_axis(rates(spark, sf))


@query("inj step:i date winj_m3:2", "SELECT inj, step, CAST(DATE '2001-04-01' + to_months(CAST(step AS INT)) AS DATE) AS date, w AS winj_m3 FROM (SELECT inj, max_by(winj_m3, date) AS w FROM injection WHERE date <= DATE '2001-04-01' GROUP BY 1) CROSS JOIN horizon", "injection horizon")
def carry_forward_plan(spark, sf):
    return P.carry_forward(S.injection(spark, sf), "winj_m3", C.HORIZON, CUTOFFS[-1], key="inj")


# Allocation.


@query("inj key w:10", "SELECT * FROM hydro", "hydro")
def weights_hydro(spark, sf):
    return hydro(spark, sf)


@query("inj key w:10", "SELECT * FROM distance", "distance")
def weights_distance(spark, sf):
    return A.distance_weights(S.sites(spark, sf), S.injector_sites(spark, sf))


@query("inj key w:10", "SELECT inj, key, 1.0 / count(*) OVER (PARTITION BY inj) AS w FROM pairs", "pairs")
def weights_uniform(spark, sf):
    return A.uniform_weights(S.sites(spark, sf), S.injector_sites(spark, sf))


@query("key date alloc:4", "SELECT * FROM alloc", "alloc")
def allocate_injection(spark, sf):
    return A.allocate(S.injection(spark, sf), hydro(spark, sf))


@query("key date inj_block:2", "SELECT key, date, inj_block FROM sites JOIN (SELECT block, date, sum(winj_m3) AS inj_block FROM injection GROUP BY 1, 2) USING (block)", "sites injection")
def block_injection(spark, sf):
    return A.block_sums(S.injection(spark, sf), S.sites(spark, sf))


_GAINS = "SELECT i.inj, p.key, 1 / (1 + (p.x - i.x) * (p.x - i.x) + (p.y - i.y) * (p.y - i.y)) AS w, p.block = i.block AS same_block FROM sites p CROSS JOIN injectors i"


def _gains(spark, sf):
    """Stand-in gains of all injector-producer pairs, both few: the full cross that the field fit is about."""
    i = S.injector_sites(spark, sf).select("inj", F.col("block").alias("bi"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    dx, dy = F.col("x") - F.col("xi"), F.col("y") - F.col("yi")
    return S.sites(spark, sf).crossJoin(i).select("inj", "key", (1 / (1 + dx * dx + dy * dy)).alias("w"), (F.col("block") == F.col("bi")).alias("same_block"))


@query("share:10", f"SELECT sum(w) FILTER (same_block) / sum(w) AS share FROM ({_GAINS})", "sites injectors")
def block_share(spark, sf):
    return A.block_share(_gains(spark, sf).select("inj", "key", "w"), S.sites(spark, sf), S.injector_sites(spark, sf))


@query("inj block perm:6", "SELECT * FROM imputed", "imputed")
def impute_block_mean(spark, sf):
    return P.impute_group_mean(S.injector_sites(spark, sf), "perm", "block")


# Forecasts and backtests.

_TRUTH = "SELECT f.cutoff, f.key, f.step, f.date, t.liq_tpd AS y_true, f.y_pred FROM forecasts f LEFT JOIN rates t ON f.key = t.key AND f.date = t.date WHERE model = '{}' AND cutoff IN (SELECT cutoff FROM canon)"


@query("cutoff key step:i date y_pred:4", "SELECT * FROM forecasts WHERE model = 'naive' AND cutoff IN (SELECT cutoff FROM canon)", "forecasts canon")
def fc_naive(spark, sf):
    return B.naive(rates(spark, sf), CUTOFFS, "liq_tpd")


@query("cutoff key step:i date y_pred:4", "SELECT * FROM forecasts WHERE model = 'exp24' AND cutoff IN (SELECT cutoff FROM canon)", "forecasts canon")
def fc_exp24(spark, sf):
    return B.exponential(rates(spark, sf), CUTOFFS, "liq_tpd")


def backtest(spark, sf, model):
    df = rates(spark, sf)
    return B.attach_truth({"naive": B.naive, "exp24": B.exponential}[model](df, CUTOFFS, "liq_tpd"), df, "liq_tpd")


@query("cutoff key step:i date y_true:4 y_pred:4", _TRUTH.format("naive"), "forecasts rates canon")
def backtest_naive(spark, sf):
    return backtest(spark, sf, "naive")


@query("cutoff key step:i date y_true:4 y_pred:4", _TRUTH.format("exp24"), "forecasts rates canon")
def backtest_exp24(spark, sf):
    return backtest(spark, sf, "exp24")


@query("cutoff key model step:i date y_true:4 y_pred:4", "SELECT * FROM scored", "scored")
def attach_truth(spark, sf):
    return scored(spark, sf)


@query("cutoff key step:i y_true:4 y_pred:4", "SELECT cutoff, s.key, step, u.liq_tpd AS y_true, s.y_pred * u.hours / (24 * u.days) AS y_pred FROM forecasts s JOIN rates u ON s.key = u.key AND s.date = u.date WHERE model = 'naive'", "forecasts rates")
def uptime_calendar_eval(spark, sf):
    up = P.uptime(rates(spark, sf)).select("key", "date", "uptime", F.col("liq_tpd").alias("y_true"))
    return forecasts(spark, sf).where("model = 'naive'").join(up, ["key", "date"]).withColumn("y_pred", F.col("y_pred") * F.col("uptime")).na.drop(subset=["y_true", "y_pred"])


@query("cutoff key n:i ln_alpha:6 beta:6 fo_const:8", "SELECT * FROM gentil", "gentil")
def gentil_params(spark, sf):
    return G.fit(flow(spark, sf), EXTENDED)


@query(
    "cutoff key step:i fo:6 oil:3",
    "SELECT f.cutoff, f.key, step, coalesce(1 / (1 + exp(ln_alpha + beta * ln(greatest(w_cum, 1e-9)))), fo_const) AS fo, y_pred * coalesce(1 / (1 + exp(ln_alpha + beta * ln(greatest(w_cum, 1e-9)))), fo_const) AS oil FROM forecasts f JOIN gentil g ON f.cutoff = g.cutoff AND f.key = g.key JOIN flow w ON f.key = w.key AND f.date = w.date WHERE model = 'naive'",
    "forecasts gentil flow",
)
def gentil_oil(spark, sf):
    w = flow(spark, sf)
    both = forecasts(spark, sf).where("model = 'naive'").join(G.fit(w, EXTENDED), ["cutoff", "key"]).join(w.select("key", "date", "w_cum"), ["key", "date"])
    return both.withColumn("fo", G.oil_share(F.col("w_cum"))).withColumn("oil", F.col("y_pred") * F.col("fo"))


FRAGMENTS |= {
    "hsums": """SELECT cutoff, block, key, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(lwor) AS sy, sum(x * lwor) AS sxy, any_value(centre) AS centre, regr_intercept(lwor, x) AS a0, regr_slope(lwor, x) AS b0
      FROM (SELECT *, lw - centre AS x FROM (SELECT *, avg(lw) OVER (PARTITION BY cutoff) AS centre FROM gpoints WHERE r <= 48 AND n_all >= 6)) GROUP BY 1, 2, 3""",
    "hstats": """SELECT *, avg(a0) OVER f AS gma, greatest(var_samp(a0) OVER f, 1e-3) AS gva, avg(b0) OVER f AS gmb, greatest(var_samp(b0) OVER f, 1e-3) AS gvb,
      avg(a0) OVER b AS bma, greatest(var_samp(a0) OVER b, 1e-3) AS bva, avg(b0) OVER b AS bmb, greatest(var_samp(b0) OVER b, 1e-3) AS bvb, count(*) OVER b >= 3 AS enough
      FROM hsums WINDOW f AS (PARTITION BY cutoff), b AS (PARTITION BY cutoff, block)""",
    "hmodes": """SELECT cutoff, key, n, sx, sxx, sy, sxy, centre, 'global' AS mode, gma AS ma, gva AS va, gmb AS mb, gvb AS vb FROM hstats
      UNION ALL SELECT cutoff, key, n, sx, sxx, sy, sxy, centre, 'block', CASE WHEN enough THEN bma ELSE gma END, CASE WHEN enough THEN bva ELSE gva END, CASE WHEN enough THEN bmb ELSE gmb END, CASE WHEN enough THEN bvb ELSE gvb END FROM hstats""",
    "lambdas": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else v}::DOUBLE)" for i, v in enumerate(G.LAMBDAS)) + ") AS t(lam_order, lam)",
    "hgrid": """SELECT cutoff, key, mode, lam_order, lam, centre, CASE WHEN lam IS NULL THEN ma ELSE (u * r - v * q) / (p * r - q * q) END AS a, CASE WHEN lam IS NULL THEN mb ELSE (p * v - q * u) / (p * r - q * q) END AS b
      FROM (SELECT *, n + lam / va AS p, sx AS q, sxx + lam / vb AS r, sy + lam * ma / va AS u, sxy + lam * mb / vb AS v FROM hmodes CROSS JOIN lambdas)""",
    "herrors": """SELECT h.cutoff, mode, lam_order, sum(abs(w.oil - f.y_pred / (1 + exp(a + b * (ln(greatest(w_cum, 1e-9)) - centre))))) AS ae, sum(abs(w.oil)) AS ay
      FROM hgrid h JOIN forecasts f ON f.cutoff = h.cutoff AND f.key = h.key JOIN flow w ON f.key = w.key AND f.date = w.date WHERE model = 'naive' GROUP BY 1, 2, 3""",
}


def _hier_errors(spark, sf):
    w = flow(spark, sf)
    grid = G.hierarchical(w, EXTENDED)
    rows = grid.join(forecasts(spark, sf).where("model = 'naive'"), ["cutoff", "key"]).join(w.select("key", "date", "oil", "w_cum"), ["key", "date"])
    share = 1 / (1 + F.exp(F.col("a") + F.col("b") * (F.log(F.greatest("w_cum", F.lit(1e-9))) - F.col("centre"))))
    return rows.groupBy("cutoff", "mode", "lam_order").agg(F.sum(F.abs(F.col("oil") - F.col("y_pred") * share)).alias("ae"), F.sum(F.abs("oil")).alias("ay"))


@query("cutoff key mode lam_order:i lam:2 a:6 b:6", "SELECT * FROM hgrid", "hgrid")
def hier_gentil_grid(spark, sf):
    return G.hierarchical(flow(spark, sf), EXTENDED)


@query(
    "cutoff mode lam_order:i",
    "SELECT cutoff, mode, lam_order FROM (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY round(w, 12), CASE mode WHEN 'global' THEN 0 ELSE 1 END, lam_order) AS r FROM (SELECT *, (sum(ae) OVER g - ae) / (sum(ay) OVER g - ay) AS w FROM herrors WINDOW g AS (PARTITION BY mode, lam_order))) WHERE r = 1",
    "herrors",
)
def hier_gentil_selected(spark, sf):
    return G.select_configuration(_hier_errors(spark, sf))


# Metrics.

_ALL = "SELECT {} FROM scored WHERE model = 'naive'"


def _naive(spark, sf):
    return scored(spark, sf).where("model = 'naive'")


@query("wape:8", _ALL.format("sum(abs(y_true - y_pred)) / nullif(sum(abs(y_true)), 0) AS wape"), "scored")
def metric_wape(spark, sf):
    return _naive(spark, sf).agg(M.wape("y_true", "y_pred").alias("wape"))


@query("smape:8", _ALL.format("avg(CASE WHEN abs(y_true) + abs(y_pred) > 0 THEN abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2) END) AS smape"), "scored")
def metric_smape(spark, sf):
    return _naive(spark, sf).agg(M.smape("y_true", "y_pred").alias("smape"))


@query("rmse:4", _ALL.format("sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse"), "scored")
def metric_rmse(spark, sf):
    return _naive(spark, sf).agg(M.rmse("y_true", "y_pred").alias("rmse"))


@query("mae:4", _ALL.format("avg(abs(y_true - y_pred)) AS mae"), "scored")
def metric_mae(spark, sf):
    return _naive(spark, sf).agg(M.mae("y_true", "y_pred").alias("mae"))


@query("cum_err_pct:6", _ALL.format("CASE WHEN sum(y_true) > 0 THEN (sum(y_pred) - sum(y_true)) / sum(y_true) * 100 END AS cum_err_pct"), "scored")
def metric_cum_err(spark, sf):
    return _naive(spark, sf).agg(M.cum_error_pct("y_true", "y_pred").alias("cum_err_pct"))


@query(
    "key mase:6",
    "SELECT e.key, CASE WHEN s > 0 THEN m / s END AS mase FROM (SELECT key, avg(abs(y_true - y_pred)) AS m FROM scored WHERE model = 'naive' GROUP BY 1) e JOIN (SELECT key, avg(d) AS s FROM (SELECT key, abs(liq_tpd - lag(liq_tpd) OVER (PARTITION BY key ORDER BY date)) AS d FROM rates WHERE date <= DATE '2000-04-01') GROUP BY 1) h ON e.key = h.key",
    "scored rates",
)
def metric_mase(spark, sf):
    history = rates(spark, sf).where(F.col("date") <= F.lit(CUTOFFS[0])).withColumnRenamed("liq_tpd", "value")
    return M.mase(_naive(spark, sf), history)


@query("pinball:4", "SELECT avg(greatest(tau * d, (tau - 1) * d)) AS pinball FROM (SELECT 0.1 AS tau, y_true - q10 AS d FROM intervals UNION ALL SELECT 0.5, y_true - q50 FROM intervals UNION ALL SELECT 0.9, y_true - q90 FROM intervals)", "intervals")
def metric_pinball(spark, sf):
    return M.pinball(intervals(spark, sf), {"q10": 0.1, "q50": 0.5, "q90": 0.9})


@query("coverage:8 width:8", "SELECT avg(CASE WHEN y_true BETWEEN q10 AND q90 THEN 1.0 ELSE 0 END) AS coverage, avg(q90 - q10) / avg(y_true) AS width FROM intervals", "intervals")
def metric_coverage(spark, sf):
    return intervals(spark, sf).agg(M.coverage("y_true", "q10", "q90").alias("coverage"), M.relative_width("y_true", "q10", "q90").alias("width"))


_SUMMARY = """SELECT {key} coalesce(CAST(cutoff AS VARCHAR), 'ALL') AS cutoff, sum(abs(y_true - y_pred)) / nullif(sum(abs(y_true)), 0) AS wape,
  avg(CASE WHEN abs(y_true) + abs(y_pred) > 0 THEN abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2) END) AS smape, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
  CASE WHEN sum(y_true) > 0 THEN (sum(y_pred) - sum(y_true)) / sum(y_true) * 100 END AS cum_err_pct FROM ({rows}) GROUP BY {sets}"""
_SUMMARIZE = f"""SELECT s.*, w.wape_med_key FROM ({{s}}) s JOIN (SELECT coalesce(CAST(cutoff AS VARCHAR), 'ALL') AS cutoff, median(w) AS wape_med_key FROM
  (SELECT cutoff, key, sum(abs(y_true - y_pred)) / nullif(sum(abs(y_true)), 0) AS w, grouping(cutoff) AS g FROM ({{rows}}) GROUP BY GROUPING SETS ((cutoff, key), (key))) GROUP BY 1) w ON s.cutoff = w.cutoff"""


def _summary_sql(rows: str) -> str:
    return _SUMMARIZE.format(s=_SUMMARY.format(key="", rows=rows, sets="GROUPING SETS ((cutoff), ())"), rows=rows)


@query("cutoff wape:8 smape:8 rmse:4 cum_err_pct:6 wape_med_key:8", _summary_sql("SELECT * FROM scored WHERE model = 'naive'"), "scored")
def summarize(spark, sf):
    return M.summarize(_naive(spark, sf))


@query(
    "cutoff base:8 variant:8 delta:8",
    "SELECT coalesce(CAST(cutoff AS VARCHAR), 'ALL') AS cutoff, b / y AS base, v / y AS variant, v / y - b / y AS delta FROM (SELECT cutoff, sum(abs(y_true - naive)) AS b, sum(abs(y_true - exp24)) AS v, sum(abs(y_true)) AS y FROM matrix GROUP BY GROUPING SETS ((cutoff), ()))",
    "matrix",
)
def compare_variants(spark, sf):
    g = matrix(spark, sf).groupingSets([[F.col("cutoff")], []], "cutoff").agg(M.wape("y_true", "naive").alias("base"), M.wape("y_true", "exp24").alias("variant"))
    return g.withColumn("cutoff", F.coalesce(F.col("cutoff").cast("string"), F.lit("ALL"))).withColumn("delta", F.col("variant") - F.col("base"))


@query(
    "model wape:8 wape_canon:8 bias_pct:6",
    "SELECT model, sum(abs(y_true - y_pred)) / sum(abs(y_true)) AS wape, sum(abs(y_true - y_pred)) FILTER (cutoff IN (SELECT cutoff FROM canon)) / sum(abs(y_true)) FILTER (cutoff IN (SELECT cutoff FROM canon)) AS wape_canon, (sum(y_pred) - sum(y_true)) / sum(y_true) * 100 AS bias_pct FROM scored GROUP BY 1",
    "scored canon",
)
def evaluate_filtered(spark, sf):
    canon = F.col("cutoff").isin(CUTOFFS)
    y, p = F.when(canon, F.col("y_true")), F.when(canon, F.col("y_pred"))
    return scored(spark, sf).groupBy("model").agg(M.wape("y_true", "y_pred").alias("wape"), M.wape(y, p).alias("wape_canon"), M.cum_error_pct("y_true", "y_pred").alias("bias_pct"))


@query("model cutoff wape:8 rmse:4", "SELECT model, coalesce(CAST(cutoff AS VARCHAR), 'ALL') AS cutoff, sum(abs(y_true - y_pred)) / sum(abs(y_true)) AS wape, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse FROM scored WHERE model NOT LIKE 'mean%' GROUP BY GROUPING SETS ((model, cutoff), (model))", "scored")
def collect_models(spark, sf):
    rows = scored(spark, sf).where(~F.col("model").rlike("^(mean)"))
    g = rows.groupingSets([[F.col("model"), F.col("cutoff")], [F.col("model")]], "model", "cutoff").agg(M.wape("y_true", "y_pred").alias("wape"), M.rmse("y_true", "y_pred").alias("rmse"))
    return g.withColumn("cutoff", F.coalesce(F.col("cutoff").cast("string"), F.lit("ALL")))


@query("date q10:2 y:2 q90:2", "SELECT date, sum(q10) AS q10, sum(y_pred) AS y, sum(q90) AS q90 FROM intervals WHERE cutoff = DATE '2001-04-01' GROUP BY date", "intervals")
def field_totals(spark, sf):
    return intervals(spark, sf).where(F.col("cutoff") == F.lit(CUTOFFS[-1])).groupBy("date").agg(F.sum("q10").alias("q10"), F.sum("y_pred").alias("y"), F.sum("q90").alias("q90"))


# Joins and sets.


@query("cutoff key step:i date y_true:4 exp24:4 mean3:4 naive:4", "SELECT * FROM matrix", "matrix")
def model_matrix(spark, sf):
    return matrix(spark, sf)


@query("key date v:4", "SELECT key, date, min_by(y_pred, cutoff) AS v FROM forecasts WHERE model = 'naive' GROUP BY 1, 2", "forecasts")
def asof_splice(spark, sf):
    return B.splice(forecasts(spark, sf).where("model = 'naive'").withColumnRenamed("y_pred", "v"))


@query("cutoff model wape:8", "SELECT * FROM trainw", "trainw")
def loo_train_totals(spark, sf):
    return E.train_wape(matrix(spark, sf), MODELS)


@query("fold n:i y:2", "SELECT fold, count(*) AS n, sum(y_true) AS y FROM calib GROUP BY 1", "calib")
def nonoverlap_calibration(spark, sf):
    return K.folds(intervals(spark, sf)).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y_true").alias("y"))


_BUSY = "SELECT key FROM rates WHERE liq_tpd > 2000 GROUP BY key HAVING count(*) >= 24"


def _busy(spark, sf):
    return rates(spark, sf).where("liq_tpd > 2000").groupBy("key").count().where("count >= 24").select("key")


@query("key date liq_tpd:4", f"SELECT * FROM rates WHERE key IN ({_BUSY})", "rates")
def semi_keep_series(spark, sf):
    return rates(spark, sf).join(_busy(spark, sf), "key", "left_semi")


_ABOVE = "SELECT key, date FROM rates WHERE liq_tpd > (SELECT avg(liq_tpd) FROM rates)"


def _above(spark, sf):
    """The months of a rate above the field's mean."""
    df = rates(spark, sf)
    mean = df.agg(F.avg("liq_tpd").alias("_mean"))  # one row
    return df.crossJoin(F.broadcast(mean)).where(F.col("liq_tpd") > F.col("_mean")).select("key", "date")


@query("key date", f"SELECT key, date FROM grid g WHERE NOT EXISTS (SELECT 1 FROM ({_ABOVE}) r WHERE r.key = g.key AND r.date = g.date)", "grid rates")
def anti_missing_series(spark, sf):
    """The months of the grid that have no rate above the field's mean."""
    return P.complete(rates(spark, sf)).select("key", "date").join(_above(spark, sf), ["key", "date"], "left_anti")


@query("key n:i", "SELECT key, count(*) AS n FROM rates r WHERE (SELECT max(date) FROM rates) = (SELECT max(date) FROM rates x WHERE x.key = r.key) GROUP BY 1 HAVING count(*) >= 24", "rates")
def keep_current_series(spark, sf):
    df = rates(spark, sf)
    last = df.groupBy("key").agg(F.max("date").alias("last"), F.count("*").alias("n"))
    return last.join(df.agg(F.max("date").alias("last")), "last").where("n >= 24")


@query("a b same_block n:i r:6", "SELECT a.key AS a, b.key AS b, any_value(a.block = b.block) AS same_block, count(*) AS n, corr(a.liq_tpd, b.liq_tpd) AS r FROM rates a JOIN rates b ON a.date = b.date AND a.key < b.key GROUP BY 1, 2", "rates")
def self_pairs(spark, sf):
    """Pairs of series over their common months: the pairs of keys are the result."""
    df = rates(spark, sf)
    blocks = df.groupBy("key").agg(F.first("block").alias("block"))
    both = Q.pair_correlations(df, "liq_tpd").join(blocks.toDF("a", "block_a"), "a").join(blocks.toDF("b", "block_b"), "b")
    return both.withColumn("same_block", F.col("block_a") == F.col("block_b"))


@query("key cutoff step:i a:8 b:8", "SELECT * FROM errors2", "errors2")
def residual_pairs(spark, sf):
    return _errors2(spark, sf)


def _errors2(spark, sf):
    rows = scored(spark, sf).select("key", "cutoff", "step", "model", D.relative_error().alias("e"))
    return rows.where("model = 'naive'").withColumnRenamed("e", "a").drop("model").join(rows.where("model = 'exp24'").withColumnRenamed("e", "b").drop("model"), ["key", "cutoff", "step"])


@query("date a:4 b:4", "SELECT coalesce(a.date, b.date) AS date, a.v AS a, b.v AS b FROM (SELECT date, liq_tpd AS v FROM rates WHERE key = 'NATION_6' AND date < DATE '2000-01-01') a FULL JOIN (SELECT date, liq_tpd AS v FROM rates WHERE key = 'NATION_12' AND date >= DATE '1996-03-01') b ON a.date = b.date", "rates")
def full_outer_assembly(spark, sf):
    df = rates(spark, sf)
    a = df.where((F.col("key") == "NATION_6") & (F.col("date") < F.lit(date(2000, 1, 1)))).select("date", F.col("liq_tpd").alias("a"))
    return a.join(df.where((F.col("key") == "NATION_12") & (F.col("date") >= F.lit(FULL_START))).select("date", F.col("liq_tpd").alias("b")), "date", "full")


@query("key date liq_tpd:4 alloc:4", "SELECT r.key, r.date, liq_tpd, alloc FROM rates r LEFT JOIN alloc a ON r.key = a.key AND r.date = a.date", "rates alloc")
def validated_one_to_one(spark, sf):
    left = P.assert_unique(rates(spark, sf), "key", "date")
    right = P.assert_unique(A.allocate(S.injection(spark, sf), hydro(spark, sf)), "key", "date")
    return left.join(right, ["key", "date"], "left")


@query("key", "SELECT DISTINCT key FROM rates WHERE block = 'ASIA' UNION SELECT DISTINCT key FROM rates WHERE liq_tpd > 3000", "rates")
def set_union(spark, sf):
    df = rates(spark, sf)
    return df.where("block = 'ASIA'").select("key").union(df.where("liq_tpd > 3000").select("key")).distinct()


@query("date", "SELECT date FROM rates WHERE key = 'NATION_6' INTERSECT SELECT date FROM rates WHERE key = 'NATION_12' AND liq_tpd > 1000", "rates")
def set_intersect(spark, sf):
    df = rates(spark, sf)
    return df.where("key = 'NATION_6'").select("date").intersect(df.where("key = 'NATION_12' and liq_tpd > 1000").select("date"))


_LEADING = f"SELECT key FROM ({_ABOVE}) GROUP BY key HAVING 2 * count(*) > (SELECT count(DISTINCT date) FROM rates)"


@query("key", f"SELECT DISTINCT key FROM rates EXCEPT SELECT key FROM ({_LEADING})", "rates")
def set_except(spark, sf):
    """Series that aren't above the field's mean in most months."""
    df = rates(spark, sf)
    months = df.agg(F.count_distinct("date").alias("months"))  # one row
    leading = _above(spark, sf).groupBy("key").count().crossJoin(F.broadcast(months)).where("2 * count > months").select("key")
    return df.select("key").subtract(leading)


@query("key date", "SELECT key, date FROM rates EXCEPT SELECT key, date FROM rates WHERE liq_tpd > 2000", "rates")
def set_except_months(spark, sf):
    df = rates(spark, sf)
    return df.select("key", "date").subtract(df.where("liq_tpd > 2000").select("key", "date"))


@query("key block code:i", "SELECT key, block, dense_rank() OVER (ORDER BY block) - 1 AS code FROM sites", "sites")
def category_codes(spark, sf):
    return P.category_codes(S.sites(spark, sf), "block")


@query("name model target", "SELECT name, regexp_extract(name, '^(.*)_([^_]*_[^_]*)$', 1) AS model, regexp_extract(name, '^(.*)_([^_]*_[^_]*)$', 2) AS target FROM (SELECT DISTINCT model || '_by_' || lower(block) || '_liq_tpd' AS name FROM scored)", "scored")
def parse_result_name(spark, sf):
    """Names as result files have, of each model and block that there are forecasts of."""
    names = scored(spark, sf).select(F.concat("model", F.lit("_by_"), F.lower("block"), F.lit("_liq_tpd")).alias("name")).distinct()
    return names.select("name", *S.parse_result_name())


@query("quoted id:i", "SELECT quoted, CAST(trim(quoted, '''') AS INT) AS id FROM (SELECT '''' || s_suppkey || '''' AS quoted FROM supplier)")
def strip_quoted_id(spark, sf):
    q = S.read(spark, sf, "supplier").select(F.concat(F.lit("'"), F.col("s_suppkey").cast("string"), F.lit("'")).alias("quoted"))
    return q.withColumn("id", F.btrim("quoted", F.lit("'")).cast("int"))


# Windows of each series' own.


_TO_PEAK = "SELECT r.key, r.date, r.liq_tpd, p.peak FROM rates r JOIN (SELECT key, max_by(date, liq_tpd) AS peak FROM rates GROUP BY 1) p ON r.key = p.key AND r.date <= p.peak"


def _to_peak(spark, sf):
    """Each series up to the month of its highest rate: series that end in different months."""
    df = rates(spark, sf)
    peak = df.groupBy("key").agg(F.max_by("date", "liq_tpd").alias("peak"))
    return df.join(peak, "key").where(F.col("date") <= F.col("peak")).select("key", "date", "liq_tpd")


@query(
    "cutoff key step:i date y_true:4 y_pred:4",
    f"""WITH s AS ({_TO_PEAK}), o AS (SELECT DISTINCT key, CAST(peak - to_months(CAST(6 + 2 * w AS INT)) AS DATE) AS cutoff FROM s CROSS JOIN (SELECT unnest(range(0, 4)) AS w)),
      t AS (SELECT o.cutoff, s.key, ln(greatest(s.liq_tpd, 1e-6)) AS ly, row_number() OVER (PARTITION BY o.cutoff, s.key ORDER BY s.date DESC) AS r, count(*) OVER (PARTITION BY o.cutoff, s.key) AS n FROM s JOIN o ON s.key = o.key AND s.date <= o.cutoff),
      f AS (SELECT cutoff, key, regr_slope(ly, least(n, 24) - r) AS b1, regr_intercept(ly, least(n, 24) - r) AS b0, max(least(n, 24)) AS n FROM t WHERE r <= 24 AND n >= 12 GROUP BY 1, 2),
      p AS (SELECT cutoff, key, step, CAST(cutoff + to_months(CAST(step AS INT)) AS DATE) AS date, exp(b0 + b1 * (n - 1 + step)) AS y_pred FROM f CROSS JOIN horizon)
      SELECT p.*, s.liq_tpd AS y_true FROM p JOIN s ON p.key = s.key AND p.date = s.date""",
    "rates horizon",
)
def cv_own_windows(spark, sf):
    df = _to_peak(spark, sf)
    made = B.exponential(df, B.own_cutoffs(df, windows=4, step=2), "liq_tpd")
    return made.join(df.select("key", "date", F.col("liq_tpd").alias("y_true")), ["key", "date"])


# Ensembles.


def _blend_sql(weights: str) -> str:
    return f"SELECT s.cutoff, s.key, step, date, any_value(y_true) AS y_true, greatest(sum(weight * y_pred) / sum(weight), 0) AS y_pred FROM scored s JOIN ({weights}) w ON s.cutoff = w.cutoff AND s.model = w.model GROUP BY 1, 2, 3, 4"


_TOP2 = "SELECT cutoff, model, 0.5 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY round(wape, 12), model) AS r FROM trainw) WHERE r <= 2"
_INV = "SELECT cutoff, model, (1 / (wape * wape)) / sum(1 / (wape * wape)) OVER (PARTITION BY cutoff) AS weight FROM trainw"


@query("cutoff key step:i date y_true:4 y_pred:4", _blend_sql(_TOP2), "scored trainw")
def ens_mean_top2(spark, sf):
    m = matrix(spark, sf)
    return E.blend(m, MODELS, E.weights_top2(E.train_wape(m, MODELS)))


@query("cutoff key step:i date y_true:4 y_pred:4", _blend_sql(_INV), "scored trainw")
def ens_inv_wape(spark, sf):
    m = matrix(spark, sf)
    return E.blend(m, MODELS, E.weights_inverse(E.train_wape(m, MODELS)))


_FORWARD = {"exp24": 0.2, "naive": 0.5, "absent": 0.3}


@query(
    "key step:i date y:4 q10:4 q90:4",
    """SELECT b.key, b.step, b.date, b.y, b.y * r.lo AS q10, b.y * r.hi AS q90 FROM (SELECT key, step, date, (0.2 * exp24 + 0.5 * naive) / 0.7 AS y FROM matrix WHERE cutoff = DATE '2001-04-01') b
      JOIN (SELECT step, quantile_cont(y_true / naive, 0.1) AS lo, quantile_cont(y_true / naive, 0.9) AS hi FROM matrix WHERE naive > 0 GROUP BY 1) r ON b.step = r.step""",
    "matrix",
)
def ens_forward_blend(spark, sf):
    m = matrix(spark, sf)
    weights = spark.createDataFrame(list(_FORWARD.items()), "model string, weight double")
    now = E.blend(m.where(F.col("cutoff") == F.lit(CUTOFFS[-1])), MODELS, weights, on=())
    ratio = m.where("naive > 0").select("step", (F.col("y_true") / F.col("naive")).alias("ratio"))
    spread = quantiles(ratio, ["step"], "ratio", [0.1, 0.9], out="r")
    return now.join(spread, "step").select("key", "step", "date", F.col("y_pred").alias("y"), (F.col("y_pred") * F.col("r")[0]).alias("q10"), (F.col("y_pred") * F.col("r")[1]).alias("q90"))


#: The three models in SQL, the pairs of their Gram sums, and the columns of these sums.
_E, _PAIRS = ["e", "m", "n"], ["ee", "em", "en", "mm", "mn", "nn"]
_VALUES = dict(zip(_E, MODELS, strict=True)) | {"y": "y_true"}
_SUMS = [*_PAIRS, *(a + "y" for a in _E)]


def _grams_sql(by: str) -> str:
    return f"SELECT {by}, " + ", ".join(f"sum({_VALUES[k[0]]} * {_VALUES[k[1]]}) AS {k}" for k in _SUMS) + f" FROM matrix GROUP BY {by}"


def _nnls_sql(step: str = "") -> str:
    """Weights for a cutoff from the Gram sums of the others."""
    over = f"OVER (PARTITION BY {step.strip(', ')})" if step else "OVER ()"
    rest = f"SELECT cutoff{step}, " + ", ".join(f"sum({k}) {over} - {k} AS {k}" for k in _SUMS) + f" FROM ({_grams_sql('cutoff' + step)})"
    shown = " UNION ALL ".join(f"SELECT cutoff{step}, '{m}' AS model, w{k} AS weight FROM solved" for k, m in enumerate(MODELS))
    return f"WITH solved AS ({_solved_sql(rest, 'cutoff' + step)}) {shown}"


def _solved_sql(rest: str, by: str) -> str:
    """Non-negative weights of the three models by their active sets: of all subsets' least squares the best one without a negative weight."""
    names = _E
    g = lambda a, b: min(a, b) + max(a, b)
    sets = [("0", "0", "0")]
    for i, a in enumerate(names):
        sets.append(tuple(f"{a}y / {g(a, a)}" if k == i else "0" for k in range(3)))
    for i in range(3):
        a, b = (names[k] for k in range(3) if k != i)
        det = f"({g(a, a)} * {g(b, b)} - {g(a, b)} * {g(a, b)})"
        solved = {a: f"({a}y * {g(b, b)} - {b}y * {g(a, b)}) / {det}", b: f"({b}y * {g(a, a)} - {a}y * {g(a, b)}) / {det}"}
        sets.append(tuple(solved.get(x, "0") for x in names))

    def det3(m: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (p, q, r) = m
        return f"({a} * ({e} * {r} - {f} * {q}) - {b} * ({d} * {r} - {f} * {p}) + {c} * ({d} * {q} - {e} * {p}))"

    gram = [[g(a, b) for b in names] for a in names]
    sets.append(tuple(f"{det3([[f'{names[i]}y' if j == k else gram[i][j] for j in range(3)] for i in range(3)])} / {det3(gram)}" for k in range(3)))
    every = " UNION ALL ".join(f"SELECT *, {x} AS w0, {y} AS w1, {z} AS w2 FROM rest" for x, y, z in sets)
    gain = "2 * (w0 * ey + w1 * my + w2 * ny) - (w0 * w0 * ee + w1 * w1 * mm + w2 * w2 * nn + 2 * (w0 * w1 * em + w0 * w2 * en + w1 * w2 * mn))"
    best = f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {gain} DESC) AS r FROM ({every}) WHERE w0 >= 0 AND w1 >= 0 AND w2 >= 0"
    shown = ", ".join(f"CASE WHEN w0 + w1 + w2 > 0 THEN w{k} / (w0 + w1 + w2) ELSE 1 / 3.0 END AS w{k}" for k in range(3))
    return f"WITH rest AS ({rest}), best AS ({best}) SELECT {by}, {shown} FROM best WHERE r = 1"


@query("cutoff model weight:6", _nnls_sql(), "matrix")
def ens_nnls(spark, sf):
    return E.weights_nnls(matrix(spark, sf), MODELS)


@query("cutoff step:i model weight:6", _nnls_sql(", step"), "matrix")
def ens_nnls_step(spark, sf):
    return E.weights_nnls(matrix(spark, sf), MODELS, ("step",))


def _filled_sql(k: int) -> str:
    """Tables ``bag`` and ``filled`` from ``grouped`` (cutoff, key, rows of y and p0, p1...): each round takes the model that lowers the sum of absolute errors most, 30 rounds at most."""
    every = range(k)
    total = lambda j: " + ".join(f"(c{i} + {int(i == j)}) * r.p{i}" for i in every)
    errors = ", ".join(f"list_sum(list_transform(rows, lambda r: abs(({total(j)}) / (size + 1) - r.y))) AS e{j}" for j in every)
    least = f"least({', '.join(f'e{j}' for j in every)})"
    first = " ".join(f"WHEN e{j} THEN {j}" for j in every)
    return f"""bag AS (
        SELECT cutoff, key, 0 AS size, {", ".join(f"0.0::DOUBLE AS c{i}" for i in every)}, 'inf'::DOUBLE AS error FROM grouped
        UNION ALL SELECT cutoff, key, size + 1, {", ".join(f"c{i} + (j = {i})::INT" for i in every)}, best
        FROM (SELECT *, {least} AS best, CASE {least} {first} END AS j FROM (SELECT bag.*, {errors} FROM bag JOIN grouped USING (cutoff, key) WHERE size < 30))
        WHERE error - best > 1e-12
      ), filled AS (SELECT cutoff, key, unnest(max_by({{'size': size, {", ".join(f"'c{i}': c{i}" for i in every)}}}, size)) FROM bag GROUP BY 1, 2)"""


def _bag_sql() -> str:
    """Bags of the three models from a key's rows at the other cutoffs."""
    common = ", ".join(f"max(weight) FILTER (model = '{m}') AS w{i}" for i, m in enumerate(MODELS))
    w = [f"coalesce(b.c{i} / b.size, k.w{i})" for i in range(3)]
    return f"""WITH RECURSIVE grouped AS (
        SELECT x.cutoff, key, list({{'y': y_true, 'p0': exp24, 'p1': mean3, 'p2': naive}} ORDER BY y_true, exp24, mean3, naive) AS rows
        FROM ext x JOIN matrix m ON m.cutoff <> x.cutoff GROUP BY 1, 2 HAVING count(*) >= 12
      ), {_filled_sql(3)},
      common AS (SELECT cutoff, {common} FROM ({_nnls_sql()}) GROUP BY 1)
      SELECT m.cutoff, m.key, step, date, y_true, greatest({w[0]} * exp24 + {w[1]} * mean3 + {w[2]} * naive, 0) AS y_pred
      FROM matrix m JOIN common k ON m.cutoff = k.cutoff LEFT JOIN filled b ON m.cutoff = b.cutoff AND m.key = b.key"""


def greedy_step_sql() -> str:
    """Bags of the models and of their blend per step, whose weights for a row leave out its own cutoff and the test's."""
    less = ", ".join(f"c.all_{k} - c.{k} - CASE WHEN c.cutoff = t.cutoff THEN 0 ELSE t.{k} END AS {k}" for k in _SUMS)
    sums = ", ".join(f"sum({k}) OVER (PARTITION BY step) AS all_{k}" for k in _SUMS)
    rest = f"SELECT t.cutoff AS test, c.cutoff, c.step, {less} FROM sums c JOIN sums t ON c.step = t.step"
    w = [f"b.c{i} / b.size" for i in range(4)]
    return f"""WITH RECURSIVE sums AS (SELECT *, {sums} FROM ({_grams_sql("cutoff, step")})),
      blended AS (SELECT m.*, test, greatest(w0 * exp24 + w1 * mean3 + w2 * naive, 0) AS blend FROM matrix m JOIN ({_solved_sql(rest, "test, cutoff, step")}) s ON m.cutoff = s.cutoff AND m.step = s.step),
      grouped AS (
        SELECT test AS cutoff, key, list({{'y': y_true, 'p0': exp24, 'p1': mean3, 'p2': naive, 'p3': blend}} ORDER BY y_true, exp24, mean3, naive, blend) AS rows
        FROM blended WHERE cutoff <> test GROUP BY 1, 2 HAVING count(*) >= 12
      ), {_filled_sql(4)}
      SELECT m.cutoff, m.key, step, date, y_true, greatest(coalesce({w[0]} * exp24 + {w[1]} * mean3 + {w[2]} * naive + {w[3]} * blend, blend), 0) AS y_pred
      FROM blended m LEFT JOIN filled b ON m.cutoff = b.cutoff AND m.key = b.key WHERE m.cutoff = test"""


@query("cutoff key step:i date y_true:4 y_pred:4", _bag_sql(), "matrix ext")
def ens_greedy_well(spark, sf):
    m = matrix(spark, sf)
    return E.blend(m, MODELS, E.weights_greedy(m, MODELS, EXTENDED), on=("cutoff", "key"))


# Calibration.

_RATIO = "least(CASE WHEN y_true >= q50 THEN (y_true - q50) / greatest(q90 - q50, 1e-9) ELSE (q50 - y_true) / greatest(q50 - q10, 1e-9) END, 1e6)"
FRAGMENTS["scales"] = f"SELECT fold, step, count(*) AS n_calib, list_sort(list({_RATIO}))[CAST(floor(((count(*) - 1) * 8 + 9) / 10) AS INT) + 1] AS scale FROM calib GROUP BY 1, 2"


@query("fold step:i n_calib:i scale:6", "SELECT * FROM scales", "scales")
def cal_multiplicative(spark, sf):
    return K.multiplicative(intervals(spark, sf))


@query(
    "fold n_calib:i coverage_before:8 coverage_after:8",
    f"SELECT s.fold, min(n_calib) AS n_calib, avg(CASE WHEN y_true BETWEEN q10 AND q90 THEN 1.0 ELSE 0 END) AS coverage_before, avg(CASE WHEN {_RATIO} <= scale THEN 1.0 ELSE 0 END) AS coverage_after FROM intervals i JOIN scales s ON i.cutoff = s.fold AND i.step = s.step GROUP BY 1",
    "intervals scales",
)
def cal_multiplicative_coverage(spark, sf):
    return K.multiplicative_coverage(intervals(spark, sf))


@query("step:i n:i lo:8 hi:8 upper:8", "SELECT step, count(*) AS n, quantile_cont(y_true / y_pred, 0.1) AS lo, quantile_cont(y_true / y_pred, 0.9) AS hi, list_sort(list(y_true / y_pred))[CAST(floor(((count(*) - 1) * 8 + 9) / 10) AS INT) + 1] AS upper FROM intervals WHERE y_pred > 0 GROUP BY 1", "intervals")
def ratio_quantiles(spark, sf):
    r = F.col("y_true") / F.col("y_pred")
    rows = intervals(spark, sf).where("y_pred > 0").select("step", r.alias("r"))
    upper = order_statistic(rows, ["step"], "r", upper_rank(8, 10), 0.8, out="upper").drop("n")
    ends = quantiles(rows, ["step"], "r", [0.1, 0.9])
    return ends.select("step", "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")).join(upper, "step")


def _conformal_sql(method: str) -> str:
    scaled = method.startswith("norm")
    bins = {"split": "'all'", "norm_pred": "'all'", "mond_step": "CAST(step AS VARCHAR)", "norm_x_step": "CAST(step AS VARCHAR)"}.get(
        method, "CAST(step AS VARCHAR) || '|' || CASE WHEN min(nb) OVER (PARTITION BY fold, block) >= 30 THEN block ELSE 'other' END"
    )
    sigma = "abs(y_pred) + 0.05 * mean" if scaled else "1.0"
    return f"""WITH c AS (SELECT *, {bins} AS bin FROM (SELECT *, count(*) OVER (PARTITION BY fold, step, block) AS nb, avg(abs(y_pred)) OVER (PARTITION BY fold) AS mean FROM calib)),
      r AS (SELECT fold, bin, a, row_number() OVER (PARTITION BY fold, bin ORDER BY a) AS r, count(*) OVER (PARTITION BY fold, bin) AS n FROM (SELECT *, abs(y_true - y_pred) / ({sigma}) AS a FROM c)),
      h AS (SELECT fold, bin, a AS half FROM r WHERE r = floor(((n + 1) * 8 + 9) / 10)),
      o AS (SELECT i.*, b.bin, m.mean FROM intervals i JOIN (SELECT DISTINCT fold, step, block, bin FROM c) b ON i.cutoff = b.fold AND i.step = b.step AND i.block = b.block
        JOIN (SELECT fold, avg(abs(y_pred)) AS mean FROM calib GROUP BY 1) m ON i.cutoff = m.fold)
      SELECT '{method}' AS method, o.cutoff, o.key, o.step, o.y_true, o.y_pred, greatest(o.y_pred - half * ({sigma}), 0) AS q10, o.y_pred + half * ({sigma}) AS q90 FROM o LEFT JOIN h ON o.cutoff = h.fold AND o.bin = h.bin"""


def _conformal(method: str):
    def run(spark, sf):
        rows = intervals(spark, sf).drop("q10", "q90", "q50")
        return K.conformal(rows, method)

    run.__name__ = f"conf_{method}"
    return query("cutoff key step:i q10:3 q90:3", _conformal_sql(method), "calib intervals")(run)


for _m in K.METHODS:
    _conformal(_m)


@query(
    "method coverage:8 width:8",
    "SELECT method, coverage, width FROM (SELECT method, avg(CASE WHEN y_true BETWEEN q10 AND q90 THEN 1.0 ELSE 0 END) AS coverage, avg(q90 - q10) / avg(y_true) AS width FROM ("
    + " UNION ALL ".join(f"SELECT * FROM ({_conformal_sql(m)})" for m in K.METHODS)
    + ") GROUP BY 1) ORDER BY CASE WHEN coverage >= 0.78 THEN 0 ELSE 1 END, CASE WHEN coverage >= 0.78 THEN width ELSE -coverage END, abs(coverage - 0.8), method LIMIT 1",
    "calib intervals",
)
def conf_best_method(spark, sf):
    rows = intervals(spark, sf).drop("q10", "q90", "q50")
    parts = [K.conformal(rows, m).agg(M.coverage("y_true", "q10", "q90").alias("coverage"), M.relative_width("y_true", "q10", "q90").alias("width")).withColumn("method", F.lit(m)) for m in K.METHODS]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return K.pick(every)


# Diagnostics.


@query("r:8 n:i", "SELECT corr(a, b) AS r, count(*) AS n FROM errors2", "errors2")
def corr_pearson(spark, sf):
    return _errors2(spark, sf).agg(F.corr("a", "b").alias("r"), F.count("*").alias("n"))


@query("r:8", "SELECT corr(least(greatest(a, la), ha), least(greatest(b, lb), hb)) AS r FROM errors2, (SELECT quantile_cont(a, 0.01) AS la, quantile_cont(a, 0.99) AS ha, quantile_cont(b, 0.01) AS lb, quantile_cont(b, 0.99) AS hb FROM errors2)", "errors2")
def corr_winsor(spark, sf):
    return D.winsorised(_errors2(spark, sf), "a", "b").agg(F.corr("a", "b").alias("r"))


@query("key rho:8 n:i", "SELECT key, corr(ra, rb) AS rho, count(*) AS n FROM (SELECT key, rank() OVER (PARTITION BY key ORDER BY a) + (count(*) OVER (PARTITION BY key, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY key ORDER BY b) + (count(*) OVER (PARTITION BY key, b) - 1) / 2.0 AS rb FROM errors2) GROUP BY 1", "errors2")
def corr_spearman_by_key(spark, sf):
    return D.spearman(_errors2(spark, sf), "a", "b", "key")


@query(
    "n1:i n2:i u:2",
    f"SELECT count(*) FILTER (same_block) AS n1, count(*) FILTER (NOT same_block) AS n2, sum(r) FILTER (same_block) - count(*) FILTER (same_block) * (count(*) FILTER (same_block) + 1) / 2.0 AS u FROM (SELECT same_block, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM (SELECT same_block, round(w, 9) AS v FROM ({_GAINS})))",
    "sites injectors",
)
def mann_whitney_u(spark, sf):
    return D.mann_whitney(_gains(spark, sf).withColumn("v", F.round("w", 9)), "v", "same_block")


@query(
    "cov_a:8 cov_b:8 cov_joint:8 cov_independent:8",
    "SELECT avg(ia) AS cov_a, avg(ib) AS cov_b, avg(ia * ib) AS cov_joint, avg(ia) * avg(ib) AS cov_independent FROM (SELECT CASE WHEN a BETWEEN la AND ha THEN 1.0 ELSE 0 END::DOUBLE AS ia, CASE WHEN b BETWEEN lb AND hb THEN 1.0 ELSE 0 END::DOUBLE AS ib FROM errors2, (SELECT quantile_cont(a, 0.1) AS la, quantile_cont(a, 0.9) AS ha, quantile_cont(b, 0.1) AS lb, quantile_cont(b, 0.9) AS hb FROM errors2))",
    "errors2",
)
def joint_coverage(spark, sf):
    return D.joint_coverage(_errors2(spark, sf), "a", "b")


@query("key date detrended:4", "SELECT key, date, liq_tpd - i - s * t AS detrended FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS t FROM rates) JOIN (SELECT key, regr_slope(liq_tpd, t) AS s, regr_intercept(liq_tpd, t) AS i FROM (SELECT key, liq_tpd, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS t FROM rates) GROUP BY 1) USING (key)", "rates")
def detrend(spark, sf):
    return P.detrend(rates(spark, sf), "liq_tpd")


@query("key rho:8", "SELECT key, corr(a, b) AS rho FROM errors2 GROUP BY 1 ORDER BY abs(round(corr(a, b), 10)) DESC, key LIMIT 5", "errors2")
def topk_abs(spark, sf):
    """A top-5 report: the limit is the feature."""
    return _errors2(spark, sf).groupBy("key").agg(F.corr("a", "b").alias("rho")).orderBy(F.desc(F.abs(F.round("rho", 10))), "key").limit(5)


def _poly_sql(k: tuple[float, ...], x: str) -> str:
    made = repr(k[0])
    for v in k[1:]:
        made = f"({made} * ({x}) + {v!r})"
    return made


def _probit_sql(p: str) -> str:
    a, b, c, d = PROBIT
    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    return f"""CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {PROBIT_TAIL} THEN {_poly_sql(c, low)} / {_poly_sql(d, low)}
      WHEN {p} > 1 - {PROBIT_TAIL} THEN -{_poly_sql(c, high)} / {_poly_sql(d, high)} ELSE {_poly_sql(a, f"{q} * {q}")} * {q} / {_poly_sql(b, f"{q} * {q}")} END"""


FRAGMENTS["scores2"] = f"""SELECT key, cutoff, step, {_probit_sql("pa")} AS za, {_probit_sql("pb")} AS zb FROM (
  SELECT *, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / (count(*) OVER () + 1) AS pa,
    (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / (count(*) OVER () + 1) AS pb FROM errors2)"""
_Z = 1.2815515655446004
_DENSITY = f"(2 * exp(-({_Z} * {_Z}) / (1 + rho * i / 200.0)) - 2 * exp(-({_Z} * {_Z}) / (1 - rho * i / 200.0))) / (2 * pi() * sqrt(1 - (rho * i / 200.0) * (rho * i / 200.0)))"


@query("key cutoff step:i z:6", "SELECT key, cutoff, step, za AS z FROM scores2", "scores2")
def normal_scores(spark, sf):
    return D.normal_scores(_errors2(spark, sf), "a")


@query(
    "rho:6 p:6",
    f"SELECT rho, 0.64 + rho / 200 / 3 * sum(CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {_DENSITY}) AS p FROM (SELECT corr(za, zb) AS rho FROM scores2), (SELECT unnest(range(0, 201)) AS i) GROUP BY rho",
    "scores2",
)
def copula_rectangle(spark, sf):
    z = D.normal_scores(D.normal_scores(_errors2(spark, sf), "a", out="za"), "b", out="zb")
    return z.agg(F.corr("za", "zb").alias("rho")).withColumn("p", D.rectangle(F.col("rho")))


@query("inj n:i same_share:8 w_max:8", f"SELECT inj, count(*) AS n, avg(CAST(same_block AS INT)) AS same_share, max(w) AS w_max FROM ({_GAINS}) GROUP BY 1 HAVING bool_or(same_block AND w > 0.4)", "sites injectors")
def analyze_pairs(spark, sf):
    g = _gains(spark, sf).groupBy("inj").agg(F.count("*").alias("n"), F.avg(F.col("same_block").cast("int")).alias("same_share"), F.max("w").alias("w_max"), F.bool_or(F.col("same_block") & (F.col("w") > 0.4)).alias("keep"))
    return g.where("keep")


@query("key rank:8", "SELECT key, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rank FROM (SELECT key, round(perm, -2) AS v FROM sites)", "sites")
def average_ranks(spark, sf):
    return S.sites(spark, sf).withColumn("v", F.round("perm", -2)).transform(averaged_rank, "v", "rank").select("key", "rank")


# Learning frames.


@query(
    "unique_id ds y:4 inj_alloc:4 inj_block:2 crm:4 pres_lag6:6",
    """SELECT c.key AS unique_id, c.date AS ds, c.liq_tpd AS y, coalesce(a.alloc, 0) AS inj_alloc, coalesce(b.inj_block, 0) AS inj_block, s.v AS crm, lag(c.p_res, 6) OVER (PARTITION BY c.key ORDER BY c.date) AS pres_lag6
      FROM complete c LEFT JOIN alloc a ON c.key = a.key AND c.date = a.date LEFT JOIN (SELECT block, date, sum(winj_m3) AS inj_block FROM injection GROUP BY 1, 2) b ON c.block = b.block AND c.date = b.date
      LEFT JOIN (SELECT key, date, min_by(y_pred, cutoff) AS v FROM forecasts WHERE model = 'naive' GROUP BY 1, 2) s ON c.key = s.key AND c.date = s.date""",
    "complete alloc injection forecasts",
)
def learning_frame(spark, sf):
    return _frame(spark, sf)


def _frame(spark, sf):
    inj, where = S.injection(spark, sf), S.sites(spark, sf)
    df = P.lags(complete(spark, sf), "p_res", (6,), ()).withColumnRenamed("lag6", "pres_lag6")
    spliced = B.splice(forecasts(spark, sf).where("model = 'naive'").withColumnRenamed("y_pred", "crm"), "crm")
    df = df.join(A.allocate(inj, hydro(spark, sf), out="inj_alloc"), ["key", "date"], "left").join(A.block_sums(inj, where), ["key", "date"], "left").join(spliced, ["key", "date"], "left")
    return df.select(F.col("key").alias("unique_id"), F.col("date").alias("ds"), F.col("liq_tpd").alias("y"), F.coalesce("inj_alloc", F.lit(0.0)).alias("inj_alloc"), F.coalesce("inj_block", F.lit(0.0)).alias("inj_block"), "crm", "pres_lag6", "block")


@query(
    "cutoff key wct_last:8 age_m:i block_code:i",
    """SELECT cutoff, r.key, coalesce(max_by(least(greatest(wct, 0), 1), date) FILTER (wct IS NOT NULL), 0) AS wct_last, count(liq_tpd) AS age_m, any_value(code) AS block_code FROM rates r JOIN ext ON date <= cutoff
      JOIN (SELECT key, dense_rank() OVER (ORDER BY block) - 1 AS code FROM sites) s ON r.key = s.key GROUP BY 1, 2""",
    "rates ext sites",
)
def meta_features(spark, sf):
    codes = P.category_codes(S.sites(spark, sf), "block").select("key", F.col("code").alias("block_code"))
    last = F.max_by(F.least(F.greatest("wct", F.lit(0.0)), F.lit(1.0)), F.when(F.col("wct").isNotNull(), F.col("date")))
    at = B.contexts(rates(spark, sf), EXTENDED).groupBy("cutoff", "key").agg(F.coalesce(last, F.lit(0.0)).alias("wct_last"), F.count("liq_tpd").alias("age_m"))
    return at.join(codes, "key")


@query(
    "key step:i date inj_alloc:4 pres:6",
    """SELECT k.key, step, CAST(DATE '2001-04-01' + to_months(CAST(step AS INT)) AS DATE) AS date, coalesce(p.alloc, 0) AS inj_alloc, l.p_res AS pres FROM (SELECT DISTINCT key FROM rates WHERE date <= DATE '2001-04-01') k CROSS JOIN horizon
      LEFT JOIN (SELECT key, sum(w * v) AS alloc FROM (SELECT inj, max_by(winj_m3, date) AS v FROM injection WHERE date <= DATE '2001-04-01' GROUP BY 1) JOIN hydro USING (inj) GROUP BY 1) p ON k.key = p.key
      LEFT JOIN rates l ON k.key = l.key AND l.date = CAST(DATE '2001-04-01' + to_months(CAST(step AS INT)) - INTERVAL 6 MONTH AS DATE)""",
    "rates horizon injection hydro",
)
def known_future_frame(spark, sf):
    last, df = CUTOFFS[-1], rates(spark, sf)
    plan = A.allocate(P.carry_forward(S.injection(spark, sf), "winj_m3", C.HORIZON, last, key="inj"), hydro(spark, sf), out="inj_alloc")
    keys = df.where(F.col("date") <= F.lit(last)).select("key").distinct().withColumn("cutoff", F.lit(last))
    lagged = df.select("key", F.add_months("date", 6).alias("date"), F.col("p_res").alias("pres"))
    return C.expand_horizon(keys).join(plan, ["key", "date"], "left").join(lagged, ["key", "date"], "left").withColumn("inj_alloc", F.coalesce("inj_alloc", F.lit(0.0)))


# Streaming notions, in batch form.


@query("event_type day n:i value:4", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS value FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    from ..streaming.events import daily

    return daily(S.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("day", F.to_date("window.start"))


@query(
    "event_type day n:i value:4 low:4 high:4",
    """SELECT event_type, CAST(day - to_days(CAST(i AS INT)) AS DATE) AS day, sum(n) AS n, sum(value) AS value, min(low) AS low, max(high) AS high
      FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS value, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2) CROSS JOIN (SELECT unnest(range(0, 7)) AS i) GROUP BY 1, 2""",
)
def events_sliding(spark, sf):
    from ..streaming.events import sliding

    return sliding(S.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("day", F.to_date("window.start"))


@query("user_id:i sessions:i events:i", "SELECT user_id, sum(new_) AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new_ FROM events) GROUP BY 1")
def events_session(spark, sf):
    from ..streaming.events import sessions

    s = sessions(S.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of two backtested forecasters, by cutoff and over all."""
    parts = [M.summarize(backtest(spark, sf, m)).withColumn("model", F.lit(m)) for m in ("naive", "exp24")]
    return parts[0].unionByName(parts[1])


_ = Window
