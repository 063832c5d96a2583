"""The queries of fitted, learned and iterative operators. Those that SQL can express carry their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as A
from ..operators import backtest as B
from ..operators import decline
from ..operators import exchange as X
from ..operators import learning as L
from ..operators import panel as P
from ..operators import response as R
from ..operators import signals as N
from ..sources import tables as S
from ..sources.shared import held, once
from ..streaming import prefix as T
from . import catalogue as K
from .registry import query

#: The recursion's time constant, in days.
TAU = 90.0


# Decline and response.


_ARPS = """WITH RECURSIVE v AS (
      SELECT cutoff, key, list(greatest(v, 1e-6) ORDER BY date) AS vs FROM (
        SELECT cutoff, key, date, liq_tpd AS v, row_number() OVER (PARTITION BY cutoff, key ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY cutoff, key) AS n_all
        FROM rates JOIN canon ON date <= cutoff WHERE liq_tpd IS NOT NULL) WHERE r <= 36 AND n_all >= 12 GROUP BY 1, 2),
    y AS (SELECT *, list_sum(list_transform(vs, lambda x: x * x)) AS top, list_max(vs) AS most FROM v),
    s AS (
      SELECT cutoff, key, 0 AS round, ln(0.02) AS log_d, 0.5::DOUBLE AS b, ln(0.02) AS old_d, 0.5::DOUBLE AS old_b, 1e-3::DOUBLE AS damping, {'loss': NULL::DOUBLE, 'q': NULL::DOUBLE, 'aa': NULL::DOUBLE, 'ab': NULL::DOUBLE, 'bb': NULL::DOUBLE, 'ga': NULL::DOUBLE, 'gb': NULL::DOUBLE} AS n FROM y
      UNION ALL
      SELECT cutoff, key, round + 1, least(greatest(kept_d + greatest(least(CASE WHEN det > 0 THEN (ga * bb - gb * ab) / det ELSE 0 END, 1), -1), -11.512925464970229), 0),
        least(greatest(kept_b + greatest(least(CASE WHEN det > 0 THEN (gb * aa - ga * ab) / det ELSE 0 END, 0.5), -0.5), 0.01), 2), kept_d, kept_b, damping, m
      FROM (SELECT *, aa * bb - ab * ab AS det FROM (
        SELECT *, CASE WHEN free_d THEN m.aa * (1 + damping) ELSE 1 END AS aa, CASE WHEN free_b THEN m.bb * (1 + damping) ELSE 1 END AS bb, CASE WHEN free_d AND free_b THEN m.ab ELSE 0 END AS ab,
          CASE WHEN free_d THEN m.ga ELSE 0 END AS ga, CASE WHEN free_b THEN m.gb ELSE 0 END AS gb FROM (
          SELECT *, NOT ((kept_d <= -11.512925464970229 AND m.ga < 0) OR (kept_d >= 0 AND m.ga > 0)) AS free_d, NOT ((kept_b <= 0.01 AND m.gb < 0) OR (kept_b >= 2 AND m.gb > 0)) AS free_b FROM (
            SELECT cutoff, key, round, CASE WHEN better THEN log_d ELSE old_d END AS kept_d, CASE WHEN better THEN b ELSE old_b END AS kept_b,
              CASE WHEN n.loss IS NULL THEN damping WHEN better THEN damping / 3.0 ELSE damping * 4.0 END AS damping, CASE WHEN better THEN made ELSE n END AS m FROM (
              SELECT *, n.loss IS NULL OR made.loss < n.loss - 1e-12 AS better FROM (
                SELECT *, {'loss': (top - 2 * q * vf + q * q * ff) / top, 'q': q, 'aa': q * q * (dd - fd * fd / ff), 'ab': q * q * (db - fd * fb / ff), 'bb': q * q * (b2 - fb * fb / ff), 'ga': q * (vd - vf * fd / ff), 'gb': q * (vb - vf * fb / ff)} AS made FROM (
                  SELECT *, least(greatest(vf / ff, 1e-6), 10 * most) AS q FROM (
                    SELECT s.*, any_value(top) AS top, any_value(most) AS most, sum(v * f) AS vf, sum(f * f) AS ff, sum(f * p) AS fd, sum(f * r) AS fb, sum(p * p) AS dd, sum(p * r) AS db, sum(r * r) AS b2, sum(v * p) AS vd, sum(v * r) AS vb FROM (
                      SELECT s, top, most, v, f, -f * dt / (1 + s.b * dt) AS p, f * (ln(1 + s.b * dt) / s.b - dt / (1 + s.b * dt)) / s.b AS r FROM (
                        SELECT *, exp(-ln(1 + s.b * dt) / s.b) AS f FROM (
                          SELECT s, top, most, unnest(vs) AS v, exp(s.log_d) * unnest(range(0, len(vs))) AS dt FROM s JOIN y ON s.cutoff = y.cutoff AND s.key = y.key WHERE s.round < 26))) GROUP BY s))))))))
    )
    SELECT s.cutoff, s.key, step, CAST(s.cutoff + to_months(CAST(step AS INT)) AS DATE) AS date, n.q * exp(-ln(1 + old_b * exp(old_d) * (len(vs) - 1 + step)) / old_b) AS y_pred
    FROM s JOIN y ON s.cutoff = y.cutoff AND s.key = y.key CROSS JOIN horizon WHERE round = 26"""


@query("cutoff key step:i date y_pred:2", _ARPS, "rates canon horizon")
def fc_arps(spark, sf):
    return decline.arps(K.rates(spark, sf), K.CUTOFFS, "liq_tpd")


@query(
    "key date q:4",
    f"""SELECT b.key, b.date, sum((1 - exp(-a.d / {TAU})) * coalesce(a.alloc, 0) * exp(-(b.t - a.t) / {TAU})) AS q
      FROM (SELECT *, day(last_day(date)) AS d, sum(day(last_day(date))) OVER (PARTITION BY key ORDER BY date) AS t FROM alloc) a
      JOIN (SELECT *, sum(day(last_day(date))) OVER (PARTITION BY key ORDER BY date) AS t FROM alloc) b ON a.key = b.key AND a.date <= b.date GROUP BY 1, 2""",
    "alloc",
)
def crm_recursion_fixed(spark, sf):
    return R.recursion(A.allocate(S.injection(spark, sf), K.hydro(spark, sf)), TAU)


# Learned models.


#: What the forecasters know ahead of a month beside the series' past, and of a series at any time.
KNOWN = ["inj_alloc", "inj_block", "crm", "pres_lag6", "perm", "block_code"]


def _learning(spark, sf):
    """The learning frame with the series' own properties, made once in an application."""

    def make():
        sites = P.category_codes(S.sites(spark, sf), "block").select("key", "perm", F.col("code").alias("block_code"))
        frame = K._frame(spark, sf).select(F.col("unique_id").alias("key"), F.col("ds").alias("date"), F.col("y").alias("liq_tpd"), *KNOWN[:4])
        return frame.join(sites, "key", "left")

    return held(spark, "learning", sf, make)


def _trees(spark, sf):
    """The field's forecasters, one for each cutoff, trained once in an application."""
    return once(spark, "gbt", sf, lambda: L.train(_learning(spark, sf), "liq_tpd", K.CUTOFFS, KNOWN))


@query("cutoff key step:i date y_pred:2")
def gbt_backtest(spark, sf):
    return L.backtest(_learning(spark, sf), "liq_tpd", _trees(spark, sf), KNOWN)


@query("feature share:4")
def gbt_importance(spark, sf):
    return spark.createDataFrame(L.importance(_trees(spark, sf)[K.CUTOFFS[-1]], [*L.FEATURES, *KNOWN]), "feature string, share double")


@query("cutoff key step:i date y_true:4 y_pred:2")
def ens_gbt_meta(spark, sf):
    from .registry import QUERIES

    features = QUERIES["meta_features"](spark, sf).withColumn("cutoff", F.to_date("cutoff"))
    m = K.matrix(spark, sf)
    return L.meta(m, K.MODELS, features, K.CUTOFFS)


@query("cutoff key step:i date y_true:4 y_pred:4", K.greedy_step_sql(), "matrix")
def ens_greedy_step(spark, sf):
    return L.greedy_step(K.matrix(spark, sf), K.MODELS)


# Signals.


@query("inj key same_block n:i reliable coherence:6 p:6")
def coherence_pairs(spark, sf):
    return N.coherence(S.injection(spark, sf), K.rates(spark, sf), K.CUTOFFS[-1])


def _points(spark, sf):
    return N.change_points(A.allocate(S.injection(spark, sf), K.hydro(spark, sf)), "alloc")


@query("key date cp_months:i cp_jump:4")
def changepoint_features(spark, sf):
    return _points(spark, sf)


@query("key step:i date cp_months:i cp_jump:4")
def changepoint_frozen(spark, sf):
    return N.frozen(_points(spark, sf), K.CUTOFFS[-1], K.C.HORIZON)


def _prefix_sql(rows: str) -> str:
    """The prefix features (key, t, n, mean, since, jump) of rows (key, t, x)."""
    return f"""SELECT key, t, n, mean, n - coalesce(last_value(hit IGNORE NULLS) OVER w, 0) AS since, coalesce(last_value(size IGNORE NULLS) OVER w, 0) AS jump FROM (
        SELECT key, t, n, (coalesce(total, 0) + x) / n AS mean, CASE WHEN deviates THEN n END AS hit, CASE WHEN deviates THEN 100 * (x - m) / greatest(abs(m), 1e-9) END AS size FROM (
          SELECT *, n > {T.LEAST} AND abs(x - m) > {T.WIDTH} * sqrt(greatest(squares / (n - 1) - m * m, 0)) + {T.SLACK} * abs(m) AS deviates FROM (
            SELECT *, total / (n - 1) AS m FROM (
              SELECT key, t, x, row_number() OVER (PARTITION BY key ORDER BY t) AS n, sum(x) OVER b AS total, sum(x * x) OVER b AS squares FROM ({rows}) WHERE x IS NOT NULL
              WINDOW b AS (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))))
      WINDOW w AS (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING)"""


_RATE_PREFIX = _prefix_sql("SELECT key, date AS t, liq_tpd AS x FROM rates")


@query("key date n:i mean:4 since:i jump:4", f"SELECT key, t AS date, n, mean, since, jump FROM ({_RATE_PREFIX})", "rates")
def prefix_features(spark, sf):
    return T.features(K.rates(spark, sf), "key", "date", "liq_tpd")


@query(
    "key step:i date cp_months:i cp_jump:4",
    f"""SELECT key, step, CAST(t + to_months(CAST(step AS INT)) AS DATE) AS date, since + step AS cp_months, jump AS cp_jump
      FROM ({_RATE_PREFIX}) CROSS JOIN horizon WHERE t = (SELECT max(cutoff) FROM canon)""",
    "rates horizon canon",
)
def prefix_frozen(spark, sf):
    made = T.features(K.rates(spark, sf), "key", "date", "liq_tpd")
    return N.frozen(made.select("key", "date", F.col("since").alias("cp_months"), F.col("jump").alias("cp_jump")), K.CUTOFFS[-1], K.C.HORIZON)


@query(
    "model n:i log10_max:6 log10_last:6",
    """WITH RECURSIVE r AS (SELECT model, cutoff, key, step, round(abs(y_true - y_pred), 6) AS a, md5(key || '|' || step || '|' || CAST(cutoff AS VARCHAR)) AS h FROM scored),
      t AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY cutoff, h, key, step) AS t FROM r),
      p AS (SELECT x.model, x.t, (count(*) FILTER (y.a > x.a) + ('0x' || substr(any_value(x.h), 1, 8))::BIGINT / 4294967296.0 * (count(*) FILTER (y.a = x.a) + 1)) / x.t AS p
        FROM t x LEFT JOIN t y ON x.model = y.model AND y.t < x.t GROUP BY 1, 2),
      m AS (
        SELECT DISTINCT model, 0::BIGINT AS t, 1 / 3.0::DOUBLE AS a, 1 / 3.0::DOUBLE AS b, 1 / 3.0::DOUBLE AS c, 0::DOUBLE AS scale, NULL::DOUBLE AS best FROM p
        UNION ALL
        SELECT model, t, a / s, b / s, c / s, scale + log10(s), greatest(coalesce(best, -1e9), scale + log10(s)) FROM (SELECT *, a + b + c AS s FROM (
          SELECT m.model, m.t + 1 AS t, (0.99 * a + 0.01 / 3 * (a + b + c)) * (1.5 - p) AS a, 0.99 * b + 0.01 / 3 * (a + b + c) AS b, (0.99 * c + 0.01 / 3 * (a + b + c)) * (0.5 + p) AS c, scale, best
          FROM m JOIN p ON m.model = p.model AND p.t = m.t + 1))
      ) SELECT model, max(t) AS n, max(best) AS log10_max, max_by(scale, t) AS log10_last FROM m GROUP BY 1""",
    "scored",
)
def exchangeability(spark, sf):
    return X.exchangeability(K.scored(spark, sf).withColumn("resid", F.col("y_true") - F.col("y_pred")), "model")


# Streams.


@query("event_type day n:i value:4", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS value FROM events GROUP BY 1, 2")
def events_watermark_late(spark, sf):
    """The daily counts as a stream with a watermark, run over the files there are; no event is late within one batch."""
    from ..streaming.events import run_available, stream

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    out = run_available(stream(spark, f"{sf}/events.parquet*", schema), late="2 days")  # a pattern may name one file, too
    return out.withColumn("day", F.to_date("start"))


#: How late an event may come, and the days of silence after which a user's features are frozen.
LATE, HOLD = 2, 2


@query(
    "user_id:i day n:i mean:4 since:i jump:4 frozen",
    f"""WITH days AS (SELECT user_id AS key, CAST(ts AS DATE) AS t, sum(value) AS x FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL {LATE} DAY AS DATE) FROM events) GROUP BY 1, 2),
      made AS ({_prefix_sql("SELECT * FROM days")}),
      quiet AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY key ORDER BY t), (SELECT CAST(max(ts) - INTERVAL {LATE} DAY AS DATE) FROM events)) - t > {HOLD} AS quiet FROM made)
      SELECT key AS user_id, t AS day, n, mean, since, jump, false AS frozen FROM quiet
      UNION ALL SELECT key, CAST(t + {HOLD} AS DATE), n, mean, since + {HOLD}, jump, true FROM quiet WHERE quiet""",
)
def events_prefix_state(spark, sf):
    """Each user's prefix features as a stream with state and timers, run over the files there are."""
    from ..streaming.events import stream

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return T.run_prefix(stream(spark, f"{sf}/events.parquet*", schema), f"{LATE} days", HOLD, "user_id")
