"""The queries of selections, orders, imputation and masks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as A
from ..operators import selection as X
from ..sources import tables as S
from . import catalogue as K
from .registry import query

ORDER = ["ASIA", "EUROPE", "AMERICA"]
_PLACE = "CASE block " + " ".join(f"WHEN '{b}' THEN {i + 1}" for i, b in enumerate(ORDER)) + f" ELSE {len(ORDER) + 1} END"


@query(
    "cutoff key n_history:i n_future:i",
    """SELECT cutoff, key, count(*) FILTER (date <= cutoff) AS n_history, least(count(*) FILTER (date > cutoff), 6) AS n_future FROM rates CROSS JOIN canon
      WHERE liq_tpd IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (date <= cutoff) >= 12 AND count(*) FILTER (date > cutoff) >= 6""",
    "rates canon",
)
def complete_horizon(spark, sf):
    return X.complete_horizon(K.rates(spark, sf), K.CUTOFFS, "liq_tpd")


@query(
    "cutoff key step:i date liq_tpd:4",
    "SELECT * FROM (SELECT cutoff, key, date, liq_tpd, row_number() OVER (PARTITION BY cutoff, key ORDER BY date) AS step FROM rates JOIN canon ON date > cutoff) WHERE step <= 6",
    "rates canon",
)
def future_head(spark, sf):
    return X.head(X.futures(K.rates(spark, sf).select("key", "date", "liq_tpd"), K.CUTOFFS), 6, "cutoff", "key")


_FITTED = f"SELECT cutoff, inj, key, w * month(cutoff) AS w FROM ({K._GAINS}) CROSS JOIN canon WHERE same_block"


@query("cutoff key date alloc:2", f"SELECT cutoff, key, date, sum(w * winj_m3) AS alloc FROM injection JOIN ({_FITTED}) USING (inj) GROUP BY 1, 2, 3", "injection sites injectors canon")
def allocate_by_gains(spark, sf):
    """Allocation by gains that each cutoff has of its own: stand-ins that grow with the cutoff's month."""
    cutoffs = F.explode(F.array(*(F.lit(c) for c in K.CUTOFFS))).alias("cutoff")
    edges = K._gains(spark, sf).where("same_block").select("inj", "key", "w", cutoffs).withColumn("w", F.col("w") * F.month("cutoff"))
    return A.allocate(S.injection(spark, sf), edges, by=("cutoff",))


@query(
    "key date v:4",
    "SELECT key, date, coalesce(v, max_by(v, CASE WHEN v IS NOT NULL THEN date END) OVER (PARTITION BY key)) AS v FROM (SELECT key, date, CASE WHEN month(date) % 5 <> 2 THEN liq_tpd END AS v FROM complete)",
    "complete",
)
def impute_last_observed(spark, sf):
    rows = K.complete(spark, sf).select("key", "date", F.when(F.month("date") % 5 != 2, F.col("liq_tpd")).alias("v"))
    return X.impute_last(rows, "v")


@query(
    "model wape:8 smape:8 rmse:4 cum_err_pct:6 coverage_80:8",
    """SELECT model, sum(abs(y_true - y_pred)) / sum(abs(y_true)) AS wape, avg(CASE WHEN abs(y_true) + abs(y_pred) > 0 THEN abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2) END) AS smape,
      sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, (sum(y_pred) - sum(y_true)) / sum(y_true) * 100 AS cum_err_pct, avg(CASE WHEN q10 IS NOT NULL THEN CASE WHEN y_true BETWEEN q10 AND q90 THEN 1.0 ELSE 0 END END) AS coverage_80
      FROM (SELECT model, y_true, y_pred, NULL::DOUBLE AS q10, NULL::DOUBLE AS q90 FROM scored WHERE model <> 'naive' UNION ALL SELECT 'naive', y_true, y_pred, q10, q90 FROM intervals) GROUP BY 1""",
    "scored intervals",
)
def optional_metrics(spark, sf):
    plain = K.scored(spark, sf).where("model <> 'naive'").select("model", "y_true", "y_pred")
    ranged = K.intervals(spark, sf).select(F.lit("naive").alias("model"), "y_true", "y_pred", "q10", "q90")
    return X.available_metrics(ranged.unionByName(plain, allowMissingColumns=True))


@query(
    "cutoff key step:i date model y_pred:4",
    "SELECT cutoff, key, step, date, model, y_pred FROM scored WHERE model = (SELECT model FROM (SELECT model, sum(abs(y_true - y_pred)) / sum(abs(y_true)) AS w FROM scored GROUP BY 1) ORDER BY round(w, 12), model LIMIT 1)",
    "scored",
)
def best_model_rows(spark, sf):
    rows = K.scored(spark, sf)
    return X.winner_rows(rows, X.available_metrics(rows))


@query(
    "key block rank:i",
    f"SELECT key, block, row_number() OVER (PARTITION BY {_PLACE} ORDER BY block, key) + 1000 * {_PLACE} AS rank FROM sites",
    "sites",
)
def block_order(spark, sf):
    """Keys by a given order of their blocks: a rank within the block on top of a thousand for each place."""
    from pyspark.sql import Window

    at = X.in_order("block", ORDER)
    rows = S.sites(spark, sf).withColumn("place", at)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy("block", "key")) + 1000 * F.col("place"))


@query(
    "block key rank:i",
    "SELECT block, key, row_number() OVER (PARTITION BY block ORDER BY CAST(regexp_extract(key, '([0-9]+)$', 1) AS INT)) AS rank FROM sites",
    "sites",
)
def numeric_order(spark, sf):
    """Keys by the number that their text ends in, not by the text."""
    from pyspark.sql import Window

    number = F.regexp_extract("key", "([0-9]+)$", 1).cast("int")
    return S.sites(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(number)))


@query("key date liquid:4", "SELECT key, date, oil + water AS liquid FROM (SELECT key, date, oil_tpd AS oil, CASE WHEN month(date) <> 6 THEN liq_tpd - oil_tpd END AS water FROM rates)", "rates")
def panel_liquid(spark, sf):
    """Oil and water make up the liquid; it is null where one is."""
    rows = K.rates(spark, sf).select("key", "date", F.col("oil_tpd").alias("oil"), F.when(F.month("date") != 6, F.col("liq_tpd") - F.col("oil_tpd")).alias("water"))
    return rows.withColumn("liquid", F.col("oil") + F.col("water"))


_COLUMNS = ["NATION_0", "NATION_6", "NATION_12"]


@query(
    "key " + " ".join(f"{c}:i" for c in _COLUMNS),
    "SELECT key, " + ", ".join(f"coalesce(max(CASE WHEN same_block AND w > 0.1 THEN 1 ELSE 0 END) FILTER (inj = '{c}'), 0) AS {c}" for c in _COLUMNS) + f" FROM ({K._GAINS}) GROUP BY 1",
    "sites injectors",
)
def significance_mask(spark, sf):
    return X.mask(K._gains(spark, sf), F.col("same_block") & (F.col("w") > 0.1), _COLUMNS)
