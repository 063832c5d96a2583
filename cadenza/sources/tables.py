"""Readers and writers: typed CSV, wide matrices, result sets, and the binding of the star schema to panels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month
from . import refresh
from .shared import exists, held

#: The last whole month of the star schema's shipments; the next one is cut off.
LAST_VALID = date(2001, 10, 1)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a declared schema: no inference pass."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_matrix(spark: SparkSession, path: str, at: str = "date") -> DataFrame:
    """A wide CSV of one column per series, as long rows (date, key, value)."""
    wide = spark.read.option("header", True).csv(path)
    series = [c for c in wide.columns if c != at]
    typed = wide.select(F.to_date(at).alias("date"), *(F.col(f"`{c}`").cast("double").alias(c) for c in series))
    return typed.unpivot(["date"], series, "key", "value").where("value is not null")


def write_matrix(df: DataFrame, path: str, keys: list[str], prefix: str = "", key: str = "key", value: str = "value") -> None:
    """Long rows as a wide CSV: one line per month, one column per key in the given order."""
    wide = df.groupBy("date").pivot(key, keys).agg(F.first(value))
    named = [F.col(f"`{k}`").alias(f"{prefix}{k}") for k in keys]
    wide.select(F.date_format("date", "yyyy-MM-dd").alias("date"), *named).orderBy("date").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """Forecast rows, partitioned so that a model or target is read alone."""
    df.write.mode("overwrite").partitionBy("model", "target").parquet(path)


def read_results(spark: SparkSession, path: str, deny: tuple[str, ...] = ()) -> DataFrame:
    """All stored results whose model doesn't start with a denied prefix."""
    rows = spark.read.parquet(path)
    return rows.where(~F.col("model").rlike("^(" + "|".join(deny) + ")")) if deny else rows


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def parse_result_name(name: str = "name") -> tuple:
    """(model, target) from names like ``model_part_liq_tpd``: the last two parts are the target."""
    return F.regexp_extract(name, r"^(.*)_([^_]*_[^_]*)$", 1).alias("model"), F.regexp_extract(name, r"^(.*)_([^_]*_[^_]*)$", 2).alias("target")


# The star schema as a field of producers and injectors.


def producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, block): the supplier nations that ship, with their regions."""
    nation, region, supplier = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    return (
        supplier.select("s_nationkey").distinct().join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_name").alias("key"), F.col("r_name").alias("block"))
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel, a row per key and month: made once from the shipments, then read until their files change; then from the changed ones."""
    return held(spark, "panel", sf_dir, lambda: refresh.refresh(spark, sf_dir, refresh.folder(spark, sf_dir))[0])


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, block, date, liq_t, oil_t, p_res, hours): the supplier nations' shipments by month, from all of them at once."""
    line, supplier, nation, region = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    rows = (
        line.where(F.col("l_shipdate") < F.lit("2001-11-01").cast("timestamp_ntz"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    kept = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") * (1 - F.col("l_discount"))).otherwise(0.0)
    return rows.groupBy(F.col("n_name").alias("key"), F.col("r_name").alias("block"), month("l_shipdate").alias("date")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("liq_t"),
        F.round(F.sum(kept), 4).alias("oil_t"),
        F.round(F.avg("l_tax") * 1000, 6).alias("p_res"),
        (24.0 * F.count_distinct(F.to_date("l_shipdate"))).alias("hours"),
    )


def injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly injection, made once like the panel."""
    return held(spark, "injection", sf_dir, lambda: monthly_injection(spark, sf_dir))


def monthly_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inj, block, date, winj_m3): the customer nations' quantities by month of shipment."""
    line, orders, customer, nation, region = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    rows = (
        line.where(F.col("l_shipdate") < F.lit("2001-11-01").cast("timestamp_ntz"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.groupBy(F.col("n_name").alias("inj"), F.col("r_name").alias("block"), month("l_shipdate").alias("date")).agg(F.round(F.sum("l_quantity"), 2).alias("winj_m3"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, block, x, y, perm) of the producers; perm from the suppliers' balances."""
    nation, region, supplier = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    perm = supplier.groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal") + 2000, 6).alias("perm"))
    return perm.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("key"), F.col("r_name").alias("block"), (F.col("n_nationkey") % 5).cast("double").alias("x"), F.floor(F.col("n_nationkey") / 5).cast("double").alias("y"), "perm"
    )


def injector_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inj, block, x, y, perm) of the injectors, half a unit east of their nation's site; every fifth lacks perm."""
    nation, region, customer = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    perm = customer.groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal") + 2000, 6).alias("perm"))
    return perm.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("inj"), F.col("r_name").alias("block"), (F.col("n_nationkey") % 5 + 0.5).alias("x"), F.floor(F.col("n_nationkey") / 5).cast("double").alias("y"),
        F.when(F.col("n_nationkey") % 5 != 0, F.col("perm")).alias("perm"),
    )
