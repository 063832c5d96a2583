"""The monthly panel from partial states of the shipments' files, so that a change of the files is all that is read again.

Of each version of a file (its path, size and time, and the dimension tables' stamp) the states of its months are kept: sums, counts and
a bitmap of the days. States of files merge by adding and by bitwise or, so the panel is made from the states of
the versions that are there now, whatever files came, went or were replaced since. A refresh finds the versions without a state by one anti-join
over the manifest and reads those files alone.

States lie in batches, and a batch counts only once it is named in the table ``done``, which is written after it:
a refresh that fails leaves nothing that is read. Two refreshes at once may both make a version's state; one of them counts.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month
from . import shared

#: Months that aren't whole are cut off.
END = "2001-11-01"
STATE = "version string, key string, block string, date date, gross double, kept double, tax double, n bigint, days int"


def versioned(salt: str) -> Column:
    """The version of the file that a row comes from."""
    return F.sha2(F.concat_ws("|", F.lit(salt), "_metadata.file_path", F.col("_metadata.file_size").cast("string"), F.col("_metadata.file_modification_time").cast("string")), 256)


def manifest(spark: SparkSession, path: str, salt: str) -> DataFrame:
    """(path, version) of the table's files that there are; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", versioned(salt).alias("version"))


def states(lines: DataFrame, spark: SparkSession, sf_dir: str, salt: str) -> DataFrame:
    """The states of the files that ``lines`` reads, a row for each version, key and month."""
    supplier, nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    rows = (
        lines.withColumn("version", versioned(salt)).where(F.col("l_shipdate") < F.lit(END).cast("timestamp_ntz"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    kept = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") * (1 - F.col("l_discount"))).otherwise(0.0)
    return rows.groupBy("version", F.col("n_name").alias("key"), F.col("r_name").alias("block"), month("l_shipdate").alias("date")).agg(
        F.sum("l_extendedprice").alias("gross"),
        F.sum(kept).alias("kept"),
        F.sum("l_tax").alias("tax"),
        F.count("l_tax").alias("n"),
        F.bit_or(F.expr("shiftleft(1, dayofmonth(l_shipdate) - 1)")).alias("days"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """The panel of all the states."""
    return parts.groupBy("key", "block", "date").agg(
        F.round(F.sum("gross"), 2).alias("liq_t"),
        F.round(F.sum("kept"), 4).alias("oil_t"),
        F.round(F.sum("tax") / F.sum("n") * 1000, 6).alias("p_res"),
        (24.0 * F.bit_count(F.bit_or("days"))).alias("hours"),
    )


def refresh(spark: SparkSession, sf_dir: str, at: str) -> tuple[DataFrame, list[str]]:
    """The panel as of the files that there are, and the files that had to be read for it; ``at`` is the states' folder."""
    table = f"{sf_dir}/lineitem.parquet"
    salt = "|".join(shared.stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    now = manifest(spark, table, salt)
    done = [spark.read.schema("version string, batch string").parquet(f"{at}/done")] if shared.exists(spark, f"{at}/done") else []
    missing = now.join(done[0], "version", "left_anti") if done else now
    paths = sorted(r["path"] for r in missing.select("path").collect())  # the files that changed
    if paths:
        batch = uuid.uuid4().hex
        states(spark.read.parquet(*paths), spark, sf_dir, salt).write.parquet(f"{at}/states/batch={batch}")
        # A file without a row before the end has no state, but it is done.
        missing.select("version", F.lit(batch).alias("batch")).coalesce(1).write.mode("append").parquet(f"{at}/done")
    known = spark.read.schema("version string, batch string").parquet(f"{at}/done").groupBy("version").agg(F.min("batch").alias("batch"))
    every = spark.read.schema(STATE + ", batch string").parquet(f"{at}/states")
    return merged(every.join(now.select("version").distinct().join(known, "version"), ["version", "batch"])), paths


def folder(spark: SparkSession, sf_dir: str) -> str:
    """Where the states of a source's files lie, in the shared folder; forgotten with the tables that are held."""
    at = f"{shared.shared_dir(spark)}/panel-states-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    shared.forgotten(spark, at)
    return at
