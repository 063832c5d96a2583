"""Injector-to-producer weights as edge lists, and what they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import impute_group_mean


def _normalised(edges: DataFrame) -> DataFrame:
    """Each injector's weights sum to 1; an injector without edges has no rows, which stands for zeros."""
    return edges.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("inj")))


def _pairs(producers: DataFrame, injectors: DataFrame) -> DataFrame:
    """Pairs of one block, by an equi-join: structural zeros are never made."""
    i = injectors.select("inj", "block", F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("perm").alias("ki"))
    return producers.join(i, "block").withColumn("d", F.hypot(F.col("x") - F.col("xi"), F.col("y") - F.col("yi")))


def hydro_weights(producers: DataFrame, injectors: DataFrame, eta: float = 2.0) -> DataFrame:
    """(inj, key, w): harmonic mean of the permeabilities over distance to the power eta."""
    pairs = _pairs(producers, impute_group_mean(injectors, "perm", "block"))
    k = 2 * F.col("perm") * F.col("ki") / (F.col("perm") + F.col("ki"))
    return _normalised(pairs.select("inj", "key", (k / F.pow("d", F.lit(eta))).alias("w")))


def distance_weights(producers: DataFrame, injectors: DataFrame, eta: float = 2.0) -> DataFrame:
    return _normalised(_pairs(producers, injectors).select("inj", "key", (1 / F.pow("d", F.lit(eta))).alias("w")))


def uniform_weights(producers: DataFrame, injectors: DataFrame) -> DataFrame:
    return _normalised(_pairs(producers, injectors).select("inj", "key", F.lit(1.0).alias("w")))


def allocate(injection: DataFrame, edges: DataFrame, value: str = "winj_m3", out: str = "alloc", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, date, alloc): the weighted sums, a sparse matrix product as join and sum.

    Edges that differ by cutoff, such as fitted gains, name it in ``by``."""
    return injection.join(edges, "inj").groupBy(*by, "key", "date").agg(F.sum(F.col("w") * F.col(value)).alias(out))


def block_sums(injection: DataFrame, producers: DataFrame, value: str = "winj_m3", out: str = "inj_block") -> DataFrame:
    """(key, date, inj_block): the block's injection, summed before it is joined to the producers."""
    sums = injection.groupBy("block", "date").agg(F.sum(value).alias(out))
    return producers.select("key", "block").join(sums, "block").select("key", "date", out)


def block_share(gains: DataFrame, producers: DataFrame, injectors: DataFrame) -> DataFrame:
    """Share of the gains that stays within blocks; ``gains`` has inj, key and w."""
    p, i = producers.select("key", F.col("block").alias("bp")), injectors.select("inj", F.col("block").alias("bi"))
    both = gains.join(p, "key").join(i, "inj")
    return both.agg((F.sum(F.when(F.col("bp") == F.col("bi"), F.col("w"))) / F.sum("w")).alias("share"))
