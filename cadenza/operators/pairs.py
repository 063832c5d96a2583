"""Sums over the common months of all pairs of series, by blocks of columns.

The pairs of keys are the result, but the rows that meet needn't be pairs: keys are dealt into blocks of some ``BLOCK``, dates into
parts of some ``PART``, and two blocks meet in a part as two matrices with masks for gaps. Six matrix products make the
six sums of all their pairs. What is shuffled is each value once for each block, not once for each key, and
a task holds two blocks of a part, whatever the number of keys and dates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of a block, and dates of a part, about.
BLOCK, PART = 256, 4096
#: Common dates, those with both values, and the sums over these.
SUMS = ("n", "m", "sa", "sb", "saa", "sbb", "sab")


def pair_correlations(rows: DataFrame, value: str, key: str = "key", block: int = BLOCK, part: int = PART) -> DataFrame:
    """(a, b, n, r) of each pair of keys a < b with a common date: its common dates with both values, and their correlation.

    Rows are (key, date, value), one for each key and date; n counts the dates that both keys have, r those whose values are both known, and
    is null where that is one date or a value doesn't vary. Values are taken less their key's mean, so that sums of squares keep their digits."""
    counts = rows.agg(F.count_distinct(key).alias("keys"), F.count_distinct("date").alias("dates")).first()
    blocks, parts = max(1, -(-counts["keys"] // block)), max(1, -(-counts["dates"] // part))
    means = rows.groupBy(key).agg(F.avg(value).alias("_mean"))
    known = rows.select(key, "date", F.col(value).cast("double").alias("v")).join(means, key)
    dealt = known.select(
        F.col(key).cast("string").alias("key"), "date", (F.col("v") - F.col("_mean")).alias("v"),
        F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("own"), F.pmod(F.xxhash64("date"), F.lit(parts)).cast("int").alias("part"),
    )
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each = each.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "date", "v")

    def multiply(group: pa.Table) -> pa.Table:
        own, i, j = group.column("own").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        dates = group.column("date").combine_chunks().dictionary_encode()
        day, v = dates.indices.to_numpy(), group.column("v").to_numpy(zero_copy_only=False)
        names = group.column("key").combine_chunks().dictionary_encode()
        name, place = np.array(names.dictionary.to_pylist()), names.indices.to_numpy()

        def side(which: int) -> tuple[np.ndarray, ...]:
            mine = own == which
            keys, column = np.unique(place[mine], return_inverse=True)
            there = np.zeros((len(dates.dictionary), len(keys)))
            x = there.copy()
            there[day[mine], column] = 1
            x[day[mine], column] = v[mine]
            seen = there * ~np.isnan(x)
            return name[keys], there, seen, np.nan_to_num(x)

        ka, ta, sa, xa = side(i)
        kb, tb, sb, xb = (ka, ta, sa, xa) if i == j else side(j)
        pairs = np.argwhere(ka[:, None] < kb[None, :]) if i == j else np.argwhere(np.ones((len(ka), len(kb)), bool))
        at, bt = pairs.T
        sums = [m[at, bt] for m in (ta.T @ tb, sa.T @ sb, xa.T @ sb, sa.T @ xb, (xa * xa).T @ sb, sa.T @ (xb * xb), xa.T @ xb)]
        swap = ka[at] > kb[bt]
        for p, q in ((2, 3), (4, 5)):
            sums[p], sums[q] = np.where(swap, sums[q], sums[p]), np.where(swap, sums[p], sums[q])
        some = sums[0] > 0
        low, high = np.where(swap, kb[bt], ka[at]), np.where(swap, ka[at], kb[bt])
        return pa.table([pa.array(low[some].tolist(), pa.string()), pa.array(high[some].tolist(), pa.string()), *(pa.array(x[some].astype(float)) for x in sums)], ["a", "b", *SUMS])

    made = each.groupBy("part", "i", "j").applyInArrow(multiply, "a string, b string, " + ", ".join(f"{c} double" for c in SUMS))
    s = made.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in SUMS))
    covered = F.col("sab") - F.col("sa") * F.col("sb") / F.col("m")
    va, vb = (F.col(f"s{x}{x}") - F.col(f"s{x}") * F.col(f"s{x}") / F.col("m") for x in "ab")
    # What rounding leaves of a constant's variance isn't one.
    varies = (va > 1e-12 * F.col("saa")) & (vb > 1e-12 * F.col("sbb"))
    return s.select("a", "b", F.col("n").cast("long").alias("n"), F.when((F.col("m") > 1) & varies, covered / F.sqrt(va * vb)).alias("r"))

