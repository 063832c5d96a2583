"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, stored

#: ASCII white space, the separators of a word: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[ \t\n\x0B\f\r]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def min_labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its group) for the groups that a block of links forms.

    ``linked[i, j]`` says that ``left[i]`` and ``right[j]`` are linked. At most one edge for each row
    and column comes back, however many links the block holds.
    """
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not len(rows):
        return left[:0], left[:0]
    sub = linked[np.ix_(rows, cols)]
    a, b = left[rows].copy(), right[cols].copy()
    top = np.iinfo(a.dtype).max
    while True:
        b2 = np.minimum(b, np.where(sub, a[:, None], top).min(axis=0))
        a2 = np.minimum(a, np.where(sub, b2[None, :], top).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    ids, labels = np.concatenate([left[rows], right[cols]]), np.concatenate([a, b])
    keep = ids != labels
    return ids[keep], labels[keep]


#: Parts into which the rows of one key are dealt.
PARTS = 64


def met(rows: DataFrame, key: str | list[str], by: str, made: DataFrame) -> DataFrame:
    """``rows`` joined with ``made``, which has one row for each ``key`` at most, without a hot key in one task.

    The rows of a key are dealt into PARTS by a hash of ``by``; each part that there is fetches its key's row."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    keys = [key] if isinstance(key, str) else key
    return dealt.join(dealt.select(*keys, "_part").distinct().join(made, keys), [*keys, "_part"]).drop("_part")


def least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest v of each u."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint): one row (id, component) for each id in an edge.

    ``component`` is the smallest id reachable. Alternates the large-star and small-star steps
    (Kiveris et al., 2014) until no edge changes; each round is checkpointed to the shared folder, so that
    a lost executor costs one round at most. A root with very many neighbours is dealt over many tasks.
    Rows with a null end are ignored.
    """
    e = checkpoint(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    n = e.count()
    while n:
        both = e.union(e.select(F.col("v"), F.col("u")).toDF("u", "v"))
        large = met(both, "u", "v", least(both)).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = met(large, "u", "v", least(large))
        step = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = checkpoint(step.union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before, n = n, made.count()
        changed = n != before or made.join(e, ["u", "v"], "left_anti").limit(1).count()
        e = made
        if not changed:
            break
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


__all__ = ["checkpoint", "components", "least", "let", "met", "min_labels", "shared_dir", "stored"]
