"""A martingale against exchangeable residuals: online p-values by dominance counting, and the simple jumper by a prefix scan.

A residual's p-value is its rank among those up to it, in the order of the cutoffs and, within one, of a hash. All rows of one
model may be most of the table, so nothing here walks through them one by one:

1. Places in time and in value come from sorts in ranges (:func:`places`).
2. How many earlier residuals are larger is counted level by level over the bits of the place in value. At a level, rows that
   share all higher bits are a node; a row without the level's bit is exceeded by those of its node that have it, so
   it counts the ones before it in time. A node's rows are counted in chunks of time, and the chunks before are added from a table of
   a row a chunk. The last ``LEAF`` bits are one level, by comparing the few rows of a leaf.
3. The jumper's step is linear in its capital, so a chunk of rows is one 3 x 3 matrix, and chunks of chunks are products of
   them. Going down again, each chunk gets the capital that it starts with, and finds its own maximum.

A task holds a chunk of ``CHUNK`` rows or matrices, whatever the number of rows; a model of CHUNK**3 rows takes CHUNK matrices at the top.
Null residuals are left out; equal ones are told apart by time, and their share of the rank is drawn by the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import places
from ..sources.shared import stored

#: The jumper's directions. Fixed values.
JUMPS = (-1.0, 0.0, 1.0)
#: Rows or matrices that a fold takes; bits of the leaves; bits of the places in time that make a chunk of counting.
CHUNK, LEAF, SPAN = 512, 6, 16


def larger_before(rows: DataFrame, group: str, n: int, leaf: int = LEAF, span: int = SPAN) -> DataFrame:
    """(group, t, larger) from places in time t and in value v, both 0 .. rows - 1 of the group: the rows of smaller t and larger v.

    ``n`` is the rows of the largest group at most."""
    few = rows.groupBy(group, F.shiftright("v", leaf).alias("node")).agg(F.collect_list(F.struct("t", "v")).alias("all"))
    of = F.transform("all", lambda x: F.struct(x["t"].alias("t"), F.size(F.filter("all", lambda y: (y["t"] < x["t"]) & (y["v"] > x["v"]))).cast("long").alias("larger")))
    parts = few.select(group, F.inline(of))
    bits = max(1, n - 1).bit_length()
    if bits > leaf:
        level = F.explode(F.sequence(F.lit(leaf), F.lit(bits - 1))).alias("level")
        each = rows.select(group, "t", "v", level).select(group, "t", "level", F.expr("shiftright(v, level + 1)").alias("node"), F.expr("shiftright(v, level) & 1").alias("bit"), F.shiftright("t", span).alias("chunk"))
        node = [group, "level", "node"]
        sums = each.groupBy(*node, "chunk").agg(F.sum("bit").alias("ones"))
        before = sums.withColumn("before", F.coalesce(F.sum("ones").over(Window.partitionBy(*node).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        within = F.sum("bit").over(Window.partitionBy(*node, "chunk").orderBy("t"))
        met = each.withColumn("within", within).where("bit = 0").join(before.drop("ones"), [*node, "chunk"])
        parts = parts.unionByName(met.select(group, "t", (F.col("within") + F.col("before")).alias("larger")))
    return parts.groupBy(group, "t").agg(F.sum("larger").alias("larger"))


def p_values(residuals: DataFrame, group: str, value: str = "resid", ids: tuple[str, ...] = ("key", "step"), digits: int = 6) -> DataFrame:
    """(group, t, p): the online p-value of each residual, t counting from 0 within the group."""
    name = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in (*ids, "cutoff"))))
    rows = residuals.select(group, "cutoff", *ids, name.alias("h"), F.round(F.abs(value), digits).alias("a")).where("a is not null")
    timed = places(rows, group, "cutoff", "h", *ids, out="_t").select(group, "h", "a", "_t")
    # Both orders have the groups one after the other, so a group begins at the same place in them.
    valued = places(timed, group, "a", "_t", out="_v")
    sizes = valued.groupBy(group).agg(F.min("_t").alias("_from"), F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    ranked = valued.join(sizes, group).select(group, "h", "a", (F.col("_t") - F.col("_from")).alias("t"), (F.col("_v") - F.col("_from")).alias("v"))
    ranked = stored(ranked, "exchange-ranks")
    first = ranked.groupBy(group, "a").agg(F.min("v").alias("first"))
    u = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 4294967296.0
    joined = ranked.join(first, [group, "a"]).join(larger_before(ranked.select(group, "t", "v"), group, most), [group, "t"])
    return joined.select(group, "t", ((F.col("larger") + u * (F.col("v") - F.col("first") + 1)) / (F.col("t") + 1)).alias("p"))


def _moved(x: Column, p: Column, rate: float) -> Column:
    """The capital after a p-value."""
    total = x[0] + x[1] + x[2]
    return F.array(*(((1 - rate) * x[k] + rate / 3 * total) * (1 + JUMPS[k] * (p - 0.5)) for k in range(3)))


def _applied(m: Column, x: Column) -> Column:
    """The matrix, an array of columns, times the capital."""
    return F.array(*(m[0][r] * x[0] + m[1][r] * x[1] + m[2][r] * x[2] for r in range(3)))


def _sum(x: Column) -> Column:
    return x[0] + x[1] + x[2]


def _even(x: Column, scale: Column, total: Column) -> Column:
    """(x / total, scale + log10 total): what is multiplied on and on stays near one."""
    return F.struct(F.transform(x, lambda v: v / total).alias("x"), (scale + F.log10(total)).alias("scale"))


def _identity() -> Column:
    return F.array(*(F.array(*(F.lit(1.0 if i == j else 0.0) for i in range(3))) for j in range(3)))


def _even_matrix(m: Column, scale: Column) -> Column:
    total = _sum(m[0]) + _sum(m[1]) + _sum(m[2])
    return F.struct(F.transform(m, lambda c: F.transform(c, lambda v: v / total)).alias("m"), (scale + F.log10(total)).alias("scale"))


def _starts(matrices: Column, x: Column, scale: Column) -> Column:
    """An array of (at, x, scale): what each of the sorted matrices starts with, the first with the capital x at a scale."""
    empty = F.expr("cast(array() as array<struct<at: bigint, x: array<double>, scale: double>>)")

    def step(s: Column, m: Column) -> Column:
        made = _applied(m["m"], s["x"])
        after = _even(made, s["scale"] + m["scale"], _sum(made))
        return F.struct(after["x"].alias("x"), after["scale"].alias("scale"), F.concat(s["all"], F.array(F.struct(m["at"].alias("at"), s["x"].alias("x"), s["scale"].alias("scale")))).alias("all"))

    return F.aggregate(matrices, F.struct(x.alias("x"), scale.alias("scale"), empty.alias("all")), step, lambda s: s["all"])


def martingale(p: DataFrame, group: str, rate: float = 0.01, chunk: int = CHUNK) -> DataFrame:
    """(group, n, log10_max, log10_last) of the simple jumper over p-values in the order of t."""
    at = F.floor(F.col("t") / chunk)
    chunks = p.groupBy(group, at.alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "p"))), lambda x: x["p"]).alias("ps"))
    chunks = stored(chunks, "exchange-chunks")
    walked = F.aggregate("ps", _identity(), lambda m, v: F.transform(m, lambda x: _moved(x, v, rate)))
    ones = chunks.select(group, "at", _even_matrix(walked, F.lit(0.0)).alias("p")).select(group, "at", "p.m", "p.scale")

    def times(s: Column, m: Column) -> Column:
        return _even_matrix(F.transform(s["m"], lambda x: _applied(m["m"], x)), s["scale"] + m["scale"])

    listed = F.array_sort(F.collect_list(F.struct("at", "m", "scale")))
    inner = ones.groupBy(group, F.floor(F.col("at") / chunk).alias("super")).agg(listed.alias("list"))
    product = F.aggregate("list", F.struct(_identity().alias("m"), F.lit(0.0).alias("scale")), times)
    outer = inner.select(group, F.col("super").alias("at"), product.alias("p")).select(group, "at", "p.m", "p.scale").groupBy(group).agg(listed.alias("list"))
    third = F.array(*(F.lit(1 / 3) for _ in JUMPS))
    tops = outer.select(group, F.inline(_starts(F.col("list"), third, F.lit(0.0)))).withColumnRenamed("at", "super")
    begun = inner.join(tops, [group, "super"]).select(group, F.inline(_starts(F.col("list"), F.col("x"), F.col("scale"))))

    def step(s: Column, v: Column) -> Column:
        x = _moved(s["x"], v, rate)
        return F.struct(x.alias("x"), F.greatest(s["best"], _sum(x)).alias("best"))

    own = F.aggregate("ps", F.struct(F.col("x").alias("x"), F.lit(0.0).alias("best")), step)
    ended = chunks.join(begun, [group, "at"]).select(group, "at", F.size("ps").alias("k"), "scale", own.alias("own"))
    return ended.groupBy(group).agg(
        F.sum("k").alias("n"),
        F.max(F.col("scale") + F.log10("own.best")).alias("log10_max"),
        F.max_by(F.col("scale") + F.log10(_sum(F.col("own.x"))), "at").alias("log10_last"),
    )


def exchangeability(residuals: DataFrame, group: str, rate: float = 0.01, value: str = "resid", chunk: int = CHUNK) -> DataFrame:
    """(group, n, log10_max, log10_last): cutoffs in order, the rows of one in the order of a hash."""
    return martingale(p_values(residuals, group, value), group, rate, chunk)
