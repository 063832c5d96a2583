"""URL filters by a path-template tree.

1. Every url becomes a host and a template: in each path segment runs of digits, and long hexadecimal
   or very long segments, are replaced by ``*``.
2. Templates are counted per host with their labels (one row per template from here on). A node of the
   tree with more than ``MAX_CHILDREN`` distinct children is variable: its children become ``*``. Nodes are
   taken from the root down, so the children of all that became one ``*`` are counted together. Only a node with more than
   ``MAX_CHILDREN`` templates below it can be variable or have a variable one below: the others are left as they are at
   once, and where a node has one child, the step goes to where its branches part. So there are as many steps as
   there are partings of well-filled nodes one below the other, however deep paths are.
3. A node's pages are those of its own path and of all below it. A node whose share of bad labels differs from that of its siblings
   (its parent's other pages; a two-proportion z-test) stands alone; one that doesn't is merged with its parent.
   So a page is judged by the nearest node on its way up that stands alone, or by its host. Nodes are numbered by a hash
   of the way to them, and summed once for all depths.
4. A template's purity is ``(bad + PRIOR_WEIGHT * prior) / (labelled + PRIOR_WEIGHT)`` with the prior the
   share of bad labels overall; templates above ``threshold`` are rejected.

Two of n nodes have the same 64-bit number with odds of n * n / 2**65. The tables between the steps, of a row per template or node,
are stored. Where many rows meet one host or node, they do in an equi-join with a row a key, which Spark may broadcast or split.

Rules come first: a rule names a host with its subdomains and a path prefix, and the longest that fits
decides. They are a parameter of bounded length, compiled into one expression.

A host may hold a third of all pages: pages are counted with map-side combine, and the pages meet the
template table, which is smaller by far, in an equi-join that Spark may broadcast or split.

Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no rule and is
allowed; the label of a page is the worst of its labels' rows; repeated pages, and pages without an id, are
judged row by row like any other, the latter without a label; urls are read whole, however long; of rules of
equal length that fit, which a url can't have but for repeated ones, the last by name decides; a purity of
just the threshold is allowed; extra columns are ignored; without labels nothing is rejected; an empty table
gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_CHILDREN = 20
PRIOR_WEIGHT = 10.0
#: The z-score beyond which a branch differs from its siblings.
MERGE_Z = 1.96


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules (``host/path`` to verdict) that fits, or null."""
    found = F.lit(None).cast("string")
    for name in sorted(rules, key=lambda r: (len(r), r)):
        own, slash, rest = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(name)).otherwise(found)
    return found


def template(path: Column) -> Column:
    def general(segment: Column) -> Column:
        whole = segment.rlike("^[0-9a-fA-F-]{16,}$") | (F.length(segment) >= 48)
        return F.when(whole, F.lit("*")).otherwise(F.regexp_replace(segment, "[0-9]+", "*"))

    return F.array_join(F.transform(F.split(path, "/"), general), "/")


def generalised(counts: DataFrame, max_children: int) -> DataFrame:
    """``counts`` with ``merged``, the template in which children of variable nodes are ``*``, with the extension that they end in."""
    done, rest = [], counts.withColumn("merged", F.lit("")).withColumn("rest", F.slice(F.split("template", "/"), 2, F.greatest(F.size(F.split("template", "/")), F.lit(1))))
    while True:
        done.append(rest.where(F.size("rest") == 0))
        rest = rest.where(F.size("rest") > 0).withColumn("child", F.get("rest", F.lit(0)))
        nodes = rest.groupBy("host", "merged").agg(F.count("*").alias("templates"), F.count_distinct("child").alias("children"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        parting = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        nodes = nodes.select("host", "merged", (F.col("templates") > max_children).alias("full"), (F.col("children") > max_children).alias("wide"), F.when(parting == 0, F.size("low")).otherwise(parting - 1).alias("common"))
        star = F.concat(F.lit("*"), F.regexp_extract("child", r"(\.[A-Za-z]+)?$", 0))
        # All segments if nothing below can be variable, else those that all templates here share, else one.
        steps = F.when(~F.col("full"), F.size("rest")).otherwise(F.greatest("common", F.lit(1)))
        to = F.when(F.col("wide") & (F.col("child") != ""), star).otherwise(F.array_join(F.slice("rest", F.lit(1), steps), "/"))
        at = F.slice("rest", steps + 1, F.greatest(F.size("rest"), F.lit(1)))
        own = counts.columns
        made = rest.join(nodes, ["host", "merged"]).select(*own, F.concat("merged", F.lit("/"), to).alias("merged"), at.alias("rest"), "full")
        made = stored(made, "url-level")
        done.append(made.where(~F.col("full")))
        rest = made.where("full").drop("full")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, (d.select(*own, "merged") for d in done))


def tree(pages: DataFrame, max_children: int = MAX_CHILDREN, merge_z: float = MERGE_Z, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """(host, template, merged, purity) from rows of host, template and bad (1, 0 or null)."""
    counts = pages.groupBy("host", "template").agg(F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    counts = stored(counts, "url-templates")
    prior = counts.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0))).first()[0]
    general = generalised(counts, max_children)

    # Each template's way from the host down; the first node is the host.
    def onward(way: Column, segment: Column) -> Column:
        return F.concat(way, F.array(F.xxhash64(F.element_at(way, -1), segment)))

    segments = F.split("merged", "/")
    way = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1))), F.array(F.xxhash64("host")), onward)
    leaves = general.groupBy("host", "merged").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("way", way).withColumn("leaf", F.element_at("way", -1))
    leaves = stored(leaves, "url-leaves")
    ways = leaves.select("leaf", "n", "bad", "way", F.posexplode("way").alias("depth", "node"))
    nodes = ways.withColumn("parent", F.get("way", F.col("depth") - 1)).groupBy("node", "parent").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    nodes = stored(nodes, "url-nodes")

    above = nodes.select(F.col("node").alias("parent"), F.col("n").alias("pn"), F.col("bad").alias("pbad"))
    n, bad, pn, pbad = (F.col(c).cast("double") for c in ("n", "bad", "pn", "pbad"))
    rest, pool = pn - n, pbad / F.nullif(pn, F.lit(0.0))
    z = F.abs(bad / F.nullif(n, F.lit(0.0)) - (pbad - bad) / F.nullif(rest, F.lit(0.0))) / F.nullif(F.sqrt(pool * (1 - pool) * (1 / F.nullif(n, F.lit(0.0)) + 1 / F.nullif(rest, F.lit(0.0)))), F.lit(0.0))
    alone = nodes.join(above, "parent").where(z > merge_z).select("node", "n", "bad")
    alone = alone.union(nodes.where("parent is null").select("node", "n", "bad"))
    nearest = ways.select("leaf", "depth", "node").join(alone, "node").groupBy("leaf").agg(F.max_by(F.struct("n", "bad"), "depth").alias("pool"))
    purity = (F.col("pool.bad") + prior_weight * prior) / (F.col("pool.n") + prior_weight)
    judged = leaves.select("leaf", "host", "merged").join(nearest, "leaf").select("host", "merged", purity.alias("purity"))
    return general.select("host", "template", "merged").join(judged, ["host", "merged"])


def judge(pages: DataFrame, rules: dict[str, str], labels: DataFrame | None = None, threshold: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, template, purity, verdict); ``template`` is that of the tree, ``labels`` has page_id and bad (0 or 1)."""
    split = pages.select(pages[page_id].alias("page_id"), host(pages[url]).alias("host"), path(pages[url]).alias("path"))
    split = split.withColumn("template", template(F.col("path"))).withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    if labels is None:
        labelled = split.withColumn("bad", F.lit(None).cast("int"))
    else:
        worst = labels.groupBy(F.col("page_id")).agg(F.max("bad").alias("bad"))
        labelled = split.join(worst, "page_id", "left")
    found = tree(labelled)
    known = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv)) if rules else F.expr("map('', '')")
    verdict = F.coalesce(F.element_at(known, F.col("rule")), F.when((F.col("host") != "") & (F.col("purity") > threshold), F.lit("block")).otherwise(F.lit("allow")))
    return split.join(found, ["host", "template"], "left").select("page_id", "host", "path", "rule", F.col("merged").alias("template"), "purity", verdict.alias("verdict"))
