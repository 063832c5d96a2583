"""Target-distribution importance resampling, in Spark SQL only.

Documents are drawn as if from the distribution of a target corpus (Xie et al., 2023): features are hashed n-grams of
words, a feature's gain is the log ratio of its bucket's share in the target to that in the documents, and a
document's weight is the mean gain of its features. Gumbel noise from a hash of its id is added, so that taking the
highest scores is drawing without replacement.

1. n-grams are exploded, crc32 modulo ``buckets`` names their bucket, and buckets are counted. Each task
   sends a row a bucket at most, however frequent one is.
2. The gain table has a row a bucket. It is stored, so that it is made once and no broadcast waits for a
   pass over the corpus, and sent to all tasks: its size is the parameter ``buckets``.
3. The n-grams are exploded again, meet their gains, and are summed by the row that they come from. All n-grams of a row
   are in one task, so a row leaves it as one row, and a very long text is no hot group.
4. Scores are sorted by range over (score, doc_id, row); places within a partition come from the sort, and the rows in
   the partitions before are added from a table of a row a partition. The scores and the sorted rows are stored in the
   shared folder, so that a lost executor costs its tasks alone.

Logarithms are taken in double precision; the counts that meet in them are exact up to 2**53.

Defined cases: a null or empty text has no features and the weight 0; a null doc_id counts as an empty one in the hash,
and comes last among ties; rows that repeat a doc_id are documents of their own with the same noise, and their ties are
broken by the number of features, then by their place in the input; a document of too few words takes no part in the draw, and its rank
is null; extra columns are ignored, whatever their names; empty targets or an empty table are counted as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

BUCKETS, LONGEST, MIN_WORDS, PERCENT = 10_000, 2, 20, 25
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All ASCII characters but digits and lower-case letters part words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), BETWEEN), "")


def grams(rows: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``rows`` with ``gram`` in place of the array ``words``: all runs of 1 to ``longest`` consecutive words, joined by a blank.

    Every word is a row first, then the runs that begin there; both explosions and the runs are generated code in one stage. There are
    null grams beside, where a run would go beyond the end, and one at least for a row without words."""
    own = [c for c in rows.columns if c != "words"]
    runs = [F.col("word")]
    for k in range(1, longest):
        runs.append(F.concat(runs[-1], F.lit(" "), F.get("words", F.col("at") + k)))
    return rows.select(*own, "words", F.posexplode_outer("words").alias("at", "word")).select(*own, F.explode(F.array(*runs)).alias("gram"))


def grams_of(words: int, longest: int = LONGEST) -> int:
    """How many n-grams a text of so many words has; it grows with every word, so it tells whether a text has them."""
    return sum(max(0, words - k) for k in range(longest))


def bucket(gram: Column, buckets: int) -> Column:
    return F.crc32(gram) % buckets


def counts(texts: DataFrame, text: str, buckets: int, longest: int, name: str) -> DataFrame:
    each = grams(texts.select(words(texts[text]).alias("words")), longest).where("gram is not null")
    return each.groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def gain_table(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text: str = "text", target_text: str = "text") -> DataFrame:
    """(bucket, s, t, gain) for each bucket: its count in the documents, in the targets, and 1000 times the log ratio, floored."""
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(counts(docs, text, buckets, longest, "s"), "bucket", "left").join(counts(targets, target_text, buckets, longest, "t"), "bucket", "left")
    both = stored(both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "resampling-counts")
    all_s, all_t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s, t = (F.col(c).cast("double") for c in "st")
    ratio = ((t + 1) * float(all_s + buckets)) / ((s + 1) * float(all_t + buckets))
    return both.select("bucket", "s", "t", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel number from the id's hash, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, 1 for the first in the given order, by a sort in ranges."""
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "resampling-order")
    # The id is the partition's number above 33 bits of the place in it.
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row for each partition of the sort
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + place + 1).drop("_part", "_before", "_at")


def resample(
    docs: DataFrame,
    targets: DataFrame,
    seed: int = 7,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row; ``rank`` is null where the row isn't drawn."""
    gains = gain_table(docs, targets, buckets, longest, text, target_text).select("bucket", "gain")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), docs[doc_id].alias("doc_id"), words(docs[text]).alias("words"))
    met = grams(rows, longest).withColumn("bucket", bucket(F.col("gram"), buckets)).join(F.broadcast(gains), "bucket", "left")
    summed = met.groupBy("_row", "doc_id").agg(F.count("gram").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    # The floored quotient of whole numbers, without a detour by doubles.
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    scored = summed.withColumn("weight", weight.cast("long")).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    scored = stored(scored.drop("gain"), "resampling-scores")
    able = F.col("n_features") >= grams_of(min_words, longest)
    drawn = scored.where(able).count() * percent // 100
    order = ranked(scored.where(able), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc(), F.col("_row").asc())
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return order.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
