"""Line dedup: lines that many documents share lose all their places.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Lines
travel as 128-bit key hashes with their document and position, never as text:

1. the texts are read once for their hashes, which are stored, range-partitioned by (hash, document) and
   sorted by (hash, document, position), so that a line that a third of all documents share is spread over
   many partitions;
2. each partition streams the first occurrence in every document and counts documents per hash; the
   counts of a hash that spans partitions are summed from one row per partition;
3. the sorted places stay where they were counted: a second scan of them picks those of the hashes found in
   at least ``min_docs`` documents, by a broadcast of these hashes if they are ``FEW``, and returns them as one
   compressed keep bitmap per document: words of 64 lines, those with all lines kept left out.

Texts move only once, to meet their bitmaps.

Defined cases: a null text counts as empty, one empty line; a document is a distinct doc_id (null is
one, too), and rows that repeat a doc_id are counted once per line and rewritten row by row (rows alike in
doc_id and text are one row with copies: what is spared in it is spared in each copy); texts are split
whole, however long; empty keys
are never dropped when ``min_chars`` is 1; extra columns are kept, save that ``n_lines`` and
``n_dropped`` are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, let, met, stored

#: Shared hashes that are broadcast, of 32 bytes each; more are joined by shuffle, hot ones in parts.
FEW = 200_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACES))
    # lower() also changes letters outside A-Z, so it serves lines of ASCII only.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _row(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc, row, bitmap) for each document that loses a line.

    ``row`` is a hash of the text, which tells rows of one doc_id apart. ``bitmap`` is an array of
    (word, bits) in ascending order: bit ``i`` of ``bits`` keeps line ``64 * word + i``; absent words
    keep all their lines. ``keep_first`` spares the first place, by (doc, row, pos), of each line.
    """
    body = F.coalesce(docs[text], F.lit(""))

    def hashes(line: Column) -> Column:
        return let(line_key(line), lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))

    lines = (
        docs.select(docs[doc_id].alias("doc"), _row(docs[text]).alias("row"), F.posexplode(F.transform(F.split(body, "\n"), hashes)).alias("pos", "h"))
        .where("h is not null")
        .select("h.h1", "h.h2", "doc", "row", "pos")
    )
    within = Window.partitionBy("h1", "h2", "doc").orderBy("pos", "row")
    ranged = stored(lines, "lines").repartitionByRange("h1", "h2", "doc")
    sorted_lines = stored(ranged.withColumn("first", F.row_number().over(within) == 1), "lines-sorted")
    placed = F.struct("doc", "row", "pos")
    counted = [F.sum(F.col("first").cast("long")).alias("n")] + [F.min(placed).alias("spared")] * keep_first
    shared = stored(sorted_lines.groupBy("h1", "h2").agg(*counted).where(F.col("n") >= min_docs).drop("n"), "lines-shared")
    if shared.limit(FEW + 1).count() <= FEW:
        found = sorted_lines.join(F.broadcast(shared), ["h1", "h2"])
    else:
        found = met(sorted_lines, ["h1", "h2"], "doc", shared)
    words = (
        (found.where(~F.col("spared").eqNullSafe(placed)) if keep_first else found)
        .groupBy("doc", "row", F.shiftright("pos", 6).alias("word"))
        .agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos & 63)"))).alias("bits"))
    )
    return words.groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def _kept(lines: Column, bitmap: Column) -> Column:
    def dense(words: Column) -> Column:
        def gap(w: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(words, i - 1)["word"]).otherwise(F.lit(-1))
            return F.concat(F.array_repeat(F.lit(-1).cast("long"), w["word"] - before - 1), F.array(w["bits"]))

        return F.flatten(F.transform(words, gap))

    def bit(bits: Column, i: Column) -> Column:
        return F.getbit(F.coalesce(F.get(bits, F.shiftright(i, 6)), F.lit(-1).cast("long")), i.bitwiseAND(63))

    return let(let(bitmap, dense), lambda bits: F.filter(lines, lambda _, i: bit(bits, i) == 1))


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the kept lines as ``text``, ``n_lines`` before dropping and ``n_dropped``."""
    bitmaps = keep_bitmaps(docs, min_docs, min_chars, keep_first, doc_id, text).select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), "bitmap")
    own = [c for c in docs.columns if c.lower() not in {"n_lines", "n_dropped", "bitmap", "_doc", "_row"}]
    held = docs.select(*own)
    joined = held.join(bitmaps, held[doc_id].eqNullSafe(F.col("_doc")) & (_row(held[text]) == F.col("_row")), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    kept = F.when(F.col("bitmap").isNull(), body).otherwise(F.array_join(_kept(F.split(body, "\n"), F.col("bitmap")), "\n"))
    dropped = F.aggregate("bitmap", F.lit(0).cast("long"), lambda s, w: s + 64 - F.bit_count(w["bits"]))
    return joined.select(
        *(kept.alias(c) if c == text else F.col(f"`{c}`") for c in own),
        (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"),
    )
