"""Fill-in-middle transformation, by DuckDB SQL over Arrow batches.

A text is cut into units, which are runs of ASCII letters and single other characters. Two cut points between
units, drawn from a hash of the document's id, part it into prefix, middle and suffix, and the parts are put
together as

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text as it is

so that a model that reads on from ``<M>`` has seen what comes before and after the middle. A text is plain if it is
empty, if it holds one of the marks, or by lot. Everything is drawn from ``sha256(seed:doc_id)``: a row's form and
cuts are the same in any order, partitioning or retry.

In a task each batch is registered with an in-memory DuckDB of one thread, piece by piece of ``PIECE_BYTES`` of text,
and one SQL statement makes its rows, which go back as Arrow. Nothing is shuffled and nothing written; a lost
task is run again alone. A piece holds one text at least, so memory follows the longest text.

Defined cases: a null text is empty; a null doc_id counts as an empty one, so all such rows draw alike; rows that repeat
a doc_id draw alike, and are made row by row; bytes that aren't UTF-8 become U+FFFD; extra columns are ignored, whatever
their names; an empty table gives an empty table; texts are cut whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are registered at a time; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: The marks before prefix, suffix and middle. None may be part of another, or begin as it ends.
MARKS = ("<P>", "<S>", "<M>")

#: @LOT1@ to @LOT4@ are the first four groups of eight hexadecimal digits of a row's hash.
STATEMENT = r"""
WITH units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, sha256('@SEED@:' || coalesce(doc_id::VARCHAR, '')) AS lots
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM piece)
), cuts AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, @LOT1@ % (len(units) + 1) AS a, @LOT2@ % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '@P@') OR contains(text, '@S@') OR contains(text, '@M@') OR @LOT3@ % 100 >= @SPLIT@ THEN 'plain'
      WHEN @LOT4@ % 100 < @SPM@ THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT doc_id, n, form, CASE WHEN form = 'plain' THEN text END AS text,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, least(a, b)), '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, least(a, b) + 1, greatest(a, b)), '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, greatest(a, b) + 1, n), '') END AS suffix
  FROM cuts
)
SELECT doc_id, n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
  CASE form WHEN 'plain' THEN text
    WHEN 'spm' THEN '@S@' || suffix || '@P@' || prefix || '@M@' || middle
    ELSE '@P@' || prefix || '@S@' || suffix || '@M@' || middle END AS output
FROM parts
"""


def statement(seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS) -> str:
    """The SQL over ``piece`` (doc_id, text)."""
    made = STATEMENT
    for k in range(4):
        made = made.replace(f"@LOT{k + 1}@", f"('0x' || lots[{8 * k + 1}:{8 * k + 8}])::BIGINT")
    values = {"SEED": int(seed), "SPLIT": 100 - int(plain_percent), "SPM": int(spm_percent)}
    values |= {k: v.replace("'", "''") for k, v in zip("PSM", marks, strict=True)}
    for k, v in values.items():
        made = made.replace(f"@{k}@", str(v))
    return made


def pieces(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some ``size`` bytes of text, of a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, piece_bytes: int = PIECE_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row: the number of units, the form, code points of
    prefix and middle (null if plain), and the text in its form."""
    sql = statement(seed, plain_percent, spm_percent, marks)
    kind = docs.schema[doc_id].dataType
    rows = docs.select(docs[doc_id].alias("doc_id"), F.make_valid_utf8(docs[text]).alias("text"))
    out = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")]
        + [T.StructField("output", T.StringType())]
    )

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"}) as con:
            for batch in batches:
                for piece in pieces(batch, piece_bytes):
                    con.register("piece", pa.Table.from_batches([piece]))
                    found = con.sql(sql).to_arrow_table()
                    con.unregister("piece")
                    own = {"doc_id": piece.schema.field("doc_id").type, "form": pa.string(), "output": pa.string()}
                    yield from found.cast(pa.schema([(c, own.get(c, pa.int64())) for c in found.column_names])).to_batches()

    return rows.mapInArrow(made, out)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that was made into ``output``: exact, as no part holds a mark and none can arise where parts meet."""
    p, s, m = marks

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(output, b, 1), a, -1)

    middle = F.substring_index(output, m, -1)
    spm = F.concat(between(p, m), middle, between(s, p))
    psm = F.concat(between(p, s), middle, between(s, m))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
