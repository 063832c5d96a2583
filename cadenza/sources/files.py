"""Readers of workbooks, arrays and result files that are named by a pattern."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import parse_result_name


def sheet_cells(raw: bytes, sheet: str) -> list[dict[int, str | float | None]]:
    """The rows of a workbook's sheet by column number: texts as they are shown, numbers as floats."""
    book = zipfile.ZipFile(io.BytesIO(raw))

    def nodes(part: str, name: str) -> Iterator[ElementTree.Element]:
        return (e for e in ElementTree.fromstring(book.read(part)).iter() if e.tag.rpartition("}")[2] == name)

    def text(node: ElementTree.Element) -> str:
        return "".join(e.text or "" for e in node.iter() if e.tag.rpartition("}")[2] == "t")

    links = {e.get("Id"): e.get("Target") for e in nodes("xl/_rels/workbook.xml.rels", "Relationship")}
    ids = {e.get("name"): next(v for k, v in e.attrib.items() if k.endswith("}id")) for e in nodes("xl/workbook.xml", "sheet")}
    if sheet not in ids:
        raise ValueError(f"the workbook has no sheet {sheet!r}, but {sorted(ids)}")
    target = links[ids[sheet]]
    part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    shared = [text(e) for e in nodes("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
    rows = []
    for row in nodes(part, "row"):
        cells: dict[int, str | float | None] = {}
        for cell in (e for e in row if e.tag.rpartition("}")[2] == "c"):
            at = 0
            for letter in re.match("[A-Z]+", cell.get("r"))[0]:
                at = 26 * at + ord(letter) - 64
            value = next((e.text for e in cell if e.tag.rpartition("}")[2] == "v"), None)
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                cells[at] = text(cell)
            elif value is not None:
                cells[at] = shared[int(value)] if kind == "s" else float(value) if kind in ("n", "b") else value
        rows.append(cells)
    return rows


def read_sheet(spark: SparkSession, path: str, sheet: str, schema: str, skip: int = 0) -> DataFrame:
    """The named sheet of each workbook under ``path``, in the declared types; its header is the row after ``skip`` rows.

    Columns are found by their header, one that isn't there is null; dates are day numbers or texts. A workbook is one
    task's work, as the format can't be split."""
    fields = T._parse_datatype_string(schema)
    names = [f.name for f in fields]

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for raw in part["content"]:
                rows = sheet_cells(raw, sheet)[skip:]
                at = {str(v).strip(): k for k, v in rows[0].items()} if rows else {}
                made = {n: [r.get(at.get(n)) for r in rows[1:]] for n in names}
                yield pd.DataFrame({n: [None if v is None else str(v) for v in made[n]] for n in names}, dtype=object)

    texts = spark.read.format("binaryFile").load(path).select("content").mapInPandas(each, ", ".join(f"`{n}` string" for n in names))

    def typed(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            return F.coalesce(F.date_add(F.lit("1899-12-30").cast("date"), c.try_cast("double").cast("int")), F.substring(c, 1, 10).try_cast("date"))
        if isinstance(f.dataType, T.IntegralType):
            return c.try_cast("double").cast(f.dataType)
        if isinstance(f.dataType, T.StringType):
            return F.regexp_replace(c, r"^(-?\d+)\.0$", "$1")
        return c.try_cast(f.dataType)

    return texts.select(*(typed(f).alias(f.name) for f in fields)).where(" or ".join(f"`{n}` is not null" for n in names))


def read_npy(spark: SparkSession, path: str, steps: int, columns: int) -> DataFrame:
    """(name, step, series, value) of stored arrays of ``steps`` rows, of which the first ``columns`` columns count."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, raw in zip(part["path"], part["content"], strict=True):
                a = np.load(io.BytesIO(raw), allow_pickle=False).reshape(steps, -1)[:, :columns]
                step, series = np.indices(a.shape)
                yield pd.DataFrame({"name": name.rsplit("/", 1)[-1].removesuffix(".npy"), "step": step.ravel() + 1, "series": series.ravel(), "value": a.ravel().astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, "name string, step int, series int, value double")


def cells(line: Column) -> Column:
    """The cells of a line of CSV as an array; an empty one is null, a quoted one may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1))

    def plain(x: Column) -> Column:
        quoted = x.startswith('"') & (F.length(x) > 1)
        return F.when(quoted, F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).when(x != "", x)

    return F.transform(raw, plain)


def read_result_files(spark: SparkSession, pattern: str, deny: tuple[str, ...] = (), targets: tuple[str, ...] = ("oil_tpd", "liq_tpd")) -> DataFrame | None:
    """All result CSVs of a pattern as one frame with their model and target, which their names give.

    Files of a denied prefix or another target, and such without y_true or y_pred, are left out, the former two before they are read;
    columns that only some have are null in the others. None if no file is left. All files are one scan, in which a file is a
    row of text and its first line says what its cells are; the headers that there are come from a Spark job over the
    first lines, a row for each different one. A line is a row: cells may be quoted, but hold no line end."""
    if not spark._jvm.org.apache.hadoop.fs.Path(pattern).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)):
        return None
    name = F.col("_metadata.file_name")
    kept = F.lit(False)
    for t in targets:
        kept = kept | name.endswith(f"_{t}.csv")
    for d in deny:
        kept = kept & ~name.startswith(d)
    texts = spark.read.text(pattern, wholetext=True).where(kept).select(F.regexp_replace(name, r"\.csv$", "").alias("_name"), F.split(F.rtrim("value", F.lit("\r\n")), r"\r?\n").alias("_lines"))
    headers = texts.select(F.element_at("_lines", 1).alias("_head")).distinct().select(cells(F.col("_head")).alias("_head")).collect()
    found = [[c for c in r["_head"] if c] for r in headers]
    columns = list(dict.fromkeys(c for h in sorted(found) if {"y_true", "y_pred"} <= set(h) for c in h))
    if not columns:
        return None
    rows = texts.select("_name", F.element_at("_lines", 1).alias("_head"), F.explode(F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1)))).alias("_line"))
    rows = rows.where("_line <> ''").select("_name", cells(F.col("_head")).alias("_head"), cells(F.col("_line")).alias("_cells"))
    at = {c: F.array_position("_head", c).cast("int") for c in columns}
    rows = rows.where((at["y_true"] > 0) & (at["y_pred"] > 0))
    numbers = {"y_true", "y_pred", "q10", "q50", "q90"}

    def cell(c: str) -> Column:
        text = F.get("_cells", at[c] - 1)  # null where the file hasn't the column
        return (text.cast("double") if c in numbers else text).alias(c)

    return rows.select(*(cell(c) for c in columns), *parse_result_name("_name"))
