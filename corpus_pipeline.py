"""A corpus from raw documents to packed training sequences.

Each stage takes all that the one before kept, and is written as Parquet and read again in between:

1. quality rules: documents that the threshold table rejects go;
2. line dedup: lines that at least 10 documents share stay in the first place only, so that
   boilerplate goes and a passage that was copied keeps one home;
3. SimHash near-dedup: of each group of near copies the document with the smallest id stays;
4. packing: the documents become windows of 4096 tokens with the sources' shares in each.

Rows that repeat a doc_id stay or go together; rows without a doc_id aren't removed by stage 3. Null
texts and empty tables are treated as the operators say; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import common, line_dedup, packing, quality_rules, queries, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = docs.select(F.struct("*").alias("_row"), "text")
    return quality_rules.judge(held).where("kept").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    held = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(f"`{c}`" for c in others)).alias("_others"))
    done = line_dedup.drop_lines(held, keep_first=True).withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*(F.col(f"_others.`{c}`") if c in others else F.col(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = simhash.near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer=queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("packing", pack)]

#: SQL has neither XXH64 nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"pipeline-{k}")
    return docs
