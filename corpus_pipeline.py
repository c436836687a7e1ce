"""The corpus pipeline: documents to token files in five stages, each written and read again.

Each stage judges rows, not ids: rows without doc_id and rows that share one are documents of their
own, kept or dropped by their own text. Null and blank texts fail the quality rules. Equal rows are
copies, of which the near-duplicates stage leaves one. An empty table passes every stage as an empty one.
Columns besides those of documents are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import decontaminate, mixing, near_dedup, quality, token_files
from riskweave.llm.common import shared_dir
from riskweave.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of all tokens that the mix draws.
DRAW = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality(docs.select(COLUMNS), carry=COLUMNS).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id (of several texts under it, the one with the least hash; of equal rows, one). Blank texts are in no group and stay."""
    found = near_dedup.near_duplicates(docs, detailed=True)
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("row"))
    # ids may be null; within one struct column null equals null, and join and de-duplication share a partitioning
    first = first.select(F.struct(F.col("row.doc_id").alias("doc_id"), F.col("row.mark").alias("mark")).alias("_key"))
    mark = F.xxhash64(F.col("text").cast("string"))
    blank = ~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    keyed = docs.where(~blank).select(*COLUMNS, F.struct(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark")).alias("_key"))
    groups = keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"])
    return groups.select(COLUMNS).unionByName(docs.where(blank).select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontaminate.contamination(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return found.where(~decontaminate.contaminated()).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents as the calibrated mix draws them: each as often as it is wanted, whole times and once more with the chance of the rest, so that cells smaller than their share reach it in expectation. Rows without an id are drawn each for itself."""
    drawn = mixing.mixed_sample(docs.select(COLUMNS), draw=DRAW, carry=COLUMNS).where("n_words > 0").withColumn("_wanted", F.col("probability") * F.col("weight"))
    total, uncapped = drawn.agg(F.sum("n_words"), F.sum(F.col("_wanted") * F.col("n_words"))).head()
    # the operator's scale makes up for capped cells; here none is capped
    wanted = F.col("_wanted") * F.lit(DRAW * total / uncapped if uncapped else 0.0)
    copies = (F.floor(wanted) + (mixing.drawn_at(F.lit("copies")) < wanted - F.floor(wanted)).cast("long")).cast("int")
    return drawn.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).select(COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents; a row per document, read back from them."""
    index, folder = token_files.write_tokens(docs, tokenizer_path("word_bpe_49k.json"))
    return token_files.read_tokens(index, folder)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("source mix", source_mix), ("token files", token_output)]

#: Estimation, components and files are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{place}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{place}/{k}")
    return docs
