"""Five stages from raw documents to a training mixture.

Each stage reads what its predecessor wrote as Parquet in the shared folder.
In every stage documents with a null or empty text, a null doc_id or a null
source stay documents, texts of any length are read whole, columns beside
COLUMNS are ignored whatever their names, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import decontaminate, mixing, near_dedup, quality, secret_scan
from panelweave.llm.common import held_out
from panelweave.plans.storage import drop, durable, written

#: Documents whose quality score is under this are rejected.
LEAST_QUALITY = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the compression classifier accepts; score and filter are one pass.

    A null or empty text has the score of a difference of 0. Rows are judged
    one by one, repeated ones alike, on their own text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = spark.sparkContext.broadcast(quality.fit_quality(docs, labels, ~held_out("doc_id", 5, 0)))
    return quality.filter_quality(docs.select(*COLUMNS), model, LEAST_QUALITY)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the least doc_id, of each near-duplicate class.

    Rows of one doc_id are one document, of which one row stays. Texts without
    words are duplicates of nothing, and rows with a null doc_id all stay.
    """
    own = docs.select(*COLUMNS)
    groups = near_dedup.near_duplicates(own, threshold=0.8)
    gone = groups.filter("not kept").select("doc_id").distinct()
    return near_dedup.drop_repeated_ids(own.join(gone, "doc_id", "left_anti")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a window like a benchmark item; rows with a null doc_id and texts without words stay."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the text; n_chars follows. No row goes, and a null text stays null."""
    clean = secret_scan.redact(secret_scan.scan_secrets(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents at their sources' rates; copy numbers the repeats from 1.

    A null source is a source of its own, the last in order; sources without
    any word have no copies; rows that share a doc_id share their draw.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS, "copy")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("mixture", mixture_stage),
]
#: SQL cannot express the compression classifier; tests compare run() with plain Python, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what a stage wrote on its way goes once its result is written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        before = written(spark)
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        made = [p for p in written(spark) if p not in before]
        drop(spark, [*read, *made[:-1]])
        read = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
