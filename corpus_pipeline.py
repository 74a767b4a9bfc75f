"""The corpus pipeline: documents to sampled token sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``. Columns beyond them pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm.common import fresh_path, keep
from maskwright.llm.exact_dedup import dedup_report, exact_dedup
from maskwright.llm.language_id import held_out, identify, told, train
from maskwright.llm.mixing import mix
from maskwright.llm.ngram_join import MANY, jaccard_join
from maskwright.llm.queries import REPETITIONS, piece_model
from maskwright.llm.sentencepiece_sampling import sample_segmentations

SAMPLES = 2
BATCH_ROWS = 1000  # documents that a Python worker gets at once: workers outlive their stage, so memory adds up over the stages


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``docs`` with the columns of some names put aside, and what selects its columns again."""
    kept = {c: f"_aside_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(kept), [F.col(kept.get(c, c)).alias(c) for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language can't be told: null texts, those without a letter, and those no nearer to any learned language than chance. A null ``lang`` becomes the prediction."""
    _bounded(spark)
    profiles = train(docs.where(~held_out(F.col("doc_id"))))
    docs, columns = _aside(docs, "lang_pred", "score")
    found = identify(docs, profiles).where(told(F.col("score"), F.col("lang_pred")))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*columns)


def _told_apart(docs: DataFrame) -> bool:
    """Whether every row has an id of its own."""
    return docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def _without(docs: DataFrame, gone: DataFrame, what: str) -> DataFrame:
    """``docs``, whose ids are distinct, without the ids of ``gone``; texts do not travel where these are few."""
    gone = keep(gone.select(F.col("doc_id").alias("_gone")), what)
    return docs.join(F.broadcast(gone) if gone.count() <= MANY else gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays: of the largest doc_id, without an id only if none has one."""
    _bounded(spark)
    if _told_apart(docs):
        return _without(docs, dedup_report(docs.select("doc_id", "text"), largest=True).where("not kept"), "exact-gone")
    docs, columns = _aside(docs, "keep_id", "group_size", "kept", "text_sha256")
    found = exact_dedup(docs, largest=True).where("kept or doc_id is null and keep_id is null").dropDuplicates(["text_sha256"])
    return found.select(*columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near-duplicate links connect, one row stays: of the smallest doc_id, without an id only if none has one."""
    _bounded(spark)
    if not _told_apart(docs):
        docs = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        found = jaccard_join(docs.select("_row", "doc_id", "text"), id_col="_row")
        stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")).select(F.col("first._row").alias("_stays"))
        return docs.join(stays, F.col("_row") == F.col("_stays"), "left_semi").drop("_row")
    return _without(docs, jaccard_join(docs.select("doc_id", "text")).where("doc_id <> component_id"), "near-gone")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to twice, blocks permuted anew in each pass: the rows of a file come in that order."""
    _bounded(spark)
    docs, columns = _aside(docs, "mix_epoch", "mix_block", "mix_position", "mix_key")
    return mix(docs, repetitions=REPETITIONS).select(*columns)


def sampling_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two segmentations of each document with their inclusion scores; a document that comes again (``pass`` 2, 3 ...) gets others."""
    _bounded(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    again = F.row_number().over(Window.partitionBy("doc_id", "_text").orderBy("text"))
    return sample_segmentations(rows.withColumn("pass", again), piece_model(), k=SAMPLES, pass_col="pass")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sampling_stage),
]

#: Language profiles and sampled segmentations are beyond SQL; tests/llm holds brute-force versions against each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name, stage in STAGES:
            path = fresh_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    return docs
