"""Queries of the span generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.catalog import Catalog
from maskwright.functions.rules import BY_NAME, RULES, Rule
from maskwright.functions.spans import rule_spans_sql, with_candidates
from maskwright.sources.synthetic import ru_docs, ru_docs_sql
from maskwright.sources.tables import spread, table


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Russian test text and the documents, whose ids are made negative."""
    docs = spread(table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
    return ru_docs(spark, sf_dir).select(F.col("doc_id").cast("bigint"), "text").unionByName(docs)


def texts_sql() -> str:
    return f"(SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM {ru_docs_sql()} UNION ALL SELECT -doc_id - 1, text FROM documents)"


def spans(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A row per candidate."""
    rows = with_candidates(docs, rules).select("doc_id", F.explode_outer("candidates").alias("c")).where("c is not null")
    return rows.select("doc_id", "c.type", F.col("c.start").alias("start_byte"), F.col("c.end").alias("end_byte"), "c.confidence", F.array_join("c.sources", ",").alias("sources"))


def register(catalog: Catalog) -> None:
    for rule in RULES:
        catalog.query(f"{rule.name}_spans", rule_spans_sql(rule, texts_sql()))(lambda spark, sf_dir, r=rule: spans(texts(spark, sf_dir), (r,)))
    every = " UNION ALL ".join(rule_spans_sql(r, "texts") for r in BY_NAME.values())
    catalog.query("all_rule_candidates", f"WITH texts AS {texts_sql()} {every}")(lambda spark, sf_dir: spans(texts(spark, sf_dir), RULES))
