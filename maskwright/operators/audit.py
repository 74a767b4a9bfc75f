"""Audit lines: what was found, never what it said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def token_count(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("bigint")


def projected(docs: DataFrame, text: str = "text", at: str = "entities") -> DataFrame:
    """``docs`` with detected_types, sources and reason_codes (each distinct and sorted), entity_count, personal_flags in document order, has_personal_data and input_tokens."""
    flat = lambda f: F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(at, lambda e: e[f])), lambda x: x != "")))
    return docs.withColumns({
        "detected_types": F.array_sort(F.array_distinct(F.transform(at, lambda e: e["type"]))), "sources": flat("sources"), "reason_codes": flat("reasons"), "entity_count": F.size(at).cast("bigint"),
        "personal_flags": F.transform(at, lambda e: e["personal"]), "has_personal_data": F.exists(at, lambda e: e["personal"]), "input_tokens": token_count(F.col(text)),
    })


def lines(projected_docs: DataFrame, request_id: Column, operation: str, result: Column, duration_ms: Column, model_mode: str = "full") -> DataFrame:
    """(doc_id, line): one JSON object per document, keys in fixed order, for a text sink."""
    fields = {
        "request_id": request_id, "operation": F.lit(operation), "has_personal_data": F.col("has_personal_data"), "detected_types": F.col("detected_types"), "entity_count": F.col("entity_count"), "personal_flags": F.col("personal_flags"),
        "sources": F.col("sources"), "reason_codes": F.col("reason_codes"), "duration_ms": duration_ms, "model_mode": F.lit(model_mode), "result": result,
    }
    return projected_docs.select("doc_id", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("line"))
