"""Model entities: a table or a column of labelled spans in code points, and how it becomes candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.registry import DOCUMENT_LABELS, MODEL_LABELS
from maskwright.functions.spans import CANDIDATE, bound, let
from maskwright.sources.schema import checked

SCHEMA = "doc_id long, label string, start_cp int, end_cp int, confidence double, model string"


# The shape of a model's answer, as a JSON Schema.
_FIELDS = {"label": {"type": "string"}, "start": {"type": "integer"}, "end": {"type": "integer"}, "confidence": {"type": "number"}, "model": {"enum": ["rubert", "gliner"]}}
ANSWER_SCHEMA = {
    "type": "object", "required": ["entities"], "additionalProperties": False,
    "properties": {"entities": {"type": "array", "items": {"type": "object", "required": list(_FIELDS), "properties": _FIELDS, "additionalProperties": False}}},
}


def answers(docs: DataFrame, answer: str = "answer") -> DataFrame:
    """``docs`` with ``error`` and ``entities`` (label, start_cp, end_cp, confidence, model) of the JSON text ``answer``.

    ``invalid_response`` and null entities where the answer has another
    shape: no JSON or more than one value, an unknown key anywhere, a field
    that is missing, null or of another kind, a place that is not written as
    a whole number or is beyond 32 bits, an unknown model. A null answer is
    ``unavailable``. Offsets and labels are judged by ``model_candidates``.
    """
    wire = "entities array<struct<label:string,start:int,end:int,confidence:double,model:string>>"
    rows = checked(docs, ANSWER_SCHEMA, answer, "_breaches").withColumn("_wire", F.from_json(answer, wire)["entities"])
    bad = (F.size("_breaches") > 0) | F.col("_wire").isNull() | F.exists("_wire", lambda e: e["start"].isNull() | e["end"].isNull() | e["confidence"].isNull())
    error = F.when(F.col(answer).isNull(), "unavailable").when(bad, "invalid_response")
    entity = lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start_cp"), e["end"].alias("end_cp"), e["confidence"].alias("confidence"), e["model"].alias("model"))
    return rows.withColumn("error", error).withColumn("entities", F.when(F.col("error").isNull(), F.transform("_wire", entity))).drop("_breaches", "_wire")


def answered(docs: DataFrame, answer: str = "answer") -> DataFrame:
    """The table of model entities (``SCHEMA``) of the documents whose answer is sound."""
    return entities_of(answers(docs, answer))


def entities_of(said: DataFrame) -> DataFrame:
    """The same from what ``answers`` gave; where that is used more than once, keep it first (``shared.kept``)."""
    return said.select(F.col("doc_id").cast("long"), F.inline("entities")).select("doc_id", "label", "start_cp", "end_cp", "confidence", "model")


def resolved_type() -> Column:
    """The type of (model, label), null where unknown."""
    out = F.lit(None).cast("string")
    for (model, label), kind in MODEL_LABELS.items():
        out = F.when((F.col("model") == model) & (F.col("label") == label), kind).otherwise(out)
    return out


def labelled(model_entities: DataFrame) -> DataFrame:
    """Rows with their type, the document label's type, and whether a document has a row without one of its fields or with a label that neither knows (it then fails as a whole)."""
    document = F.lit(None).cast("string")
    for label, kind in DOCUMENT_LABELS.items():
        document = F.when((F.col("model") == "rubert") & (F.col("label") == label), kind).otherwise(document)
    rows = model_entities.withColumns({"type": resolved_type(), "document_type": document})
    partial = F.col("label").isNull() | F.col("start_cp").isNull() | F.col("end_cp").isNull() | F.col("confidence").isNull() | F.col("model").isNull()
    unknown = F.max(((F.col("type").isNull() & F.col("document_type").isNull()) | partial).cast("int"))
    failed = rows.groupBy("doc_id").agg(unknown.alias("failed"))
    return rows.join(failed, "doc_id").withColumn("failed", F.col("failed") == 1)


def model_candidates(model_entities: DataFrame, docs: DataFrame, validated: DataFrame | None = None) -> DataFrame:
    """(doc_id, models: array of candidates) with byte offsets.

    Rows with an empty label, offsets out of order or out of the text, or a
    confidence outside 0..1 are left out; a document with an unknown label or
    model gives none. Document labels count only on a span that a rule has
    validated (``validated``: doc_id, type, start_byte, end_byte).
    """
    sound = "label IS DISTINCT FROM '' AND NOT coalesce(start_cp < 0 OR end_cp < start_cp OR confidence NOT BETWEEN 0 AND 1, false)"
    rows = labelled(model_entities.where(sound)).where("NOT failed")
    rows = rows.join(docs.select("doc_id", "text"), "doc_id").where(F.col("end_cp") <= F.length("text"))
    at = lambda c: F.octet_length(F.substring("text", F.lit(1), F.col(c))).cast("bigint")
    rows = rows.select("doc_id", F.coalesce("type", "document_type").alias("type"), F.col("type").isNull().alias("document"), at("start_cp").alias("start_byte"), at("end_cp").alias("end_byte"), F.col("start_cp").alias("cstart"), F.col("end_cp").alias("cend"), "confidence", "model")
    if validated is not None:
        sure = rows.where("document").join(validated.select("doc_id", "type", "start_byte", "end_byte").distinct(), ["doc_id", "type", "start_byte", "end_byte"], "left_semi")
        rows = rows.where("NOT document").unionByName(sure)
    else:
        rows = rows.where("NOT document")
    one = F.struct("type", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "cstart", "cend", "confidence", F.array("model").alias("sources"))
    return rows.groupBy("doc_id").agg(F.collect_list(one).cast(f"array<{CANDIDATE}>").alias("models"))


def with_models(docs: DataFrame, said: Column, validated: str, text: str = "text", to: str = "models") -> DataFrame:
    """``docs`` with what ``model_candidates`` gives, from an array column of model entities (label, start_cp, end_cp, confidence, model) and one of validated candidates in the same row: nothing is shuffled and no text is read twice."""
    of = lambda known: "CASE " + " ".join(f"WHEN m.model = '{model}' AND m.label = '{label}' THEN '{kind}'" for (model, label), kind in known.items()) + " END"
    sound = "filter(said_, m -> m.label IS DISTINCT FROM '' AND NOT coalesce(m.start_cp < 0 OR m.end_cp < m.start_cp OR m.confidence NOT BETWEEN 0 AND 1, false))"
    typed = f"transform({sound}, m -> named_struct('m', m, 'type', {of(MODEL_LABELS)}, 'document', {of({('rubert', k): v for k, v in DOCUMENT_LABELS.items()})}))"
    failed = "exists(t_, x -> (x.type IS NULL AND x.document IS NULL) OR x.m.label IS NULL OR x.m.start_cp IS NULL OR x.m.end_cp IS NULL OR x.m.confidence IS NULL OR x.m.model IS NULL)"
    at = lambda place: f"CAST(octet_length(substring({text}, 1, x.m.{place})) AS BIGINT)"
    one = f"named_struct('type', coalesce(x.type, x.document), 'start', {at('start_cp')}, 'end', {at('end_cp')}, 'cstart', x.m.start_cp, 'cend', x.m.end_cp, 'confidence', x.m.confidence, 'sources', array(x.m.model))"
    placed = f"transform(filter(t_, x -> x.m.end_cp <= length({text})), x -> named_struct('c', {one}, 'sure', x.type IS NOT NULL))"
    held = f"filter({placed}, p -> p.sure OR exists({validated}, v -> v.type = p.c.type AND v.start = p.c.start AND v.end = p.c.end))"
    none = f"CAST(array() AS array<{CANDIDATE}>)"
    found = let(typed, "t_", f"CASE WHEN {failed} THEN {none} ELSE CAST(transform({held}, p -> p.c) AS array<{CANDIDATE}>) END")
    return bound(bound(docs, "said_", said), to, F.expr(f"CASE WHEN size(said_) > 0 THEN {found} ELSE {none} END")).drop("said_")
