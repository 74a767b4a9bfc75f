"""Labelled corpora from JSON, and what must hold of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.schema import checked

SCHEMA = (
    "version string, offset_unit string, cases array<struct<id:string, input:string, expected_mask:string, "
    "spans:array<struct<type:string, start:int, end:int, value:string, personal:boolean, mask_token:string>>>>"
)



def _object(required: str, optional: str = "", **properties: dict) -> dict:
    names = (*required.split(), *optional.split())
    return {"type": "object", "required": required.split(), "properties": {n: properties.get(n, {"type": "string"}) for n in names}, "additionalProperties": False}


# The shape of a corpus file, as a JSON Schema.
_WORD, _PLACE = {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 0}
_SPAN = _object("type start end value personal", "mask_token", type=_WORD, start=_PLACE, end=_PLACE, personal={"type": "boolean"})
_CASE = _object("id input expected_mask spans", id=_WORD, spans={"type": "array", "items": _SPAN})
FILE_SCHEMA = _object("version offset_unit cases", version={"type": "string", "const": "1"}, offset_unit={"type": "string", "const": "utf8_byte"}, cases={"type": "array", "items": _CASE})


def shape_problems(spark: SparkSession, path: str, schema: dict = FILE_SCHEMA) -> DataFrame:
    """(file, path, keyword): where a file breaches the JSON Schema of corpora."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    return checked(raw, schema).select("file", F.inline("breaches"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(version, offset_unit, id, input, expected_mask, spans) of each case; a file of another shape fails."""
    bad = shape_problems(spark, path).limit(5).collect()
    if bad:
        raise ValueError("not a corpus: " + ", ".join(f"{r.file} ({r.keyword} at {r.path or '/'})" for r in bad))
    raw = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path, multiLine=True)
    return raw.select("version", "offset_unit", F.explode("cases").alias("c")).select("version", "offset_unit", "c.*")


def problems(cases: DataFrame) -> DataFrame:
    """(id, problem): version and unit, ids empty or repeated, spans out of bounds, values that are not the text's bytes, mask tokens that do not go with personal spans or are missing from the mask, overlapping spans."""
    bytes_at = "CAST(substring(encode(input, 'UTF-8'), s.start + 1, s.end - s.start) AS STRING)"
    tests = {
        "version": "version IS DISTINCT FROM '1' OR offset_unit IS DISTINCT FROM 'utf8_byte'",
        "id": "coalesce(id, '') = '' OR n_ids > 1",
        "bounds": "exists(spans, s -> s.start < 0 OR s.end <= s.start OR s.end > octet_length(input))",
        "value": f"exists(spans, s -> s.start >= 0 AND s.end > s.start AND s.end <= octet_length(input) AND hex({bytes_at}) <> hex(s.value))",
        "mask_token": "exists(spans, s -> s.personal <> (s.mask_token IS NOT NULL) OR (s.mask_token IS NOT NULL AND NOT contains(expected_mask, s.mask_token)))",
        "overlap": "exists(transform(spans, (s, i) -> struct(s, i)), x -> exists(transform(spans, (s, i) -> struct(s, i)), y -> x.i < y.i AND x.s.start < y.s.end AND y.s.start < x.s.end))",
    }
    counts = cases.groupBy("id").agg(F.count("*").alias("n_ids"))
    rows = cases.join(counts, cases.id.eqNullSafe(counts.id), "left").drop(counts.id)
    found = F.array(*[F.when(F.coalesce(F.expr(t), F.lit(True)), k) for k, t in tests.items()])
    return rows.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))
