"""Request tables: JSON bodies to columns, with an error column in place of a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 8 << 20
_END = "end of the body"


def decoded(raw: DataFrame, required: tuple[str, ...], optional: tuple[str, ...] = (), body: str = "body", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``raw`` with a string column for each field and ``error``.

    The body (text or bytes) is one JSON object. ``error`` is ``too_large``
    beyond ``most_bytes``, ``encoding`` where the bytes are no UTF-8,
    ``json`` where there is no object or anything beside it or a field is
    no string, ``blank`` where a required field is missing or has white space
    only, else null. Fields of a row with an error are null. Other keys are
    ignored; a null body is ``json``.
    """
    names = (*required, *optional)
    text = F.col(body).cast("string")
    valid = F.is_valid_utf8(text)
    # the parser stops after the first value; in a list with an end mark, anything beside that value shows
    listed = F.try_parse_json(F.when(valid & (F.octet_length(body) <= most_bytes), F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))))
    parsed = F.when(F.try_variant_get(listed, "$[1]", "string") == _END, F.try_variant_get(listed, "$[0]", "variant"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    value = {n: F.try_variant_get(parsed, f"$.{n}", "string") for n in names}
    strings = F.lit(True)
    for n in names:
        strings = strings & F.coalesce(kind(f"$.{n}").isin("STRING", "VOID"), F.lit(True))
    blank = F.lit(False)
    for n in required:
        blank = blank | (F.regexp_replace(F.coalesce(value[n], F.lit("")), r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", "") == "")
    error = (
        F.when(F.octet_length(body) > most_bytes, "too_large").when(~F.coalesce(valid, F.lit(True)), "encoding").when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "json").when(~F.coalesce(strings, F.lit(True)), "json").when(blank, "blank")
    )
    out = raw.withColumn("error", error)
    return out.withColumns({n: F.when(F.col("error").isNull(), v) for n, v in value.items()})


def correlation_id() -> Column:
    """A new identifier for a request: req_ and 32 random hexadecimal digits."""
    return F.concat(F.lit("req_"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))
