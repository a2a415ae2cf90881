"""Tolerant JSON: find the object in model-written text and read typed fields out of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.text import strip

_NO_TEXT = "array<string>"


def json_candidate(text: Column) -> Column:
    """The fenced object if there is a fence, else the text from the first { to the last }."""
    fenced = F.regexp_extract(text, fixed.JSON_FENCE, 1)
    start = F.locate("{", text)
    end = F.length(text) - F.locate("}", F.reverse(text)) + 1
    has_braces = (start > 0) & F.contains(text, F.lit("}")) & (end > start)
    bare = F.when(has_braces, F.substring(text, start, end - start + 1)).otherwise(F.lit(""))
    return F.when(fenced != "", fenced).otherwise(bare)


def json_object(text: Column) -> Column:
    """VARIANT object found in the text. No object, or JSON that does not parse, gives `{}`."""
    parsed = F.try_parse_json(json_candidate(F.coalesce(text, F.lit(""))))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(is_object, parsed).otherwise(F.parse_json(F.lit("{}")))


def text_field(obj: Column, name: str) -> Column:
    return F.try_variant_get(obj, f"$.{name}", "string")


def year_field(obj: Column) -> Column:
    """Whole year: numbers are truncated, text must be an integer, anything else is 0."""
    raw = F.try_variant_get(obj, "$.year", "variant")
    kind = F.schema_of_variant(raw)
    as_text = strip(F.try_variant_get(obj, "$.year", "string"))
    return F.coalesce(
        F.when(kind == "STRING", F.when(as_text.rlike(r"^[+-]?\d+$"), as_text.try_cast("int")))
        .otherwise(F.try_variant_get(obj, "$.year", "int")),
        F.lit(0),
    )


def _falsy(kind: Column, as_text: Column) -> Column:
    return (
        as_text.isNull()
        | (kind == "VOID")
        | ((kind == "STRING") & (as_text == ""))
        | ((kind == "BOOLEAN") & (as_text == "false"))
        | (kind.startswith("OBJECT") & (as_text == "{}"))
        | (as_text.try_cast("double") == 0) & ~kind.isin("STRING", "BOOLEAN")
    )


def list_field(obj: Column, name: str, element: str = "string") -> Column:
    """List as it is; a single value becomes a list of one; a falsy value or no value is []."""
    path = f"$.{name}"
    raw = F.try_variant_get(obj, path, "variant")
    kind = F.schema_of_variant(raw)
    as_text = F.try_variant_get(obj, path, "string")
    one = F.array(F.try_variant_get(obj, path, element))
    empty = F.array().cast(f"array<{element}>")
    return F.coalesce(
        F.when(kind.startswith("ARRAY"), F.try_variant_get(obj, path, f"array<{element}>"))
        .when(_falsy(kind, as_text), empty)
        .otherwise(one),
        empty,
    )


def evidence_field(obj: Column) -> Column:
    """Evidence spans as array<struct<quote, page, char_range>>, from objects or bare values."""

    def span(v: Column) -> Column:
        is_object = F.schema_of_variant(v).startswith("OBJECT")
        quote = F.when(is_object, F.try_variant_get(v, "$.quote", "string")).otherwise(
            F.try_variant_get(v, "$", "string")
        )
        return F.struct(
            strip(F.coalesce(quote, F.lit(""))).alias("quote"),
            F.when(is_object, F.try_variant_get(v, "$.page", "int")).alias("page"),
            F.when(is_object, F.try_variant_get(v, "$.char_range", "array<int>")).alias("char_range"),
        )

    return F.transform(list_field(obj, "evidence_spans", "variant"), span)


def quotes(spans: Column) -> Column:
    """The non-empty quotes of an evidence list, in order."""
    trimmed = F.transform(
        F.coalesce(spans, F.array()), lambda s: strip(F.coalesce(s["quote"], F.lit("")))
    )
    return F.filter(trimmed, lambda q: q != "")
