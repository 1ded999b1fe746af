"""Model replies: cleaning and strict parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenforge.functions.literals import only_item
from screenforge.functions.text import strip
from screenforge.schemas import REPLY

PARSE_ERROR = "reply is not one JSON object"

_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def clean_json(c: Column) -> Column:
    """Drop code fences, then keep the first ``{`` to the last ``}``; without them the stripped text."""
    bare = F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(braces != "", braces).otherwise(strip(bare))


def number_in_reply(c: Column, field: str) -> Column:
    """A field of cleaned JSON text as a double where it is a JSON number; null for text and all else."""
    value = F.try_variant_get(F.try_parse_json(c), f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    is_number = (kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(is_number, F.try_variant_get(F.try_parse_json(c), f"$.{field}", "double"))


def parse_reply(c: Column) -> Column:
    """Cleaned JSON text to a struct of text fields.

    Anything but exactly one object gives a struct with only ``error`` set. The text is parsed as
    the sole item of an array, because a bare parse would accept text after the object.
    """
    as_object = F.when(F.startswith(F.ltrim(c), F.lit("{")), F.concat(F.lit("["), c, F.lit("]")))
    parsed = only_item(F.from_json(as_object, f"array<{REPLY.simpleString()}>", _STRICT))
    failed = F.struct(
        *[F.lit(PARSE_ERROR if f.name == "error" else None).cast("string").alias(f.name) for f in REPLY.fields]
    )
    return F.coalesce(parsed, failed)
