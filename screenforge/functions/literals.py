"""Lists written as Python literal text, as CSV files of candidates hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenforge.functions.text import strip

_JSON_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def only_item(parsed: Column) -> Column:
    """The item of an array that has exactly one, else null; evaluates ``parsed`` once."""
    return F.get(F.get(F.filter(F.array(parsed), lambda items: F.cardinality(items) == 1), F.lit(0)), F.lit(0))


def _list_items(c: Column) -> Column:
    """Items of exactly one bracketed list, else null."""
    # The outer bracket makes trailing text a parse error instead of being ignored.
    return only_item(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<array<string>>", _JSON_OPTIONS))


def parse_list_literal(c: Column) -> Column:
    """Literal text to ``array<string>``.

    A list gives its items as text; another literal (quoted text, number, tuple, dict, True,
    False, None) gives one item; anything unreadable, and null, gives ``[]``.
    """
    s = strip(c)
    # Constants JSON does not know, and a comma before the closing bracket.
    adapted = F.regexp_replace(s, r"(?<=[\[,] ?)None(?= ?[\],])", "null")
    adapted = F.regexp_replace(adapted, r"(?<=[\[,] ?)(True|False)(?= ?[\],])", '"$1"')
    adapted = F.regexp_replace(adapted, r",\s*\]\z", "]")
    quoted = F.regexp_extract(s, r"(?s)\A(['\"])(.*)\1\z", 2)
    is_quoted = s.rlike(r"(?s)\A(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\")\z")
    is_other = s.rlike(r"(?s)\A(?:[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|True|False|None|\(.*\)|\{.*\})\z")
    items = (
        F.when(s.rlike(r"(?s)\A\[.*\]\z"), F.coalesce(_list_items(s), _list_items(adapted)))
        .when(is_quoted, F.array(F.regexp_replace(quoted, r"\\(['\"\\])", "$1")))
        .when(is_other, F.array(s))
    )
    return F.coalesce(items, F.array().cast("array<string>"))


def format_list_literal(arr: Column) -> Column:
    """``array<string>`` to literal text; null becomes ``[]``."""

    def quote(x: Column) -> Column:
        body = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        for char, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            body = F.replace(body, F.lit(char), F.lit(escape))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return (
            F.when(x.isNull(), F.lit("None"))
            .when(double, F.concat(F.lit('"'), body, F.lit('"')))
            .otherwise(single)
        )

    items = F.array_join(F.transform(arr, quote), ", ")
    return F.concat(F.lit("["), F.coalesce(items, F.lit("")), F.lit("]"))
