"""Field escaping for tab-separated files, with built-in expressions only.

`\\N` alone is NULL, an empty field is the empty string, and backslash, tab,
carriage return and newline inside a field are written as two characters.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TOKEN = "\\N"
# Stands for an escaped backslash while the other escapes are undone.
_MARK = "\u0001"


def _swap(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def escape_field(x: Column) -> Column:
    text = x.cast("string")
    for raw, written in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        text = _swap(text, raw, written)
    return F.coalesce(text, F.lit(NULL_TOKEN))


def unescape_field(x: Column) -> Column:
    """Inverse of `escape_field`; rows holding the mark take the exact slow path."""
    text = _swap(x, "\\\\", _MARK)
    for written, raw in (("\\t", "\t"), ("\\r", "\r"), ("\\n", "\n"), (_MARK, "\\")):
        text = _swap(text, written, raw)
    # A field that itself holds the mark is undone between escaped backslashes.
    pieces = F.transform(F.split(x, r"\\\\"), lambda p: _swap(_swap(_swap(
        p, "\\t", "\t"), "\\r", "\r"), "\\n", "\n"))
    exact = F.array_join(pieces, "\\")
    plain = F.when(F.contains(x, F.lit(_MARK)), exact).otherwise(text)
    return F.when(x == F.lit(NULL_TOKEN), F.lit(None).cast("string")).otherwise(plain)


def fields_of(line: str, types: Mapping[str, str | T.DataType]) -> list[Column]:
    """The typed fields of a tab-separated line."""
    parts = F.split(line, "\t", -1)
    return [unescape_field(F.get(parts, F.lit(i))).cast(t).alias(c) for i, (c, t) in enumerate(types.items())]
