"""Text functions in Catalyst expressions; positions count code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE, WORD = r"\s\x1c-\x1f\x85\p{Z}", r"\p{L}\p{N}_"
#: What the shorthands of a pattern stand for in Unicode text
_WIDE = {
    "d": r"\p{Nd}", "s": f"[{SPACE}]", "S": f"[^{SPACE}]", "w": f"[{WORD}]",
    "b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
}


def wide(pattern: str) -> str:
    """The pattern with its digits, spaces, words and letter cases taken from all of Unicode."""
    return re.sub(r"\\([dsSwb])", lambda m: _WIDE[m[1]], pattern).replace("(?i)", "(?iu)")


def lstrip(col: Column) -> Column:
    """Without white space at the start."""
    return F.regexp_replace(col, wide(r"^\s+"), "")


def strip(col: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col, wide(r"^\s+|\s+$"), "")


def rstrip(col: Column, chars: str) -> Column:
    """Without any of ``chars`` at the end."""
    return F.regexp_replace(col, f"[{re.escape(chars)}]+$", "")


def or_else(col: Column, other: Column) -> Column:
    """``col`` unless it is null or empty."""
    return F.coalesce(F.nullif(col, F.lit("")), other)


def paragraphs_of(text: Column, break_: str) -> Column:
    """Stripped, non-empty paragraphs; the whole text if there is none."""
    found = F.filter(F.transform(F.split(text, wide(break_)), strip), lambda p: p != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def let(value: Column, f) -> Column:
    """f(value), with ``value`` evaluated once although lambdas inside ``f`` use it often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def in_list(col: Column, values: list[str]) -> Column:
    return col.isin(*values)


def lookup(col: Column, pairs: dict[str, str]) -> Column:
    """The value of a fixed map, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), col)
