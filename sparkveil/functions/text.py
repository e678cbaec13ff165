"""Text expressions: folding, collapsing, and where a pattern matches."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.dims import ACCENTED, PLAIN

SPAN = "struct<start:int,end:int,value:string>"
#: Matches that are appended one by one before they go to the whole as a block.
BLOCK = 256

_TENS = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
#: Decimal digits of all scripts, and what each stands for.
DIGITS, ASCII_DIGITS = "".join(_TENS), "".join(str(unicodedata.decimal(c)) for c in _TENS)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns added or replaced, as rows of a generator: a filter on one of them stays above it, where it
    reads the value, and is not copied below with all the work; filters on other columns go down to the scan."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def folded(c: Column) -> Column:
    """Lower case without accents: Latin letters lose theirs, combining marks go."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def folded_sql(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def ascii_digits_sql(x: str) -> str:
    """x with decimal digits of any script as 0 to 9."""
    return f"translate({x}, '{DIGITS}', '{ASCII_DIGITS}')"


def collapsed(c: Column) -> Column:
    """Stripped, with each run of white space as one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def stripped(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sql_string(value: str) -> str:
    """A literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches_sql(text: str, pattern: str) -> str:
    """array<struct<start, end, value>> of a pattern's matches, in code points, end exclusive; none for null.

    A text without a match is looked through once. With matches, the pieces between them and the matches interleave,
    so offsets are running sums of their lengths. A pattern must not match the empty string. Matches are gathered in
    blocks, so the cost of appending does not grow with their square.
    """
    rx = sql_string(pattern)
    none = f"cast(array() as array<{SPAN}>)"
    pieces = f"zip_with(split({text}, {rx}, -1), f, (p, m) -> struct(p, m))"
    one = "struct(a.at + length(x.p) as start, a.at + length(x.p) + length(x.m) as end, x.m as value)"
    full = f"size(a.now) >= {BLOCK}"
    grown = f"struct(a.at + length(x.p) + length(x.m) as at, if({full}, array({one}), array_append(a.now, {one})) as now, if({full}, array_append(a.done, a.now), a.done) as done)"
    zero = f"struct(0 as at, {none} as now, cast(array() as array<array<{SPAN}>>) as done)"
    offsets = f"aggregate({pieces}, {zero}, (a, x) -> if(x.m is null, a, {grown}), a -> flatten(array_append(a.done, a.now)))"
    return f"element_at(transform(array(regexp_extract_all({text}, {rx}, 0)), f -> if(size(f) > 0, {offsets}, {none})), 1)"


def matches(text: str, pattern: str) -> Column:
    """The matches in a column, or in the value of a SQL expression."""
    return F.expr(matches_sql(text, pattern))


def literal_pattern(term: str) -> str:
    """A pattern for a term's words with any white space between them."""
    return r"(?U)" + r"\s+".join(r"\Q" + part.replace(r"\E", r"\E\\E\Q") + r"\E" for part in term.split())


def trim_edges(start: Column, end: Column, value: Column, junk: str = " \t\n\r.,;:()[]—-–") -> tuple[Column, Column]:
    """A span's bounds without junk characters at its edges."""
    left = F.length(value) - F.length(F.ltrim(value, F.lit(junk)))
    right = F.length(value) - F.length(F.rtrim(value, F.lit(junk)))
    return start + left, F.greatest(end - right, start + left)
