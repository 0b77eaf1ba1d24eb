"""Text measures and clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond the ASCII blanks that a trim removes (fixed values).
SPACES = r"\t-\r \u0085   -     　"


def est_tokens(text: Column) -> Column:
    """Characters divided by four, rounded up."""
    return F.floor((F.char_length(text) + 3) / 4).cast("long")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+\\z", "")


def only_where(text: Column, needed: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """text, changed where a cheap test says that the change would find something; text itself is computed once."""
    return F.transform(F.array(text), lambda x: F.when(needed(x), change(x)).otherwise(x))[0]


def clean_text(text: Column) -> Column:
    """Unix line ends, no trailing blanks, at most one blank line in a row, trimmed."""
    unix = only_where(text, lambda x: x.contains("\r"), lambda x: F.regexp_replace(x, r"\r\n?", "\n"))
    blanks = lambda x: x.contains(" \n") | x.contains("\t\n") | x.endswith(" ") | x.endswith("\t")
    lines = only_where(unix, blanks, lambda x: F.regexp_replace(x, r"[ \t]+(\n|\z)", "$1"))
    few = only_where(lines, lambda x: x.contains("\n\n\n"), lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))
    return only_where(few, lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(f"[{SPACES}]"), trimmed)


def tidy_markdown(text: Column) -> Column:
    """Plain blanks for no-break ones, no zero-width characters or empty links, no trailing blanks, few blank lines."""
    plain = F.regexp_replace(F.regexp_replace(text, " ", " "), "[​‌‍﻿]", "")
    return clean_text(F.regexp_replace(plain, r"(?<!!)\[\s*\]\([^)]*\)", ""))


def escape_heading(line: Column) -> Column:
    """A leading # becomes \\#."""
    return F.regexp_replace(line, r"^( *)#", r"$1\\#")


def escape_cell(text: Column) -> Column:
    """Text of a table cell: one line, bars escaped."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"\r?\n", " "), r"\|", r"\\|"))


def tenths(n: Column, unit: int) -> Column:
    """n / unit with one decimal, halves to even, from integers alone."""
    scaled = n * 10
    q, r = F.floor(scaled / unit), scaled % unit
    up = F.when((r * 2 > unit) | ((r * 2 == unit) & (q % 2 == 1)), 1).otherwise(0)
    t = (q + up).cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def human_count(n: Column) -> Column:
    """950, 1.2k."""
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(tenths(n, 1000), F.lit("k")))


def human_bytes(n: Column, units: tuple[str, ...] = (" B", " KB", " MB", " GB")) -> Column:
    """Bytes with a unit; the largest unit takes what is left."""
    out = F.concat(n.cast("string"), F.lit(units[0]))
    for power, unit in enumerate(units[1:], 1):
        out = F.when(n >= 1024**power, F.concat(tenths(n, 1024**power), F.lit(unit))).otherwise(out)
    return out


def k_tokens(n: Column) -> Column:
    """950, 1.2k, 12k."""
    return F.when(n < 1000, n.cast("string")).when(n >= 10_000, F.concat(F.bround(n / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(F.concat(tenths(n, 1000), F.lit("k")))


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def clip(text: Column, most: int, tail: str = "…") -> Column:
    """At most so many characters, with a mark where some are gone."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(tail))).otherwise(text)


_WORD = r"[\p{L}\p{Nd}]"
#: Of Markdown, what is passed over as a whole, and the one escape that goes; each is a group of its own.
_ESCAPES = (
    r"(?md)((?s:^ *+(`{3,}+)[^\n]*+(?:\n.*?(?:^ *+\2`*+$|\z)|\z)))|((?s:^ *+(~{3,}+)[^\n]*+(?:\n.*?(?:^ *+\4~*+$|\z)|\z)))"
    rf"|(?<={_WORD})\\(_)(?={_WORD})|(\\.)|((`++).*?(?<!`)\8(?!`))|(`++)"
)


def unescape_intraword(markdown: Column) -> Column:
    """Markdown without the backslash before an underscore between two letters or digits, which never means emphasis.

    Fenced blocks and code spans stay: a run of backticks opens a span if a run of the same length closes it on its line. One
    pass from left to right takes fences, escapes and spans as they come, so an escaped backtick opens nothing.
    """
    return F.when(markdown.contains("\\_"), F.regexp_replace(markdown, _ESCAPES, "$1$3$5$6$7$9")).otherwise(markdown)
