"""Slices of source text by lines, counted from 1, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_lines(text: str | Column) -> Column:
    """The lines of a text; a line end after the last one opens no further line."""
    ends = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\r\n?|[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", "\n")
    return F.when(ends == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(ends, r"\n\z", ""), "\n"))


def between(lines: Column, first: Column, last: Column) -> Column:
    """Lines first to last of an array, both within it already."""
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def lines(text: str | Column, start: Column, end: Column) -> Column:
    """Lines start to end, both included, cut to the text; empty if there are none."""
    found = split_lines(text)
    first, last = F.greatest(start.cast("int"), F.lit(1)), F.least(end.cast("int"), F.size(found))
    return F.coalesce(F.when(last >= first, between(found, first, last)), F.lit(""))


def window(path: str, text: str | Column, root: str, start: Column | None = None, end: Column | None = None, around: int = 50) -> Column:
    """A struct of error, content, start_line, end_line and total: a symbol's lines with those around it, or all lines where start is null.

    Paths are taken as they stand, resolved by who read them; one outside root gives an error and no
    content, and so does a file without text.
    """
    found = split_lines(text)
    total = F.size(found)
    start = F.lit(None).cast("int") if start is None else start.cast("int")
    end = F.lit(None).cast("int") if end is None else end.cast("int")
    first = F.when(start.isNull(), 1).otherwise(F.greatest(start - around, F.lit(1)))
    last = F.when(start.isNull(), total).otherwise(F.least(F.coalesce(end, start) + around, total))
    shown = F.when(last >= first, between(found, first, last)).otherwise("")
    outside = ~F.coalesce((F.col(path) == root) | F.col(path).startswith(root.rstrip("/") + "/"), F.lit(False))
    error = F.when(outside, "path outside project root").when(found.isNull(), "file not found")
    good = error.isNull()
    return F.struct(
        error.alias("error"), F.when(good, shown).otherwise("").alias("content"), F.when(good, first).alias("start_line"), F.when(good, last).alias("end_line"), F.when(good, total).alias("total")
    )
