"""Dates in several forms, read without errors under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_date(c: Column | str, first: str | None = None, last: str | None = None) -> Column:
    """``yyyy-MM-dd``, the same with a time behind it, or ``M/d/yyyy``, as a date; null for anything else and, where
    bounds are given, for dates outside of [first, last]."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    # both forms become one text that a single cast reads
    text = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.substring(s, 1, 10)).when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.regexp_replace(s, r"^(\d+)/(\d+)/(\d+)$", r"$3-$1-$2"))
    d = text.try_cast("date")
    if first is not None or last is not None:
        inside = (d >= F.lit(first or "0001-01-01").cast("date")) & (d <= F.lit(last or "9999-12-31").cast("date"))
        return F.when(inside, d)
    return d


def iso_date(c: Column | str) -> Column:
    """Any readable date as ``yyyy-MM-dd`` text."""
    return F.date_format(any_date(c), "yyyy-MM-dd")


def week_start(d: Column) -> Column:
    """The Monday of a date's week."""
    return F.date_trunc("week", d).cast("date")
