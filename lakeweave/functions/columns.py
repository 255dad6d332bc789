"""Column expressions that several queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The end of what has no end.
FOREVER = "9999-12-31"


def valid_on(day: Column, start: str, end: str) -> Column:
    """A row that holds on that day, from start to end, both included; without an end it holds for ever."""
    return day.between(F.col(start), F.coalesce(F.col(end), F.lit(FOREVER).cast("date")))


def contains(needle: str, *columns: str) -> Column:
    """A row of which one of the columns has the needle in it, whatever the case; signs of patterns count as themselves."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle.lower())
    return found


def like(needle: str, column: str) -> Column:
    """A row whose column has the needle in it, whatever the case; _ and % in it stand for any letter and any letters."""
    return F.col(column).ilike(f"%{needle}%")
