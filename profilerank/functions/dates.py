"""Guarded date handling: anything but ``YYYY-MM-DD`` is null, never an error."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F


def iso_date(text: Column) -> Column:
    """The date of a text that is exactly ``YYYY-MM-DD``, else null."""
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), text.try_cast("date"))


def iso_date_prefix(text: Column) -> Column:
    """Like :func:`iso_date`, on the first ten characters (time parts are ignored)."""
    return iso_date(F.substring(text, 1, 10))


def days_before(day: date, when: Column) -> Column:
    return F.datediff(F.lit(day), when)
