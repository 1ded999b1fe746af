"""Interview date and time in long form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_interview_date(c: Column) -> Column:
    """``2025-05-05`` to ``Monday, 05 May 2025``; null when it is no date."""
    shaped = F.when(c.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), c)
    return F.date_format(F.try_to_date(shaped, "yyyy-M-d"), "EEEE, dd MMMM yyyy")


def format_interview_time(c: Column) -> Column:
    """``10:30`` to ``10:30 AM``; null when it is no time of day."""
    shaped = F.when(c.rlike(r"\A\d{1,2}:\d{1,2}\z"), c)
    at = F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), shaped), F.lit("yyyy-MM-dd H:m"))
    return F.date_format(at, "hh:mm a")
