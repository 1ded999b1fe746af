"""Shortlists to messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.operators.outbox import Sender, build_outbox


def mail_requests(shortlists: DataFrame, schedule: DataFrame) -> DataFrame:
    """One mail request per shortlist, recipients in order of their place.

    ``schedule`` has ``request_id``, ``role``, ``date``, ``time`` and ``venue``. A shortlist is a
    few rows, so its lists are short.
    """
    listed = shortlists.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("place", "email", "name"))).alias("_who"))
    return listed.join(schedule, "request_id").select(
        "request_id",
        F.transform("_who", lambda x: x["email"]).alias("emails"),
        F.transform("_who", lambda x: x["name"]).alias("names"),
        "role",
        "date",
        "time",
        "venue",
    )


def invite(shortlists: DataFrame, schedule: DataFrame, sender: Sender = Sender()) -> DataFrame:
    """Messages for everyone on the shortlists."""
    return build_outbox(mail_requests(shortlists, schedule), sender)
