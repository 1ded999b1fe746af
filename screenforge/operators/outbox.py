"""Invitation messages as a table, and the report on their delivery."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenforge.functions.dates import format_interview_date, format_interview_time
from screenforge.functions.text import escape_html, title_case, valid_email
from screenforge.schemas import MESSAGE, REPORT
from screenforge.sources.batches import BatchTable

INVALID_SCHEDULE = "invalid date or time"
INCOMPLETE = "name or role is missing"


@dataclass(frozen=True)
class Sender:
    """Who invites."""

    company: str = "Example Company"
    address: str = "1 Example Street, Exampletown"


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``long_date``, ``long_time``, ``success`` and ``error``. One bad part fails the request."""
    checked = requests.withColumns(
        {"long_date": format_interview_date(F.col("date")), "long_time": format_interview_time(F.col("time"))}
    )
    ok = F.col("long_date").isNotNull() & F.col("long_time").isNotNull()
    return checked.withColumns({"success": ok, "error": F.when(~ok, F.lit(INVALID_SCHEDULE))})


def venue_or_address(venue: Column, sender: Sender = Sender()) -> Column:
    return F.coalesce(F.nullif(venue, F.lit("")), F.lit(sender.address))


def expand_recipients(requests: DataFrame) -> DataFrame:
    """One row per recipient: emails and names paired by position up to the shorter list."""
    size = F.least(F.cardinality("emails"), F.cardinality("names"))
    pairs = F.arrays_zip(
        F.slice("emails", F.lit(1), size).alias("email"), F.slice("names", F.lit(1), size).alias("name")
    )
    other = [c for c in requests.columns if c not in ("emails", "names")]
    return requests.select(*other, F.posexplode(pairs).alias("position", "_pair")).select(
        *other, "position", F.col("_pair.email").alias("email"), F.col("_pair.name").alias("name")
    )


def subject(sender: Sender = Sender()) -> Column:
    return F.concat(F.lit("Interview invitation: "), title_case(F.col("role")), F.lit(f" at {sender.company}"))


def plain_message(sender: Sender = Sender()) -> Column:
    """The role stands as it was given."""
    return F.concat(
        F.lit(f"{sender.company} would like to meet you.\n\nVenue: "), F.col("venue"),
        F.lit("\nDate: "), F.col("long_date"),
        F.lit("\nTime: "), F.col("long_time"),
        F.lit("\n\nHello "), F.col("name"),
        F.lit(", we have read your application as "), F.col("role"),
        F.lit(" and have kept this hour for you. Answer this mail if another one suits you better."),
        F.lit(f"\n\nUntil then\n{sender.company}, {sender.address}"),
    )


def html_message(sender: Sender = Sender()) -> Column:
    """The same message as HTML, with the role in title case and all values escaped."""
    return F.concat(
        F.lit(f"<html><body><h1>{sender.company} would like to meet you</h1><table><tr><td>Venue</td><td>"), escape_html(F.col("venue")),
        F.lit("</td></tr><tr><td>Date</td><td>"), F.col("long_date"),
        F.lit("</td></tr><tr><td>Time</td><td>"), F.col("long_time"),
        F.lit("</td></tr></table><p>Hello "), escape_html(F.col("name")),
        F.lit(", we have read your application as <b>"), escape_html(title_case(F.col("role"))),
        F.lit("</b> and have kept this hour for you. Answer this mail if another one suits you better.</p>"),
        F.lit(f"<p>{sender.company}<br>{sender.address}</p></body></html>"),
    )


def build_outbox(requests: DataFrame, sender: Sender = Sender()) -> DataFrame:
    """Messages of all valid requests. ``status`` is ``ready``, or ``failed`` without a message
    where the email is invalid, or, with an error text, where a name or the role is missing."""
    valid = validate_requests(requests).where("success").withColumn("venue", venue_or_address(F.col("venue"), sender))
    rows = expand_recipients(valid.drop("success", "error"))
    complete = F.col("name").isNotNull() & F.col("role").isNotNull()
    ok = valid_email(F.col("email")) & complete
    return rows.select(
        "request_id",
        "position",
        "email",
        "name",
        F.when(ok, subject(sender)).alias("subject"),
        F.when(ok, plain_message(sender)).alias("plain"),
        F.when(ok, html_message(sender)).alias("html"),
        F.when(ok, F.lit("ready")).otherwise(F.lit("failed")).alias("status"),
        F.when(valid_email(F.col("email")) & ~complete, F.lit(INCOMPLETE)).alias("error"),
    )


def write_outbox(outbox: DataFrame, path: str) -> None:
    """Add messages to the table a sender reads. The sender reports status and error back.

    A message that is there already, by request and position, stays as it is, so a second run adds
    nothing. One writer at a time.
    """
    new = outbox
    try:
        there = outbox.sparkSession.read.schema(outbox.schema).parquet(path).select("request_id", "position").distinct()
        new = outbox.join(there, ["request_id", "position"], "left_anti").select(*outbox.columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    new.write.mode("append").parquet(path)


class DeliveryLog:
    """Messages and what senders report on them, as two tables that are only added to.

    Any number of writers may add messages, and any number of senders reports, each batch under a name of its own; a batch that is
    written again changes nothing. Readers merge: of a message that several writers have made the earliest counts, so none
    is doubled, and its status is that of the latest attempt that was reported, in whatever order reports came.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.messages = BatchTable(spark, f"{path}/messages", MESSAGE)
        self.reports = BatchTable(spark, f"{path}/reports", REPORT)

    def add_messages(self, outbox: DataFrame, batch: str, written_at: dt.datetime) -> bool:
        """Add the rows of :func:`build_outbox`."""
        return self.messages.write(outbox.withColumn("written_at", F.lit(written_at).cast("timestamp_ntz")), batch)

    def add_reports(self, reports: DataFrame, batch: str) -> bool:
        """Add a sender's reports: request_id, position, attempt (from 1), status, error, reported_at."""
        return self.reports.write(reports, batch)

    def pending(self) -> DataFrame:
        """Messages that are ready to be sent and have no report yet."""
        return self.outbox().where("status = 'ready' AND attempt = 0")

    def outbox(self) -> DataFrame:
        """One row per message with its present status, error and attempt (0 without a report); reports on unknown messages are left out.

        One shuffle by message; both sides are reduced to one row per message before it. Every column is picked for itself, by the
        same order, so that texts nobody asks for are neither read nor shuffled.
        """
        message = [f for f in MESSAGE.fields if f.name not in ("request_id", "position", "written_at")]
        report = [REPORT[n] for n in ("status", "error", "attempt")]
        tried = "struct<attempt:int,reported_at:timestamp_ntz,batch:string>"

        def absent(fields, prefix: str) -> list[Column]:
            return [F.lit(None).cast(f.dataType).alias(f"{prefix}{f.name}") for f in fields]

        made = self.messages.read().select(
            "request_id", "position", F.struct("written_at", "batch").alias("_made"), *[F.col(f.name).alias(f"_m_{f.name}") for f in message],
            F.lit(None).cast(tried).alias("_tried"), *absent(report, "_r_"),
        )
        told = self.reports.read().select(
            "request_id", "position", F.lit(None).cast(made.schema["_made"].dataType).alias("_made"), *absent(message, "_m_"),
            F.struct("attempt", "reported_at", "batch").alias("_tried"), *[F.col(f.name).alias(f"_r_{f.name}") for f in report],
        )
        merged = made.unionByName(told).groupBy("request_id", "position").agg(
            F.max(F.col("_made").isNotNull()).alias("_known"),
            F.max(F.col("_tried").isNotNull()).alias("_reported"),
            *[F.min_by(f"_m_{f.name}", "_made").alias(f"_m_{f.name}") for f in message],
            *[F.max_by(f"_r_{f.name}", "_tried").alias(f"_r_{f.name}") for f in report],
        )
        return merged.where("_known").select(
            "request_id",
            "position",
            *[F.col(f"_m_{f.name}").alias(f.name) for f in message if f.name not in ("status", "error")],
            F.when(F.col("_reported"), F.col("_r_status")).otherwise(F.col("_m_status")).alias("status"),
            F.when(F.col("_reported"), F.col("_r_error")).otherwise(F.col("_m_error")).alias("error"),
            F.coalesce("_r_attempt", F.lit(0)).alias("attempt"),
        )


def delivery_report(outbox: DataFrame) -> DataFrame:
    """Per request: messages sent and failed, and the error texts in recipient order.

    An invalid email counts as failed without adding a text. A request names its recipients in
    one row, so its error texts are no longer than that row's lists; counts are summed before
    the shuffle.
    """
    errors = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("position", "email", "error"))))
    return outbox.groupBy("request_id").agg(
        F.count_if(F.col("status") == "sent").alias("sent"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.transform(errors, lambda e: F.concat(e["email"], F.lit(": "), e["error"])).alias("errors"),
    )


def request_report(requests: DataFrame, outbox: DataFrame) -> DataFrame:
    """One row per mail request: success, sent, failed, errors; an invalid one only has its error."""
    checked = validate_requests(requests).select("request_id", "success", "error")
    counted = checked.join(delivery_report(outbox), "request_id", "left")
    zero = F.when(F.col("success"), F.lit(0).cast("long"))
    return counted.withColumns(
        {
            "sent": F.coalesce("sent", zero),
            "failed": F.coalesce("failed", zero),
            "errors": F.coalesce("errors", F.when(F.col("success"), F.array().cast("array<string>"))),
        }
    )
