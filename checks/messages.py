"""Invitation messages and their delivery."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.oracles import using
from screenforge.functions.text import escape_html
from screenforge.operators import outbox as ob
from screenforge.session import scratch_path


def _position():
    return F.col("position").cast("long").alias("position")


def _outbox(spark, sf):
    return ob.build_outbox(fx.mail_requests(spark, sf))


def _delivered(spark, sf):
    """The outbox as a sender would report it back: some mailboxes are full."""
    full = (F.col("status") == "ready") & (F.length("email") % 2 == 0) & ~F.endswith("email", F.lit("1@mail.example"))
    return _outbox(spark, sf).withColumns(
        {
            "error": F.when(full, F.lit("mailbox full")),
            "status": F.when(full, F.lit("failed")).when(F.col("status") == "ready", F.lit("sent")).otherwise(F.col("status")),
        }
    )


def o1_expand_recipients(spark, sf):
    return ob.expand_recipients(fx.mail_requests(spark, sf)).select("request_id", _position(), "email", "name")


def o2_validate_requests(spark, sf):
    return ob.validate_requests(fx.mail_requests(spark, sf)).select("request_id", "success", "error")


def o3_venue_or_address(spark, sf):
    return fx.mail_requests(spark, sf).select("request_id", ob.venue_or_address(F.col("venue")).alias("venue"))


def o4_plain_messages(spark, sf):
    return _outbox(spark, sf).select("request_id", _position(), "subject", "plain")


def o5_html_messages(spark, sf):
    return _outbox(spark, sf).select("request_id", _position(), "html")


def o5_escape_html(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", escape_html(F.col("html")).alias("escaped"))


def o6_rerun(spark, sf):
    """A second run of the same requests adds no message."""
    path = scratch_path(spark, "outbox")
    for _ in range(2):
        ob.write_outbox(_outbox(spark, sf), path)
    return spark.read.parquet(path).select("request_id", _position(), "status")


def o6_write_outbox(spark, sf):
    path = scratch_path(spark, "outbox")
    ob.write_outbox(_outbox(spark, sf), path)
    return spark.read.parquet(path).select("request_id", _position(), "email", "name", "status", "error")


def _logged(spark, sf):
    """Two writers add the same messages, one twice; a sender's second attempts are reported before its first ones."""
    log = ob.DeliveryLog(spark, scratch_path(spark, "delivery-log"))
    messages, day = _outbox(spark, sf), dt.datetime(2025, 5, 1)
    for writer, hours in (("late", 2), ("early", 1), ("late", 3)):
        log.add_messages(messages.withColumn("name", F.concat("name", F.lit(f" by {writer}"))), writer, day + dt.timedelta(hours=hours))
    ready = log.pending().select("request_id", "position", "email")
    full = (F.length("email") % 2 == 0) & ~F.endswith("email", F.lit("1@mail.example"))

    def report(rows, attempt, failed, error, hour):
        return rows.select(
            "request_id", "position", F.lit(attempt).alias("attempt"), F.when(failed, F.lit("failed")).otherwise(F.lit("sent")).alias("status"),
            F.when(failed, F.lit(error)).alias("error"), F.lit(day + dt.timedelta(hours=hour)).cast("timestamp_ntz").alias("reported_at"),
        )

    log.add_reports(report(ready, 2, full, "mailbox full", 5), "second")
    log.add_reports(report(ready, 1, F.lit(True), "no connection", 9), "first")
    log.add_reports(report(ready.where("position < 0"), 3, F.lit(True), "none", 9), "empty")
    return log.outbox()


def o6_delivery_log(spark, sf):
    return _logged(spark, sf).select("request_id", _position(), "email", "name", "status", "error", F.col("attempt").cast("long").alias("attempt"))


def a1_logged_report(spark, sf):
    report = ob.delivery_report(_logged(spark, sf))
    return report.select("request_id", "sent", "failed", F.array_join("errors", "; ").alias("errors"))


def a1_delivery_report(spark, sf):
    report = ob.delivery_report(_delivered(spark, sf))
    return report.select("request_id", "sent", "failed", F.array_join("errors", "; ").alias("errors"))


def a1_request_report(spark, sf):
    report = ob.request_report(fx.mail_requests(spark, sf), _delivered(spark, sf))
    return report.select(
        "request_id", "success", "error", "sent", "failed", F.cardinality("errors").cast("long").alias("n_errors")
    )


QUERIES = {
    f.__name__: f
    for f in (
        o1_expand_recipients, o2_validate_requests, o3_venue_or_address, o4_plain_messages, o5_html_messages,
        o5_escape_html, o6_rerun, o6_write_outbox, a1_delivery_report, a1_request_report, o6_delivery_log, a1_logged_report,
    )
}

_DELIVERED = """, delivered AS (SELECT *, status = 'ready' AND length(email) % 2 = 0
    AND NOT ends_with(email, '1@mail.example') AS full_box FROM outbox)
"""
_REPORT = """SELECT request_id, count(*) FILTER (WHERE status = 'ready' AND NOT full_box) AS sent,
    count(*) FILTER (WHERE status = 'failed' OR full_box) AS failed, count(*) FILTER (WHERE full_box) AS n_errors,
    coalesce(string_agg(CASE WHEN full_box THEN email || ': mailbox full' END, '; ' ORDER BY position), '') AS errors
  FROM delivered GROUP BY request_id"""


def _delivered_sql(body: str) -> str:
    return using("outbox", body="").rstrip() + _DELIVERED + body


def _escaped(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


ORACLES = {
    "o1_expand_recipients": using("recipients", body="SELECT request_id, position::BIGINT AS position, email, name FROM recipients"),
    "o2_validate_requests": using("mail_checked", body="""SELECT request_id,
        long_date IS NOT NULL AND long_time IS NOT NULL AS success,
        CASE WHEN long_date IS NULL OR long_time IS NULL THEN 'invalid date or time' END AS error FROM mail_checked"""),
    "o3_venue_or_address": using("mail_requests", body="""SELECT request_id,
      CASE WHEN venue IS NULL OR venue = '' THEN '1 Example Street, Exampletown' ELSE venue END AS venue FROM mail_requests"""),
    "o4_plain_messages": using("outbox", body="""SELECT request_id, position::BIGINT AS position,
      CASE WHEN status = 'ready' THEN 'Interview invitation: ' || titled || ' at Example Company' END AS subject,
      CASE WHEN status = 'ready' THEN 'Example Company would like to meet you.' || chr(10) || chr(10) || 'Venue: ' || place || chr(10)
        || 'Date: ' || long_date || chr(10) || 'Time: ' || long_time || chr(10) || chr(10) || 'Hello ' || name
        || ', we have read your application as ' || role || ' and have kept this hour for you. Answer this mail if another one suits you better.'
        || chr(10) || chr(10) || 'Until then' || chr(10) || 'Example Company, 1 Example Street, Exampletown' END AS plain FROM outbox"""),
    "o5_html_messages": using("outbox", body=f"""SELECT request_id, position::BIGINT AS position, CASE WHEN status = 'ready' THEN
      '<html><body><h1>Example Company would like to meet you</h1><table><tr><td>Venue</td><td>' || {_escaped('place')}
      || '</td></tr><tr><td>Date</td><td>' || long_date || '</td></tr><tr><td>Time</td><td>' || long_time || '</td></tr></table><p>Hello '
      || {_escaped('name')} || ', we have read your application as <b>' || {_escaped('titled')}
      || '</b> and have kept this hour for you. Answer this mail if another one suits you better.</p>'
      || '<p>Example Company<br>1 Example Street, Exampletown</p></body></html>' END AS html FROM outbox"""),
    "o5_escape_html": f"SELECT page_id, {_escaped('html')} AS escaped FROM pages",
    "o6_rerun": using("outbox", body="SELECT request_id, position::BIGINT AS position, status FROM outbox"),
    "o6_write_outbox": using("outbox", body="""SELECT request_id, position::BIGINT AS position, email, name, status,
      NULL::VARCHAR AS error FROM outbox"""),
    "a1_delivery_report": _delivered_sql(f"SELECT request_id, sent, failed, errors FROM ({_REPORT})"),
    "a1_request_report": _delivered_sql(f"""SELECT request_id, ok AS success,
        CASE WHEN NOT ok THEN 'invalid date or time' END AS error, CASE WHEN ok THEN coalesce(sent, 0) END AS sent,
        CASE WHEN ok THEN coalesce(failed, 0) END AS failed, CASE WHEN ok THEN coalesce(n_errors, 0) END AS n_errors
      FROM (SELECT request_id, long_date IS NOT NULL AND long_time IS NOT NULL AS ok FROM mail_checked)
      LEFT JOIN ({_REPORT}) USING (request_id)"""),
}
ORACLES["a1_logged_report"] = ORACLES["a1_delivery_report"]
ORACLES["o6_delivery_log"] = _delivered_sql("""SELECT request_id, position::BIGINT AS position, email, name || ' by early' AS name,
  CASE WHEN full_box THEN 'failed' WHEN status = 'ready' THEN 'sent' ELSE status END AS status,
  CASE WHEN full_box THEN 'mailbox full' END AS error, CASE WHEN status = 'ready' THEN 2 ELSE 0 END::BIGINT AS attempt FROM delivered""")
