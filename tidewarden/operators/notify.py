"""Who is told about an alert, and the text and payloads they get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.severity import (
    channels,
    lowercase_severity,
    route,
    sla_seconds,
)
from tidewarden.functions.text import fixed

# --- fixed values ---------------------------------------------------------------

SEVERITY_COLORS = {
    "NONE": "#36a64f",
    "LOW": "#f0e130",
    "MEDIUM": "#ffa500",
    "HIGH": "#e01e5a",
    "CRITICAL": "#7b0000",
}
SEVERITY_EMOJI = {"NONE": "✅", "LOW": "🟡", "MEDIUM": "🟠", "HIGH": "🔴", "CRITICAL": "🚨"}
PAGER_SEVERITY = {
    "NONE": "info",
    "LOW": "info",
    "MEDIUM": "warning",
    "HIGH": "error",
    "CRITICAL": "critical",
}


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def iso_text(ts: Column) -> Column:
    micros = F.unix_micros(ts) % F.lit(1_000_000)
    return F.when(micros == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    )


def fan_out(alerts: DataFrame) -> DataFrame:
    """One row per alert and channel; alerts no channel wants are left out."""
    return (
        alerts.withColumn("channel", F.explode(channels(F.col("severity"))))
        .withColumn("sla_seconds", sla_seconds(F.col("severity")))
    )


def with_route(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("route", route(F.col("severity")))


def recipients(text: Column) -> Column:
    """Comma-separated addresses, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda a: F.trim(a)), lambda a: a != "")


# --- payloads ---------------------------------------------------------------------


def _field(title: str, value: Column) -> Column:
    return F.struct(
        F.lit("mrkdwn").alias("type"),
        F.concat(F.lit(f"*{title}*\n"), value).alias("text"),
    )


def slack_payload() -> Column:
    """Message with a coloured attachment: header, six fields and a dashboard button."""
    c = F.col
    score = fixed(c("score"), 4)
    header = F.concat(
        lookup(SEVERITY_EMOJI, c("severity"), "❓"), F.lit("  *["), c("severity"),
        F.lit("]*  `source_id="), c("source_id"), F.lit("`  —  score: *"), score, F.lit("*"),
    )
    code = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    fields = F.array(
        _field("Alert ID", code(c("alert_id"))),
        _field("Event ID", code(c("event_id"))),
        _field("Anomaly Score", score),
        _field("Burst Count", F.concat(c("burst_count").cast("string"), F.lit(" HIGH/min"))),
        _field("Severity", c("severity")),
        _field("Created At", utc_text(c("created_at"))),
    )
    section = F.struct(
        F.lit("section").alias("type"),
        F.struct(F.lit("mrkdwn").alias("type"), header.alias("text")).alias("text"),
        F.lit(None).cast("array<struct<type:string,text:string>>").alias("fields"),
    )
    details = F.struct(
        F.lit("section").alias("type"),
        F.lit(None).cast("struct<type:string,text:string>").alias("text"),
        fields.alias("fields"),
    )
    button = F.struct(
        F.lit("button").alias("type"),
        F.struct(F.lit("plain_text").alias("type"), F.lit("🔗 Open Dashboard").alias("text")).alias(
            "text"
        ),
        c("dashboard_url").alias("url"),
        F.lit("primary").alias("style"),
    )
    # Blocks differ in shape, so each is rendered on its own and joined as text.
    blocks = F.concat_ws(
        ",",
        F.to_json(section),
        F.to_json(details),
        F.to_json(F.struct(F.lit("actions").alias("type"), F.array(button).alias("elements"))),
    )
    return F.concat(
        F.lit('{"attachments":[{"color":"'),
        lookup(SEVERITY_COLORS, c("severity"), "#cccccc"),
        F.lit('","blocks":['), blocks, F.lit("]}]}"),
    )


def plain_text() -> Column:
    """Mail body; labels and order are a fixed format."""
    c = F.col
    line = lambda label, value: F.concat(F.lit(f"{label:<12}: "), value)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("ANOMALY ALERT — "), c("severity")),
        F.lit("=" * 50),
        line("Alert ID", c("alert_id")),
        line("Event ID", c("event_id")),
        line("Source ID", c("source_id")),
        line("Score", fixed(c("score"), 4)),
        line("Severity", c("severity")),
        line("Burst Count", F.concat(c("burst_count").cast("string"), F.lit(" HIGH+/60 s"))),
        line("Detected At", utc_text(c("created_at"))),
        F.lit(""),
        line("Dashboard", c("dashboard_url")),
        F.lit(""),
        F.concat(F.lit("Please review via: PATCH /api/events/"), c("event_id"), F.lit("/label\n")),
    )


def escaped(text: Column) -> Column:
    """Text that means itself inside HTML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_text() -> Column:
    """The alert as a small HTML table with a link to the dashboard."""

    def c(name: str) -> Column:
        return escaped(F.col(name)) if name in ("alert_id", "event_id", "source_id", "dashboard_url") else F.col(name)

    rows = {
        "Alert ID": c("alert_id"),
        "Event ID": c("event_id"),
        "Source ID": c("source_id"),
        "Anomaly Score": F.concat(
            fixed(c("score"), 4), F.lit(" ("), fixed(c("score") * 100, 1), F.lit("%)")
        ),
        "Severity": c("severity"),
        "Burst Count": F.concat(c("burst_count").cast("string"), F.lit(" HIGH+ alerts / 60 s")),
        "Detected At": utc_text(c("created_at")),
    }
    body = [
        x
        for name, value in rows.items()
        for x in (F.lit(f"<tr><th>{name}</th><td>"), value, F.lit("</td></tr>"))
    ]
    color = lookup({k: SEVERITY_COLORS[k] for k in ("HIGH", "CRITICAL")}, c("severity"), "#555555")
    return F.concat(
        F.lit('<html><body><h1 style="color:'), color, F.lit('">Anomaly Alert — '), c("severity"),
        F.lit("</h1><table>"), *body, F.lit('</table><a href="'), c("dashboard_url"),
        F.lit('">Open Dashboard</a></body></html>'),
    )


def email_payload(to: str, sender: str = "alerts@localhost") -> Column:
    c = F.col
    addresses = F.transform(recipients(F.lit(to)), lambda a: F.struct(a.alias("email")))
    subject = F.concat(
        F.lit("["), c("severity"), F.lit("] Anomaly Alert — source_id="), c("source_id")
    )
    content = lambda kind, value: F.struct(
        F.lit(kind).alias("type"), value.alias("value")
    )
    return F.to_json(
        F.struct(
            F.array(F.struct(addresses.alias("to"))).alias("personalizations"),
            F.struct(F.lit(sender).alias("email")).alias("from"),
            subject.alias("subject"),
            F.array(
                content("text/plain", plain_text()), content("text/html", html_text())
            ).alias("content"),
        )
    )


def pager_trigger(
    routing_key: str, component: str = "scoring", group: str = "event-scoring"
) -> Column:
    """Incident event; the alert id is the dedup key, so retries do not open a second one."""
    c = F.col
    summary = F.concat(
        F.lit("["), c("severity"), F.lit("] Anomaly on source_id="), c("source_id"),
        F.lit(" score="), fixed(c("score"), 4),
    )
    details = F.struct(
        "alert_id",
        "event_id",
        c("score").alias("anomaly_score"),
        "burst_count",
        "severity",
        "dashboard_url",
    )
    payload = F.struct(
        F.substring(summary, 1, 1024).alias("summary"),
        c("source_id").alias("source"),
        lookup(PAGER_SEVERITY, c("severity"), "error").alias("severity"),
        iso_text(c("created_at")).alias("timestamp"),
        F.lit(component).alias("component"),
        F.lit(group).alias("group"),
        F.lit("anomaly").alias("class"),
        details.alias("custom_details"),
    )
    return F.to_json(
        F.struct(
            F.lit(routing_key).alias("routing_key"),
            c("alert_id").alias("dedup_key"),
            F.lit("trigger").alias("event_action"),
            payload.alias("payload"),
            F.array(
                F.struct(c("dashboard_url").alias("href"), F.lit("Dashboard").alias("text"))
            ).alias("links"),
        )
    )


def pager_resolve(routing_key: str) -> Column:
    return F.to_json(
        F.struct(
            F.lit(routing_key).alias("routing_key"),
            F.col("alert_id").alias("dedup_key"),
            F.lit("resolve").alias("event_action"),
        )
    )


def notifications(alerts: DataFrame, to: str = "", routing_key: str = "") -> DataFrame:
    """One row per alert and channel with the payload of that channel."""
    payload = (
        F.when(F.col("channel") == "slack", slack_payload())
        .when(F.col("channel") == "email", email_payload(to))
        .otherwise(pager_trigger(routing_key))
    )
    return fan_out(alerts).withColumn("payload", payload)


def summary_text(score: Column, severity: Column, source_id: Column) -> Column:
    return F.concat(
        F.lit("Anomaly detected: score="), fixed(F.coalesce(score, F.lit(0.0)), 3),
        F.lit(", severity="), F.coalesce(severity, F.lit("unknown")),
        F.lit(", source="), F.coalesce(source_id, F.lit("unknown")), F.lit("."),
    )


# --- feeds -------------------------------------------------------------------------


def live_feed(scored: DataFrame) -> DataFrame:
    """Every scored event in the shape live clients get."""
    return scored.select(
        "event_id",
        F.col("anomaly_score").alias("score"),
        "is_anomaly",
        "source_id",
        F.col("event_time").alias("timestamp"),
    )


def critical_annotations(scored: DataFrame, bound: float = 0.95) -> DataFrame:
    """Annotation for every event scored at or above ``bound``."""
    source = F.coalesce("source_id", F.lit("unknown"))
    return scored.filter(F.col("anomaly_score") >= bound).select(
        F.unix_millis("event_time").alias("time"),
        F.concat(F.lit("CRITICAL Anomaly (Score: "), F.col("anomaly_score").cast("string"),
                 F.lit(")")).alias("text"),
        F.array(F.lit("critical"), F.lit("anomaly"), source).alias("tags"),
    )


def anomaly_annotations(scored: DataFrame, dashboard: str = "anomaly-overview") -> DataFrame:
    """Annotation for every flagged event, with severity, source and model."""
    c = F.col
    severity = lowercase_severity(c("anomaly_score"))
    return scored.filter("is_anomaly").select(
        F.lit(dashboard).alias("dashboard"),
        F.unix_millis("event_time").alias("time"),
        F.array(F.lit("anomaly"), severity, F.concat(F.lit("source:"), c("source_id"))).alias(
            "tags"
        ),
        F.concat(
            F.lit("Anomaly detected | Score: "), fixed(c("anomaly_score"), 4),
            F.lit(" | Severity: "), severity, F.lit(" | Source: "), c("source_id"),
            F.lit(" | Model: "), c("model_version"),
        ).alias("text"),
    )
