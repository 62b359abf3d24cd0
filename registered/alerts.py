"""Registered alerting queries, each next to its SQL twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registered.common import SCORED_SQL as S
from registered.common import scored, table
from tidewarden.functions import severity as sev
from tidewarden.functions.identity import uuid5
from tidewarden.operators import alerts, notify
from tidewarden.plans import queries

QUERIES = {}
ORACLES = {}


def register(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


# In this data bursts need wide windows: 6 hours from a score of 0.3, limit 3.
WIDE = sev.AlertThresholds(high=0.3, burst_limit=3)
WIDE_MS, WIDE_CHUNK = 6 * 3_600_000, 12 * 3_600_000
AS_OF = dt.datetime(2024, 1, 15, tzinfo=dt.UTC)


def control(spark, sf):
    """Silence rules, removals and burst clears derived from the events."""
    e = table(spark, sf, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    source = F.col("user_id").cast("string")
    own = e.filter((F.col("event_type") == "error") & (F.col("value") >= 100)).select(
        source.alias("source_id"),
        (F.lit(60) + F.col("event_id") % 1380).alias("duration_minutes"),
        F.lit("maintenance").alias("reason"),
        F.col("event_time").alias("created_at"),
    )
    for_all = e.filter(F.col("value") >= 350).select(
        F.lit(None).cast("string").alias("source_id"),
        (F.lit(30) + F.col("event_id") % 200).alias("duration_minutes"),
        F.lit("release").alias("reason"),
        F.col("event_time").alias("created_at"),
    )
    removals = e.filter((F.col("event_type") == "signup") & (F.col("value") >= 60)).select(
        source.alias("source_id"), F.col("event_time").alias("removed_at")
    )
    clears = e.filter((F.col("event_type") == "view") & (F.col("value") >= 60)).select(
        source.alias("source_id"), F.col("event_time").alias("cleared_at")
    )
    return own.unionByName(for_all), removals, clears


CONTROL_SQL = f"""{S},
  log AS (
    SELECT source_id AS scope, event_time AS "at", 1 AS adds, 60 + n % 1380 AS minutes, n
    FROM scored WHERE event_type = 'error' AND value >= 100
    UNION ALL SELECT '*', event_time, 1, 30 + n % 200, n FROM scored WHERE value >= 350
    UNION ALL SELECT source_id, event_time, 0, 0, n FROM scored WHERE event_type = 'signup' AND value >= 60),
  ends AS (
    SELECT scope, "at", adds, minutes, least("at" + to_minutes(CAST(minutes AS BIGINT)),
           coalesce(lead("at") OVER (PARTITION BY scope ORDER BY "at", adds, n), TIMESTAMP '9999-01-01')) AS ends_at
    FROM log),
  rules AS (SELECT scope, "at" AS created_at, minutes, ends_at FROM ends WHERE adds = 1 AND ends_at > "at"),
  anomalies AS (SELECT * FROM scored WHERE is_anomaly),
  kept AS (
    SELECT * FROM anomalies a WHERE NOT EXISTS (
      SELECT 1 FROM rules r WHERE r.scope IN ('*', a.source_id)
        AND a.event_time >= r.created_at AND a.event_time < r.ends_at))"""


def rules_of(spark, sf):
    requests, removals, _ = control(spark, sf)
    return alerts.effective_silences(alerts.silence_rows(requests, 1440), removals)


register(
    "a01_anomalies_only",
    lambda s, sf: scored(s, sf).filter("is_anomaly").select("event_id", "source_id", "anomaly_score"),
    f"{S} SELECT event_id, source_id, anomaly_score FROM scored WHERE is_anomaly",
)
register(
    "a02_unsilenced_anomalies",
    lambda s, sf: alerts.unsilenced(scored(s, sf).filter("is_anomaly"), rules_of(s, sf)).select(
        "event_id", "source_id", "event_time", "anomaly_score"
    ),
    f"{CONTROL_SQL} SELECT event_id, source_id, event_time, anomaly_score FROM kept",
)
register(
    "a03_effective_silences",
    lambda s, sf: rules_of(s, sf).select("scope", "duration_minutes", "created_at", "ends_at"),
    f"""{CONTROL_SQL} SELECT scope, CAST(minutes AS INTEGER) AS duration_minutes, created_at, ends_at
    FROM rules""",
)
register(
    "a03_active_silences",
    lambda s, sf: alerts.active_silences(rules_of(s, sf), AS_OF).select("scope", "created_at", "ends_at"),
    f"""{CONTROL_SQL} SELECT scope, created_at, ends_at FROM rules
    WHERE created_at <= TIMESTAMP '2024-01-15' AND ends_at > TIMESTAMP '2024-01-15'""",
)
register(
    "a03_silence_info",
    lambda s, sf: alerts.silence_info(rules_of(s, sf), "7", AS_OF).select("scope", "created_at", "ends_at").unionByName(
        alerts.silence_info(rules_of(s, sf), "12", AS_OF).select("scope", "created_at", "ends_at")
    ),
    f"""{CONTROL_SQL} SELECT scope, created_at, ends_at FROM rules WHERE scope IN ('7', '12')
    AND created_at <= TIMESTAMP '2024-01-15' AND ends_at > TIMESTAMP '2024-01-15'""",
)


def burst_sql(source, high, clears=""):
    """Count by definition: HIGH rows recorded before this one, in the window, not cleared."""
    return f"""
    SELECT a.event_id, a.source_id, a.event_time, a.anomaly_score, (
      SELECT count(*) FROM {source} h WHERE h.source_id = a.source_id AND h.anomaly_score >= {high}::DOUBLE
        AND h.ms > a.ms - {WIDE_MS} AND (h.ms < a.ms OR (h.ms = a.ms AND h.event_id <= a.event_id))
        {clears}) AS burst_count
    FROM {source} a"""


register(
    "a04_burst_counts",
    lambda s, sf: alerts.burst_counts(
        scored(s, sf).filter(F.col("anomaly_score") >= 0.2), 0.3, WIDE_MS, WIDE_CHUNK
    ).select("event_id", "source_id", "event_time", "anomaly_score", "burst_count"),
    f"{S}, pool AS (SELECT * FROM scored WHERE anomaly_score >= 0.2::DOUBLE) {burst_sql('pool', 0.3)}",
)
register(
    "a04_burst_counts_60s",
    lambda s, sf: alerts.burst_counts(scored(s, sf).filter("is_anomaly")).select(
        "event_id", "burst_count"
    ),
    f"""{S}, hi AS (SELECT * FROM scored WHERE is_anomaly)
    SELECT event_id, count(*) FILTER (WHERE anomaly_score >= 0.9::DOUBLE) OVER (
      PARTITION BY source_id ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS burst_count
    FROM hi""",
)
register(
    "a05_burst_read_only",
    lambda s, sf: alerts.burst_counts(
        scored(s, sf).filter(F.col("anomaly_score") >= 0.1), 0.3, WIDE_MS, WIDE_CHUNK
    ).filter(F.col("anomaly_score") < 0.3).select("event_id", "anomaly_score", "burst_count"),
    f"""{S}, pool AS (SELECT * FROM scored WHERE anomaly_score >= 0.1::DOUBLE),
    r AS ({burst_sql('pool', 0.3)})
    SELECT event_id, anomaly_score, burst_count FROM r WHERE anomaly_score < 0.3::DOUBLE""",
)
register(
    "a06_burst_after_clear",
    lambda s, sf: alerts.burst_counts(
        scored(s, sf).filter(F.col("anomaly_score") >= 0.1), 0.2, WIDE_MS, WIDE_CHUNK, control(s, sf)[2]
    ).select("event_id", "source_id", "event_time", "anomaly_score", "burst_count"),
    f"""{S}, pool AS (SELECT * FROM scored WHERE anomaly_score >= 0.1::DOUBLE),
    clears AS (SELECT source_id, ms FROM scored WHERE event_type = 'view' AND value >= 60)
    {burst_sql('pool', 0.2, '''AND NOT EXISTS (SELECT 1 FROM clears c WHERE c.source_id = a.source_id
        AND c.ms > h.ms AND c.ms <= a.ms)''')}""",
)

LADDER = """CASE WHEN anomaly_score >= 0.95::DOUBLE THEN 'CRITICAL' WHEN anomaly_score >= 0.90::DOUBLE THEN 'HIGH'
  WHEN anomaly_score >= 0.80::DOUBLE THEN 'MEDIUM' WHEN anomaly_score >= 0.70::DOUBLE THEN 'LOW' ELSE 'NONE' END"""
UUID5 = """(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' ||
  substr('89ab', (('0x' || h[17:17])::INTEGER % 4) + 1, 1) || h[18:20] || '-' || h[21:32]
  FROM (SELECT sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({0})) AS h))"""

register(
    "a07_severity",
    lambda s, sf: scored(s, sf).select("event_id", sev.alert_severity(F.col("anomaly_score")).alias("severity")),
    f"{S} SELECT event_id, {LADDER} AS severity FROM scored",
)
register(
    "a08_severity_overrides",
    lambda s, sf: scored(s, sf).select(
        "event_id",
        sev.alert_severity(
            F.col("anomaly_score"),
            F.col("features")["k"],
            sev.AlertThresholds.from_settings({"low": 0.1, "critical": 0.5, "burst_limit": 95, "x": 1}),
        ).alias("severity"),
    ),
    f"""{S} SELECT event_id, CASE WHEN k >= 95 THEN 'CRITICAL' WHEN anomaly_score >= 0.5::DOUBLE THEN 'CRITICAL'
    WHEN anomaly_score >= 0.9::DOUBLE THEN 'HIGH' WHEN anomaly_score >= 0.8::DOUBLE THEN 'MEDIUM'
    WHEN anomaly_score >= 0.1::DOUBLE THEN 'LOW' ELSE 'NONE' END AS severity FROM scored""",
)


def settings_log(s, sf):
    """Threshold changes: some events set one of the five settings to their scaled value."""
    e = table(s, sf, "events")
    names = F.array(*[F.lit(n) for n in ("low", "medium", "high", "critical", "burst_limit")])
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.coalesce(F.get(names, k), F.lit("other")).alias("name"), F.round(F.col("value") / 500.0, 4).alias("value"),
        F.col("ts").cast("timestamp").alias("at"),
    )


def by_settings_table(s, sf):
    # The log holds small numbers, so a burst count of 0 to 19 is derived from the id.
    t = sev.AlertThresholds.from_table(settings_log(s, sf).withColumn(
        "value", F.when(F.col("name") == "burst_limit", F.floor(F.col("value") * 10)).otherwise(F.col("value"))
    ))
    burst = F.pmod(F.col("event_id").cast("bigint"), F.lit(20))
    return scored(s, sf).select("event_id", sev.alert_severity(F.col("anomaly_score"), burst, t).alias("severity"))


register(
    "a08_settings_table",
    by_settings_table,
    f"""{S}, t AS (SELECT coalesce(max_by(round(value / 500.0::DOUBLE, 4), ms) FILTER (WHERE k = 0), 0.7) AS lo,
      coalesce(max_by(round(value / 500.0::DOUBLE, 4), ms) FILTER (WHERE k = 1), 0.8) AS me,
      coalesce(max_by(round(value / 500.0::DOUBLE, 4), ms) FILTER (WHERE k = 2), 0.9) AS hi,
      coalesce(max_by(round(value / 500.0::DOUBLE, 4), ms) FILTER (WHERE k = 3), 0.95) AS cr,
      coalesce(max_by(floor(round(value / 500.0::DOUBLE, 4) * 10), ms) FILTER (WHERE k = 4), 10) AS bl FROM scored)
    SELECT event_id, CASE WHEN n % 20 >= bl THEN 'CRITICAL' WHEN anomaly_score >= cr THEN 'CRITICAL' WHEN anomaly_score >= hi THEN 'HIGH'
      WHEN anomaly_score >= me THEN 'MEDIUM' WHEN anomaly_score >= lo THEN 'LOW' ELSE 'NONE' END AS severity
    FROM scored, t""",
)
register(
    "a09_worker_severity",
    lambda s, sf: scored(s, sf).select(
        "event_id", sev.worker_severity(F.col("anomaly_score"), F.col("is_anomaly")).alias("severity")
    ),
    f"""{S} SELECT event_id, CASE WHEN NOT is_anomaly THEN 'LOW' WHEN anomaly_score >= 0.9::DOUBLE THEN 'CRITICAL'
    WHEN anomaly_score >= 0.75::DOUBLE THEN 'HIGH' WHEN anomaly_score >= 0.5::DOUBLE THEN 'MEDIUM'
    ELSE 'LOW' END AS severity FROM scored""",
)
register(
    "a10_lowercase_severity",
    lambda s, sf: scored(s, sf).select("event_id", sev.lowercase_severity(F.col("anomaly_score")).alias("severity")),
    f"""{S} SELECT event_id, CASE WHEN anomaly_score >= 0.95::DOUBLE THEN 'critical'
    WHEN anomaly_score >= 0.85::DOUBLE THEN 'high' WHEN anomaly_score >= 0.75::DOUBLE THEN 'medium'
    ELSE 'low' END AS severity FROM scored""",
)


def in_ranges(s, sf):
    e = scored(s, sf)
    return e.agg(
        *[
            F.count_if(sev.in_severity_range(F.col("anomaly_score"), n)).alias(n.lower())
            for n in ("LOW", "MEDIUM", "HIGH", "CRITICAL")
        ]
    )


register(
    "a11_severity_ranges",
    in_ranges,
    f"""{S} SELECT count(*) FILTER (WHERE sv = 'LOW') AS low, count(*) FILTER (WHERE sv = 'MEDIUM') AS medium,
    count(*) FILTER (WHERE sv = 'HIGH') AS high, count(*) FILTER (WHERE sv = 'CRITICAL') AS critical
    FROM (SELECT {LADDER} AS sv FROM scored)""",
)


def all_alerts(s, sf):
    return alerts.build_alerts(
        scored(s, sf), rules_of(s, sf), WIDE, control(s, sf)[2], WIDE_MS, WIDE_CHUNK
    )


# With these settings every kept anomaly is an alert, CRITICAL from three in 6 hours.
ALERTS_SQL = f"""{CONTROL_SQL},
  clears AS (SELECT source_id, ms FROM scored WHERE event_type = 'view' AND value >= 60),
  counted AS ({burst_sql('kept', 0.3, '''AND NOT EXISTS (SELECT 1 FROM clears c
        WHERE c.source_id = a.source_id AND c.ms > h.ms AND c.ms <= a.ms)''')}),
  graded AS (SELECT *, CASE WHEN burst_count >= 3 THEN 'CRITICAL' WHEN anomaly_score >= 0.95::DOUBLE THEN 'CRITICAL'
      WHEN anomaly_score >= 0.3::DOUBLE THEN 'HIGH' ELSE 'NONE' END AS severity FROM counted),
  alerts AS (SELECT {UUID5.format('event_id')} AS alert_id, event_id, source_id, anomaly_score AS score, severity,
      burst_count, event_time AS created_at,
      'http://localhost:3000/d/anomaly-events?var-source_id=' || source_id || '&var-event_id=' || event_id
        AS dashboard_url FROM graded WHERE severity <> 'NONE')"""
register(
    "a12_actionable",
    lambda s, sf: scored(s, sf)
    .select("event_id", sev.alert_severity(F.col("anomaly_score")).alias("severity"))
    .filter(sev.is_actionable(F.col("severity"))),
    f"{S} SELECT event_id, {LADDER} AS severity FROM scored WHERE {LADDER} <> 'NONE'",
)
register("a13_build_alerts", all_alerts, f"{ALERTS_SQL} SELECT * FROM alerts")
PLAIN_ALERTS_SQL = f"""{S}, alerts AS (
  SELECT {UUID5.format('event_id')} AS alert_id, event_id, source_id, anomaly_score AS score, {LADDER} AS severity,
    event_time AS created_at, count(*) FILTER (WHERE anomaly_score >= 0.9::DOUBLE) OVER (
      PARTITION BY source_id ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS burst_count,
    'http://localhost:3000/d/anomaly-events?var-source_id=' || source_id || '&var-event_id=' || event_id
      AS dashboard_url
  FROM scored WHERE is_anomaly)"""


def plain_alerts(s, sf):
    return alerts.build_alerts(scored(s, sf))


register(
    "a14_channel_fan_out",
    lambda s, sf: notify.fan_out(plain_alerts(s, sf)).select("alert_id", "severity", "channel", "sla_seconds"),
    f"""{PLAIN_ALERTS_SQL} SELECT alert_id, severity, channel, sla_seconds FROM alerts JOIN (VALUES
      ('MEDIUM', 'slack', 10), ('HIGH', 'slack', 30), ('CRITICAL', 'slack', 60),
      ('HIGH', 'email', 30), ('CRITICAL', 'email', 60), ('CRITICAL', 'pagerduty', 60)
    ) c(level, channel, sla_seconds) ON severity = level""",
)
register(
    "a15_sla_seconds",
    lambda s, sf: plain_alerts(s, sf).select("alert_id", sev.sla_seconds(F.col("severity")).alias("sla_seconds")),
    f"""{PLAIN_ALERTS_SQL} SELECT alert_id, CASE severity WHEN 'LOW' THEN 5 WHEN 'MEDIUM' THEN 10 WHEN 'HIGH' THEN 30
    WHEN 'CRITICAL' THEN 60 ELSE 0 END AS sla_seconds FROM alerts""",
)
SCORE4 = "printf('%.{1}f', {0})"


def payload_fields(s, sf):
    n = notify.notifications(plain_alerts(s, sf), "oncall@example.org, ,ops@example.org", "key")
    j = lambda path: F.get_json_object("payload", path)
    return n.select(
        "alert_id",
        "channel",
        F.coalesce(j("$.attachments[0].color"), j("$.personalizations[0].to[1].email"), j("$.dedup_key")).alias(
            "target"
        ),
        F.coalesce(j("$.attachments[0].blocks[0].text.text"), j("$.subject"), j("$.payload.summary")).alias("title"),
        F.coalesce(j("$.attachments[0].blocks[2].elements[0].url"), j("$.links[0].href")).alias("link"),
        j("$.payload.timestamp").alias("stamp"),
        j("$.content[0].value").alias("body"),
    )


register(
    "a16_channel_payloads",
    payload_fields,
    f"""{PLAIN_ALERTS_SQL}, c AS (SELECT *, {SCORE4.format('score', 4)} AS s4 FROM alerts JOIN (VALUES
      ('MEDIUM', 'slack'), ('HIGH', 'slack'), ('CRITICAL', 'slack'), ('HIGH', 'email'), ('CRITICAL', 'email'),
      ('CRITICAL', 'pagerduty')) c(level, channel) ON severity = level)
    SELECT alert_id, channel,
      CASE channel WHEN 'slack' THEN CASE severity WHEN 'MEDIUM' THEN '#ffa500' WHEN 'HIGH' THEN '#e01e5a' ELSE '#7b0000' END
        WHEN 'email' THEN 'ops@example.org' ELSE alert_id END AS target,
      CASE channel WHEN 'slack' THEN CASE severity WHEN 'MEDIUM' THEN '🟠' WHEN 'HIGH' THEN '🔴' ELSE '🚨' END
          || '  *[' || severity || ']*  `source_id=' || source_id || '`  —  score: *' || s4 || '*'
        WHEN 'email' THEN '[' || severity || '] Anomaly Alert — source_id=' || source_id
        ELSE '[' || severity || '] Anomaly on source_id=' || source_id || ' score=' || s4 END AS title,
      CASE WHEN channel <> 'email' THEN dashboard_url END AS link,
      CASE WHEN channel = 'pagerduty' THEN CASE WHEN epoch_us(created_at) % 1000000 = 0
        THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00')
        ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') END END AS stamp,
      CASE WHEN channel = 'email' THEN concat_ws(chr(10), 'ANOMALY ALERT — ' || severity, repeat('=', 50),
        'Alert ID    : ' || alert_id, 'Event ID    : ' || event_id, 'Source ID   : ' || source_id,
        'Score       : ' || s4, 'Severity    : ' || severity, 'Burst Count : ' || burst_count || ' HIGH+/60 s',
        'Detected At : ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' UTC', '',
        'Dashboard   : ' || dashboard_url, '',
        'Please review via: PATCH /api/events/' || event_id || '/label' || chr(10)) END AS body
    FROM c""",
)
def pager_events(s, sf):
    """Trigger details of the pages and the event that resolves each."""
    a = plain_alerts(s, sf).filter("severity = 'CRITICAL'")
    j = lambda path: F.get_json_object("payload", path)
    a = a.select("alert_id", notify.pager_trigger("key").alias("payload"), notify.pager_resolve("key").alias("resolve"))
    return a.select(
        "alert_id", "resolve", j("$.routing_key").alias("routing_key"), j("$.event_action").alias("action"),
        j("$.payload.source").alias("source"), j("$.payload.severity").alias("severity"), j("$.payload.class").alias("kind"),
        F.concat_ws("/", j("$.payload.component"), j("$.payload.group")).alias("place"),
        j("$.payload.custom_details.event_id").alias("event_id"),
        F.round(j("$.payload.custom_details.anomaly_score").cast("double"), 9).alias("score"),
        j("$.payload.custom_details.burst_count").cast("bigint").alias("burst_count"),
        j("$.payload.custom_details.severity").alias("level"), j("$.links[0].text").alias("link_text"),
    )


register(
    "a16_pager_events",
    pager_events,
    f"""{PLAIN_ALERTS_SQL} SELECT alert_id,
      '{{"routing_key":"key","dedup_key":"' || alert_id || '","event_action":"resolve"}}' AS resolve, 'key' AS routing_key,
      'trigger' AS action, source_id AS source, 'critical' AS severity, 'anomaly' AS kind, 'scoring/event-scoring' AS place,
      event_id, round(score, 9) AS score, burst_count, severity AS level, 'Dashboard' AS link_text
    FROM alerts WHERE severity = 'CRITICAL'""",
)
register(
    "a16_email_html",
    lambda s, sf: plain_alerts(s, sf).filter("severity IN ('HIGH', 'CRITICAL')").withColumn(
        "source_id", F.concat(F.lit("<b>&"), "source_id")
    ).select("alert_id", notify.html_text().alias("html")),
    f"""{PLAIN_ALERTS_SQL}, e AS (SELECT *, replace(dashboard_url, '&', '&amp;') AS url FROM alerts
      WHERE severity IN ('HIGH', 'CRITICAL'))
    SELECT alert_id, '<html><body><h1 style="color:' || CASE severity WHEN 'HIGH' THEN '#e01e5a' ELSE '#7b0000' END
      || '">Anomaly Alert — ' || severity || '</h1><table><tr><th>Alert ID</th><td>' || alert_id
      || '</td></tr><tr><th>Event ID</th><td>' || event_id || '</td></tr><tr><th>Source ID</th><td>&lt;b&gt;&amp;' || source_id
      || '</td></tr><tr><th>Anomaly Score</th><td>' || {SCORE4.format('score', 4)} || ' (' || {SCORE4.format('score * 100', 1)}
      || '%)</td></tr><tr><th>Severity</th><td>' || severity || '</td></tr><tr><th>Burst Count</th><td>' || burst_count
      || ' HIGH+ alerts / 60 s</td></tr><tr><th>Detected At</th><td>' || strftime(created_at, '%Y-%m-%d %H:%M:%S')
      || ' UTC</td></tr></table><a href="' || url || '">Open Dashboard</a></body></html>' AS html FROM e""",
)
register(
    "a17_alert_summary",
    lambda s, sf: plain_alerts(s, sf).select(
        "alert_id",
        notify.summary_text(F.col("score"), F.col("severity"), F.col("source_id")).alias("summary"),
    ),
    f"""{PLAIN_ALERTS_SQL} SELECT alert_id, 'Anomaly detected: score=' || {SCORE4.format('score', 3)} ||
    ', severity=' || severity || ', source=' || source_id || '.' AS summary FROM alerts""",
)
register(
    "a18_route",
    lambda s, sf: notify.with_route(plain_alerts(s, sf)).select("alert_id", "severity", "route"),
    f"""{PLAIN_ALERTS_SQL} SELECT alert_id, severity, CASE severity WHEN 'LOW' THEN 'end' WHEN 'MEDIUM'
    THEN 'notify_node' ELSE 'escalate_node' END AS route FROM alerts""",
)


def transitions(s, sf):
    """A hand-over log: events of a source act on the alerts of that source's anomalies.

    Every purchase acknowledges and every signup resolves the alert named by its
    own event id or by the id derived from its ``k``.
    """
    e = table(s, sf, "events")
    target = F.when(F.col("value") >= 60, F.col("event_id")).otherwise(
        (F.col("event_id") * 7 + F.get_json_object("props", "$.k").cast("bigint")) % F.lit(1000)
    )
    return e.filter(F.col("event_type").isin("purchase", "signup", "click")).select(
        uuid5(target.cast("string")).alias("alert_id"),
        F.when(F.col("event_type") == "signup", "RESOLVE").otherwise("ACKNOWLEDGE").alias("action"),
        F.concat(F.lit("analyst-"), F.get_json_object("props", "$.k")).alias("analyst_id"),
        F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("text"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("seq"),
    )


LIFE_SQL = f"""{PLAIN_ALERTS_SQL}, tr AS (
  SELECT {UUID5.format('''CAST(CASE WHEN value >= 60 THEN n ELSE (n * 7 + CAST(k AS BIGINT)) % 1000 END AS VARCHAR)''')}
      AS alert_id, CASE event_type WHEN 'signup' THEN 'RESOLVE' ELSE 'ACKNOWLEDGE' END AS action,
    'analyst-' || CAST(k AS BIGINT) AS analyst_id, 'note ' || n AS text, event_time AS "at", n AS seq
  FROM scored WHERE event_type IN ('purchase', 'signup', 'click')),
  first_res AS (SELECT alert_id, min(("at", seq)) AS fr FROM tr WHERE action = 'RESOLVE' GROUP BY 1),
  res AS (SELECT * FROM tr WHERE action = 'RESOLVE'
    QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY "at" DESC, seq DESC) = 1),
  ack AS (SELECT tr.* FROM tr LEFT JOIN first_res f USING (alert_id)
    WHERE action = 'ACKNOWLEDGE' AND (fr IS NULL OR ("at", seq) < fr)
    QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY "at" DESC, seq DESC) = 1),
  states AS (SELECT a.*, CASE WHEN r.seq IS NOT NULL THEN 'RESOLVED' WHEN k.seq IS NOT NULL THEN 'ACKNOWLEDGED'
      ELSE 'ACTIVE' END AS status, coalesce(r.analyst_id, k.analyst_id) AS analyst_id, k.text AS note,
      r.text AS resolution, k."at" AS acknowledged_at, r."at" AS resolved_at
    FROM alerts a LEFT JOIN res r USING (alert_id) LEFT JOIN ack k USING (alert_id))"""


def states(s, sf):
    return alerts.alert_states(plain_alerts(s, sf), transitions(s, sf))


register("a19_a20_alert_states", states, f"{LIFE_SQL} SELECT * FROM states")
register(
    "a19_rejected_transitions",
    lambda s, sf: alerts.rejected_transitions(plain_alerts(s, sf), transitions(s, sf)).select(
        "alert_id", "action", "seq", "problem"
    ),
    f"""{LIFE_SQL} SELECT alert_id, action, seq, 'Alert not found' AS problem FROM tr
      WHERE alert_id NOT IN (SELECT alert_id FROM alerts)
    UNION ALL SELECT alert_id, action, seq, 'Cannot acknowledge a resolved alert.' FROM tr JOIN first_res USING (alert_id)
      WHERE action = 'ACKNOWLEDGE' AND ("at", seq) > fr AND alert_id IN (SELECT alert_id FROM alerts)""",
)


def label_log(s, sf):
    """Analyst labels derived from the events; some name unknown events or labels."""
    e = table(s, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    names = F.array(*[F.lit(x) for x in ("TP", "FP", "TN", "FN", "??")])
    return e.select(
        F.when(k >= 97, F.concat(F.lit("x"), F.col("event_id").cast("string")))
        .otherwise(F.col("event_id").cast("string"))
        .alias("event_id"),
        F.get(names, F.when(F.col("value") >= 140, k % 2).otherwise(F.when(k < 95, 2 + k % 2).otherwise(4))).alias(
            "label"
        ),
        F.concat(F.lit("analyst-"), (k % 7).cast("string")).alias("analyst_id"),
        F.col("ts").cast("timestamp").alias("labeled_at"),
    )


LABELS_SQL = f"""{S}, labels_log AS (
  SELECT CASE WHEN k >= 97 THEN 'x' || event_id ELSE event_id END AS event_id,
    ['TP', 'FP', 'TN', 'FN', '??'][CAST(CASE WHEN value >= 140 THEN k % 2 WHEN k < 95 THEN 2 + k % 2 ELSE 4 END AS INT) + 1]
      AS label, 'analyst-' || (CAST(k AS BIGINT) % 7) AS analyst_id, event_time AS labeled_at FROM scored)"""
register(
    "a21_labels_accepted",
    lambda s, sf: alerts.apply_labels(label_log(s, sf), scored(s, sf))[0],
    f"""{LABELS_SQL} SELECT * FROM labels_log WHERE label <> '??' AND event_id IN (SELECT event_id FROM scored)""",
)
register(
    "a21_labels_rejected",
    lambda s, sf: alerts.apply_labels(label_log(s, sf), scored(s, sf))[1].select("event_id", "label", "problem"),
    f"""{LABELS_SQL} SELECT event_id, label, CASE label WHEN '??' THEN 'Invalid label. Must be TP, FP, TN, or FN.'
      ELSE 'Event not found' END AS problem FROM labels_log
    WHERE label = '??' OR event_id NOT IN (SELECT event_id FROM scored)""",
)

# Read-side queries on alerts.
register(
    "q15_active_alert_count",
    lambda s, sf: queries.active_alert_count(states(s, sf)),
    f"{LIFE_SQL} SELECT count(*) FILTER (WHERE status = 'ACTIVE') AS active_alerts FROM states",
)
register(
    "q23_list_alerts",
    lambda s, sf: queries.list_alerts(states(s, sf), "RESOLVED", limit=100, offset=3),
    f"""{LIFE_SQL} SELECT * FROM states WHERE status = 'RESOLVED'
    ORDER BY created_at DESC, alert_id LIMIT 100 OFFSET 3""",
)
register(
    "q24_alert_details",
    lambda s, sf: queries.alert_details(
        plain_alerts(s, sf).select("alert_id", "source_id", "severity"), scored(s, sf)
    ),
    f"""{PLAIN_ALERTS_SQL}, top AS (
      SELECT source_id, event_id, event_time, anomaly_score,
        row_number() OVER (PARTITION BY source_id ORDER BY event_time DESC, event_id) AS rank
      FROM scored WHERE is_anomaly)
    SELECT alert_id, a.source_id, severity, t.event_time AS linked_event_time, t.event_id AS linked_event_id,
      t.anomaly_score AS linked_score, CAST(t.rank AS INTEGER) AS rank
    FROM alerts a LEFT JOIN top t ON a.source_id = t.source_id AND t.rank <= 10""",
)
register(
    "q25_alerts_by_severity",
    lambda s, sf: queries.alerts_by_severity(plain_alerts(s, sf)),
    f"{PLAIN_ALERTS_SQL} SELECT severity, count(*) AS alert_count FROM alerts GROUP BY 1",
)
