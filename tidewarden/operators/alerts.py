"""From scored events to alerts: silences, bursts, severity, alert records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions.identity import uuid5
from tidewarden.functions.severity import AlertThresholds, alert_severity, is_actionable
from tidewarden.functions.timebuckets import literal_ts
from tidewarden.operators.sweep import STORM, markers, running
from tidewarden.schema import BURST_WINDOW_MS, DASHBOARD, REFUSAL
from tidewarden.session import cut_lineage

ALL_SOURCES = "*"


# --- silences ------------------------------------------------------------------


def silence_rows(requests: DataFrame, max_minutes: int | None = None) -> DataFrame:
    """Silence requests (source_id, duration_minutes, reason, created_at) as rules.

    Requests shorter than one minute, or longer than ``max_minutes`` where that
    is given, are not turned into rules. A null source means all sources.
    """
    ok = F.col("duration_minutes") >= 1
    if max_minutes is not None:
        ok = ok & (F.col("duration_minutes") <= max_minutes)
    source = F.coalesce("source_id", F.lit(ALL_SOURCES))
    return requests.filter(ok).select(
        uuid5(F.concat_ws("|", source, F.unix_micros("created_at").cast("string"))).alias(
            "silence_id"
        ),
        F.nullif(source, F.lit(ALL_SOURCES)).alias("source_id"),
        F.col("duration_minutes").cast("int").alias("duration_minutes"),
        "reason",
        "created_at",
        F.timestamp_micros(
            F.unix_micros("created_at") + F.col("duration_minutes").cast("bigint") * 60_000_000
        ).alias("expires_at"),
    )


def effective_silences(rules: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """Rules with the end that really applies.

    Adding a rule for a source again replaces the old one, and a removal
    (source_id, removed_at) ends it, so a rule holds until its expiry or the next
    entry for the same source, whichever is first.
    """
    log = rules.select(
        F.coalesce("source_id", F.lit(ALL_SOURCES)).alias("scope"),
        F.col("created_at").alias("at"),
        F.lit(1).alias("adds"),
        "silence_id",
        "duration_minutes",
        "reason",
        "expires_at",
    )
    if removals is not None:
        log = log.unionByName(
            removals.select(
                F.coalesce("source_id", F.lit(ALL_SOURCES)).alias("scope"),
                F.col("removed_at").alias("at"),
                F.lit(0).alias("adds"),
            ),
            allowMissingColumns=True,
        )
    by_scope = Window.partitionBy("scope").orderBy("at", "adds", "silence_id")
    return (
        log.withColumn("next_at", F.lead("at").over(by_scope))
        .filter("adds = 1")
        .select(
            "silence_id",
            "scope",
            "duration_minutes",
            "reason",
            F.col("at").alias("created_at"),
            F.least("expires_at", "next_at").alias("ends_at"),
        )
        .filter("ends_at > created_at")
    )


def active_silences(effective: DataFrame, as_of: dt.datetime) -> DataFrame:
    now = literal_ts(as_of)
    return effective.filter((F.col("created_at") <= now) & (F.col("ends_at") > now))


def silence_info(effective: DataFrame, source_id: str, as_of: dt.datetime) -> DataFrame:
    """The rule of this one source, if it is active."""
    return active_silences(effective, as_of).filter(F.col("scope") == source_id)


HOUR_US = 3_600_000_000
LEVELS = 12  # cells of 4^0 .. 4^12 hours: beyond all times that a timestamp can hold


def interval_cells(start: Column, end: Column) -> Column:
    """Cells (level, cell) that cover the hours [start, end): cell c of a level is 4^level hours long.

    The longest aligned cells that fit inside, and shorter ones towards both ends: at most six per
    level, so an interval of n hours takes about three log2 n cells at most.
    """
    size = lambda k: F.lit(4**k)
    first = lambda k: F.ceil(start / size(k)).cast("bigint")
    last = lambda k: F.floor(end / size(k)).cast("bigint")

    def cells(k: int, a: Column, b: Column) -> Column:
        run = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(run, lambda c: F.struct(F.lit(k).alias("level"), c.alias("cell")))

    out = [cells(LEVELS, first(LEVELS), last(LEVELS))]
    for k in range(LEVELS):
        a, b, up, down = first(k), last(k), first(k + 1) * 4, last(k + 1) * 4
        inner = up < down  # whole cells of the next level lie between
        out.append(cells(k, a, F.when(inner, up).otherwise(b)))
        out.append(cells(k, F.when(inner, down).otherwise(b), b))
    return F.concat(*out)


def silence_cells(effective: DataFrame) -> DataFrame:
    """scope, _from, _to, level, cell: every rule spread over the cells of its hours."""
    start = F.floor(F.unix_micros("created_at") / F.lit(HOUR_US))
    end = F.floor((F.unix_micros("ends_at") - 1) / F.lit(HOUR_US)) + 1
    return effective.select(
        F.col("scope"), F.col("created_at").alias("_from"), F.col("ends_at").alias("_to"),
        F.inline(interval_cells(start, end)),
    )


def unsilenced(events: DataFrame, effective: DataFrame, ts: str = "event_time") -> DataFrame:
    """Events no rule covers at their time, ``created <= t < end``.

    A rule is spread over the cells that make up its hours, few for a rule of any length, so for
    each level of cells in use both look-ups are equality joins (source and cell; cell alone for
    rules on all sources) with the exact bounds as residue. None becomes a nested loop, and no side
    is forced to be broadcast: the rules are broadcast only if measured to be small.
    """
    spread = cut_lineage(silence_cells(effective))
    levels = [r.level for r in spread.select("level").distinct().orderBy("level").collect()]  # LEVELS at most
    hour = F.floor(F.unix_micros(ts) / F.lit(HOUR_US))
    kept = events.withColumn("_hour", hour)
    for level in levels:
        inside = (
            (F.shiftright("_hour", 2 * level) == F.col("cell"))
            & (F.col(ts) >= F.col("_from"))
            & (F.col(ts) < F.col("_to"))
        )
        rules = spread.filter(F.col("level") == level)
        own = rules.filter(F.col("scope") != ALL_SOURCES)
        everywhere = rules.filter(F.col("scope") == ALL_SOURCES).drop("scope")
        kept = kept.join(own, (F.col("source_id") == F.col("scope")) & inside, "left_anti")
        kept = kept.join(everywhere, inside, "left_anti")
    return kept.drop("_hour")


# --- bursts --------------------------------------------------------------------


def burst_counts(
    events: DataFrame,
    high: float = AlertThresholds().high,
    window_ms: int = BURST_WINDOW_MS,
    chunk_ms: int = 600_000,
    clears: DataFrame | None = None,
    key: str = "source_id",
    score: str = "anomaly_score",
    storm: int = STORM,
) -> DataFrame:
    """Adds ``burst_count``: HIGH+ events of the source in (t - window, t].

    An event at HIGH or above counts itself; one below only reads. Of events on
    the same millisecond the one with the smaller ``event_id`` comes first and
    does not see the other, as when they arrive one after the other. ``clears``
    (source_id, cleared_at) restart the count: what was counted before is gone.
    """
    if chunk_ms < window_ms:
        raise ValueError("a chunk must not be shorter than the window")
    base = events.withColumn("_ms", F.unix_millis("event_time"))
    leaves = F.col("_ms") + F.lit(window_ms)
    drop = ["_ms"]
    if clears is not None:
        # The clears that can reach an event lie in its slot or the next one.
        slot = lambda c: F.floor(c / F.lit(window_ms))
        c = clears.select(
            F.col("source_id").alias("_source"), F.unix_millis("cleared_at").alias("_cleared")
        )
        c = (
            c.select(
                "_source",
                "_cleared",
                F.explode(
                    F.array(slot(F.col("_cleared")), slot(F.col("_cleared")) - 1)
                ).alias("_slot_of"),
            )
            .groupBy("_source", "_slot_of")
            .agg(F.array_sort(F.collect_set("_cleared")).alias("_clears"))
        )
        base = base.withColumn("_slot", slot(F.col("_ms"))).join(
            c, (F.col(key) == F.col("_source")) & (F.col("_slot") == F.col("_slot_of")), "left"
        ).drop("_source", "_slot_of")
        following = F.array_min(F.filter("_clears", lambda x: x > F.col("_ms")))
        base = base.withColumn("_next_clear", following).drop("_clears", "_slot")
        leaves = F.least(leaves, F.col("_next_clear"))
        drop += ["_next_clear"]
    base = base.withColumn("_leaves", leaves)
    counts = F.coalesce(F.col(score) >= F.lit(high), F.lit(False))
    m = markers(base, key, "_ms", F.col("_leaves"), counts, chunk_ms, ["event_id"])
    m = running(m, [key, "chunk"], ["at", "phase", "event_id"], {"burst_count": F.col("sign")}, most=storm)
    return m.filter(F.col("row").isNotNull()).select("row.*", "burst_count").drop("_leaves", *drop)


# --- alert records --------------------------------------------------------------


def dashboard_link(source_id: Column, event_id: Column, base: str = DASHBOARD) -> Column:
    return F.concat(
        F.lit(f"{base}/d/anomaly-events?var-source_id="), source_id,
        F.lit("&var-event_id="), event_id,
    )


def build_alerts(
    scored: DataFrame,
    silences: DataFrame | None = None,
    thresholds: AlertThresholds = AlertThresholds(),
    clears: DataFrame | None = None,
    window_ms: int = BURST_WINDOW_MS,
    chunk_ms: int = 600_000,
    base_url: str = DASHBOARD,
) -> DataFrame:
    """Alerts of the scored events, in the order the rules apply.

    Only anomalies; silenced ones dropped before counting; burst count; severity;
    NONE dropped. The alert id is derived from the event id, so a replay yields
    the same alert, and the alert is dated by the event.
    """
    anomalies = scored.filter("is_anomaly").select(
        "event_id", "source_id", "event_time", "anomaly_score"
    )
    if silences is not None:
        anomalies = unsilenced(anomalies, silences)
    counted = burst_counts(anomalies, thresholds.high, window_ms, chunk_ms, clears)
    severity = alert_severity(F.col("anomaly_score"), F.col("burst_count"), thresholds)
    return (
        counted.withColumn("severity", severity)
        .filter(is_actionable(F.col("severity")))
        .select(
            uuid5(F.col("event_id")).alias("alert_id"),
            "event_id",
            "source_id",
            F.col("anomaly_score").alias("score"),
            "severity",
            "burst_count",
            F.col("event_time").alias("created_at"),
            dashboard_link(F.col("source_id"), F.col("event_id"), base_url).alias("dashboard_url"),
        )
    )


# --- life cycle -----------------------------------------------------------------


def _order() -> Column:
    return F.struct("at", "seq")


def alert_states(alerts: DataFrame, transitions: DataFrame) -> DataFrame:
    """Alerts with the state their transition log leads to.

    ``transitions``: alert_id, action (ACKNOWLEDGE or RESOLVE), analyst_id, text,
    at, seq. Resolving is allowed from any state, acknowledging only before the
    first resolve. Aggregations carry partial results, so an alert with a very
    long log is folded map-side.
    """
    resolved = (
        transitions.filter("action = 'RESOLVE'")
        .groupBy("alert_id")
        .agg(
            F.min(_order()).alias("first_resolve"),
            F.max_by(F.struct("analyst_id", "text", "at"), _order()).alias("r"),
        )
    )
    acknowledged = (
        _legal_acks(transitions, resolved)
        .groupBy("alert_id")
        .agg(F.max_by(F.struct("analyst_id", "text", "at"), _order()).alias("a"))
    )
    return (
        alerts.join(acknowledged, "alert_id", "left")
        .join(resolved.drop("first_resolve"), "alert_id", "left")
        .select(
            *alerts.columns,
            F.when(F.col("r").isNotNull(), F.lit("RESOLVED"))
            .when(F.col("a").isNotNull(), F.lit("ACKNOWLEDGED"))
            .otherwise(F.lit("ACTIVE"))
            .alias("status"),
            F.coalesce("r.analyst_id", "a.analyst_id").alias("analyst_id"),
            F.col("a.text").alias("note"),
            F.col("r.text").alias("resolution"),
            F.col("a.at").alias("acknowledged_at"),
            F.col("r.at").alias("resolved_at"),
        )
    )


def _legal_acks(transitions: DataFrame, resolved: DataFrame) -> DataFrame:
    acks = transitions.filter("action = 'ACKNOWLEDGE'")
    return acks.join(resolved.select("alert_id", "first_resolve"), "alert_id", "left").filter(
        F.col("first_resolve").isNull() | (_order() < F.col("first_resolve"))
    )


def rejected_transitions(alerts: DataFrame, transitions: DataFrame) -> DataFrame:
    """Transitions that were refused, with the reason."""
    known = transitions.join(alerts.select("alert_id"), "alert_id", "left_semi")
    unknown = transitions.join(alerts.select("alert_id"), "alert_id", "left_anti")
    first = (
        known.filter("action = 'RESOLVE'")
        .groupBy("alert_id")
        .agg(F.min(_order()).alias("first_resolve"))
    )
    late = (
        known.filter("action = 'ACKNOWLEDGE'")
        .join(first, "alert_id")
        .filter(_order() > F.col("first_resolve"))
        .drop("first_resolve")
    )
    return late.withColumn("problem", F.lit(REFUSAL["acknowledge"])).unionByName(
        unknown.withColumn("problem", F.lit(REFUSAL["alert"]))
    )


def apply_labels(labels: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) analyst labels: the event must exist, the label be known."""
    from tidewarden.operators.decode import label_allowed

    # The events are only probed with the labels' ids; what comes out is no larger than those.
    wanted = labels.select("event_id").distinct()
    found = events.select("event_id").join(wanted, "event_id", "left_semi").distinct()
    found = found.select(F.col("event_id").alias("_id"))
    known = labels.join(found, F.col("event_id") == F.col("_id"), "left")
    allowed = label_allowed(F.col("label"))
    ok = known.filter(allowed & F.col("_id").isNotNull()).drop("_id")
    problem = F.when(~allowed, REFUSAL["label"]).when(F.col("_id").isNull(), REFUSAL["event"])
    rejected = known.withColumn("problem", problem).filter("problem IS NOT NULL").drop("_id")
    return ok, rejected
