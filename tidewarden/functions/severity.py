"""Severity ladders, severity ranges, routing and SLA as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.schema import (
    ALERT_LADDER,
    BURST_LIMIT,
    CHANNELS,
    LOWERCASE_LADDER,
    SLA_SECONDS,
    WORKER_LADDER,
)


@dataclass(frozen=True)
class AlertThresholds:
    """The five alert settings that may be overridden at run time."""

    low: float = 0.70
    medium: float = 0.80
    high: float = 0.90
    critical: float = 0.95
    burst_limit: int = BURST_LIMIT

    @classmethod
    def from_settings(cls, settings: dict[str, float]) -> AlertThresholds:
        """Overrides by setting name; names that are absent keep their default."""
        known = {k: v for k, v in settings.items() if k in cls.__dataclass_fields__}
        if "burst_limit" in known:
            known["burst_limit"] = int(known["burst_limit"])
        return cls(**known)

    @classmethod
    def from_table(cls, settings: DataFrame) -> AlertThresholds:
        """Newest value per name of a settings log (name, value, at); five names count."""
        known = settings.filter(F.col("name").isin(list(cls.__dataclass_fields__)))
        rows = known.groupBy("name").agg(F.max_by("value", "at").alias("value")).collect()
        return cls.from_settings({r["name"]: r["value"] for r in rows})

    def ladder(self) -> list[tuple[str, float]]:
        return [(name, getattr(self, name.lower())) for name, _ in ALERT_LADDER]


def _climb(score: Column, ladder: list[tuple[str, float]], otherwise: str) -> Column:
    (name, bound), *rest = ladder
    expr = F.when(score >= F.lit(float(bound)), F.lit(name))
    for name, bound in rest:
        expr = expr.when(score >= F.lit(float(bound)), F.lit(name))
    return expr.otherwise(F.lit(otherwise))


def alert_severity(
    score: Column, burst: Column | None = None, thresholds: AlertThresholds = AlertThresholds()
) -> Column:
    """Canonical alert severity; a burst makes any score CRITICAL."""
    by_score = _climb(score, thresholds.ladder(), "NONE")
    if burst is None:
        return by_score
    return F.when(burst >= F.lit(thresholds.burst_limit), F.lit("CRITICAL")).otherwise(by_score)


def worker_severity(score: Column, flagged: Column) -> Column:
    """Severity the scoring job writes: LOW unless the event is flagged."""
    return F.when(flagged, _climb(score, WORKER_LADDER, "LOW")).otherwise(F.lit("LOW"))


def lowercase_severity(score: Column) -> Column:
    return _climb(score, LOWERCASE_LADDER, "low")


def in_severity_range(score: Column, severity: str) -> Column:
    """Score range of one severity. Half-open, so no score falls between two."""
    names = [name for name, _ in ALERT_LADDER]
    wanted = severity.upper()
    if wanted not in names:
        raise ValueError("severity must be one of LOW, MEDIUM, HIGH, CRITICAL")
    position = names.index(wanted)
    keep = score >= F.lit(ALERT_LADDER[position][1])
    if position == 0:
        return keep & (score <= F.lit(1.0))
    return keep & (score < F.lit(ALERT_LADDER[position - 1][1]))


def is_actionable(severity: Column) -> Column:
    return severity != F.lit("NONE")


def channels(severity: Column) -> Column:
    """Array of the channels an alert of this severity goes to."""
    return F.array_compact(
        F.array(
            *[F.when(severity.isin(levels), F.lit(name)) for name, levels in CHANNELS.items()]
        )
    )


def sla_seconds(severity: Column) -> Column:
    pairs = [F.lit(x) for name, secs in SLA_SECONDS.items() for x in (name, secs)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), severity), F.lit(0))


def route(severity: Column) -> Column:
    """Next step for an alert: LOW ends, MEDIUM notifies, the rest escalates."""
    level = F.coalesce(severity, F.lit("LOW"))
    return (
        F.when(level == "LOW", F.lit("end"))
        .when(level == "MEDIUM", F.lit("notify_node"))
        .otherwise(F.lit("escalate_node"))
    )
