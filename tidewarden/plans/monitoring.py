"""Counters, latency percentiles, lag, completeness and throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions.severity import worker_severity
from tidewarden.functions.timebuckets import bucket
from tidewarden.schema import LATENCY_BOUNDS_S

TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def status_counts(scored: DataFrame, dead: DataFrame) -> DataFrame:
    """Processed events by outcome; both outcomes are always listed."""
    done = scored.agg(F.count("*").alias("events")).select(
        F.lit("success").alias("status"), "events"
    )
    return done.unionByName(
        dead.agg(F.count("*").alias("events")).select(F.lit("error").alias("status"), "events")
    )


def severity_counts(scored: DataFrame) -> DataFrame:
    """Anomalies per worker severity, 0 for a tier without any; one pass, one row per tier."""
    tier = worker_severity(F.col("anomaly_score"), F.col("is_anomaly"))
    counts = scored.agg(
        *[F.count_if(F.col("is_anomaly") & (tier == name)).alias(name) for name in TIERS]
    )
    return counts.unpivot([], TIERS, "severity", "anomalies")


def latency_histogram(
    events: DataFrame, bounds: list[float] = LATENCY_BOUNDS_S
) -> DataFrame:
    """Cumulative counts per upper bound; the last bound is infinite.

    One aggregation over the events yields all buckets at once.
    """
    seconds = (F.unix_micros("processed_at") - F.unix_micros("event_time")) / F.lit(1e6)
    names = [f"b{i}" for i in range(len(bounds))]
    row = events.agg(
        *[F.count_if(seconds <= F.lit(float(b))).alias(n) for n, b in zip(names, bounds)],
        F.count(seconds).alias("all"),
        F.sum(seconds).alias("latency_sum"),
    )
    le = [*[F.lit(float(b)) for b in bounds], F.lit(float("inf"))]
    cells = F.array(
        *[F.struct(b.alias("le"), F.col(n).alias("count")) for b, n in zip(le, [*names, "all"])]
    )
    return row.select(F.explode(cells).alias("c"), "latency_sum").select("c.*", "latency_sum")


def histogram_percentile(
    histogram: DataFrame, pct: float, overflow: str = "null", by: list[str] = ()
) -> DataFrame:
    """Percentile by linear interpolation inside its bucket.

    ``overflow``: what a percentile in the infinite bucket gives, ``null`` or the
    ``top`` finite bound.
    """
    order = Window.partitionBy(*by).orderBy("le")
    finite = F.col("le") != F.lit(float("inf"))
    cells = (
        histogram.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
        .withColumn("below", F.coalesce(F.lag("count").over(order), F.lit(0)))
        .withColumn("total", F.max("count").over(Window.partitionBy(*by)))
        .withColumn("target", F.col("total") * F.lit(pct / 100.0))
    )
    share = (F.col("target") - F.col("below")) / F.nullif(
        F.col("count") - F.col("below"), F.lit(0)
    )
    inside = F.coalesce(F.col("low") + share * (F.col("le") - F.col("low")), F.col("le"))
    hit = finite & (F.col("count") >= F.col("target")) & (F.col("total") > 0)
    top = F.max(F.when(finite, F.col("le")))
    value = F.min_by(F.when(hit, inside), F.when(hit, F.col("le")))
    if overflow == "top":
        value = F.coalesce(value, F.when(F.max("total") > 0, top))
    return cells.groupBy(*by).agg(value.alias("percentile"))


def partition_lag(offsets: DataFrame) -> DataFrame:
    """Lag per partition from (topic, partition, committed, high).

    Without a committed offset (null or negative) the reader starts at the end,
    so its lag is 0.
    """
    committed = F.when(F.col("committed") >= 0, F.col("committed")).otherwise(F.col("high"))
    return offsets.select(
        "topic", "partition", F.greatest(F.col("high") - committed, F.lit(0)).alias("lag")
    )


def topic_lag(offsets: DataFrame) -> DataFrame:
    return partition_lag(offsets).groupBy("topic").agg(F.sum("lag").alias("lag"))


def progress_counts(progress: DataFrame) -> DataFrame:
    """``status_counts`` from what the queries counted themselves."""
    outcome = F.col("observedMetrics.outcomes")
    done = progress.agg(
        F.coalesce(F.sum(outcome["success"]), F.lit(0)).alias("success"),
        F.coalesce(F.sum(outcome["error"]), F.lit(0)).alias("error"),
    )
    return done.unpivot([], ["success", "error"], "status", "events")


def progress_offsets(progress: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(topic, partition, committed, high) of the newest micro-batch of each query, for ``partition_lag``.

    Topics report both ends per partition. A folder of files reports the rows taken; ``folders``
    (path, rows) tells how many it holds.
    """
    per_topic = "map<string,map<string,bigint>>"
    ends = lambda c: F.from_json(c, per_topic)
    source = progress.select("id", "batchId", F.explode("sources").alias("s"))
    newest = source.groupBy("id", F.col("s.description").alias("description")).agg(
        F.max_by("s", "batchId").alias("s"), F.sum("s.numInputRows").alias("taken")
    )
    high = F.try_element_at(F.try_element_at(ends(F.col("s.latestOffset")), F.col("topic")), F.col("part"))
    topics = newest.select("s", F.explode(ends(F.col("s.endOffset"))).alias("topic", "parts"))
    topics = topics.filter(F.col("topic") != "logOffset").select("s", "topic", F.explode("parts").alias("part", "committed"))
    out = topics.select(
        "topic", F.col("part").cast("int").alias("partition"), "committed", F.coalesce(high, "committed").alias("high")
    )
    if folders is None:
        return out
    path = F.regexp_extract("description", r"^FileStreamSource\[(?:file:)?(.*)\]$", 1)
    held = newest.withColumn("path", path).join(folders.withColumn("path", F.regexp_replace("path", "^file:", "")), "path")
    return out.unionByName(
        held.select(F.col("path").alias("topic"), F.lit(0).alias("partition"), F.col("taken").alias("committed"), F.col("rows").alias("high"))
    )


def id_balance(produced: DataFrame, received: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Ids that were lost, duplicated or never produced.

    Both sides are counted in one aggregation with partial counts, so one shuffle
    replaces two anti joins and a repeated id costs one row per task.
    """
    both = produced.select(F.col(id_column).alias("id"), F.lit(1).alias("p"), F.lit(0).alias("r"))
    both = both.unionByName(
        received.select(F.col(id_column).alias("id"), F.lit(0).alias("p"), F.lit(1).alias("r"))
    )
    counted = both.groupBy("id").agg(F.sum("p").alias("produced"), F.sum("r").alias("received"))
    problem = (
        F.when(F.col("received") == 0, "lost")
        .when(F.col("produced") == 0, "unexpected")
        .when(F.col("received") > 1, "duplicate")
    )
    return counted.withColumn("problem", problem)


def completeness(produced: DataFrame, received: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Counts of produced, received, lost, duplicate and unexpected ids."""
    b = id_balance(produced, received, id_column)
    return b.agg(
        F.count_if(F.col("produced") > 0).alias("produced"),
        F.count_if(F.col("received") > 0).alias("received"),
        F.count_if(F.col("problem") == "lost").alias("lost"),
        F.count_if(F.col("problem") == "duplicate").alias("duplicate"),
        F.count_if(F.col("problem") == "unexpected").alias("unexpected"),
        F.coalesce(F.bool_and(F.col("problem").isNull()), F.lit(True)).alias("complete"),
    )


def throughput_report(scored: DataFrame, expected: int | None = None) -> DataFrame:
    """Events received, time taken, events per second, anomalies, first-result latency."""
    us = lambda c: F.unix_micros(c)
    seconds = (F.max(us("processed_at")) - F.min(us("event_time"))) / F.lit(1e6)
    first = (F.min(us("processed_at")) - F.min(us("event_time"))) / F.lit(1e3)
    report = scored.agg(
        F.count("*").alias("received"),
        seconds.alias("elapsed_s"),
        F.count_if("is_anomaly").alias("anomalies"),
        first.alias("first_result_ms"),
    ).withColumn(
        "events_per_s", F.round(F.col("received") / F.nullif(F.col("elapsed_s"), F.lit(0.0)), 1)
    )
    return report if expected is None else report.withColumn(
        "missing", F.greatest(F.lit(expected) - F.col("received"), F.lit(0))
    )


def topic_metrics(messages: DataFrame, seconds: int = 3600) -> DataFrame:
    """Messages and bytes per second and share of failures per topic and window.

    ``messages``: topic, event_time, value, failed.
    """
    return (
        messages.groupBy("topic", bucket(F.col("event_time"), seconds).alias("w"))
        .agg(
            (F.count("*") / F.lit(float(seconds))).alias("messages_per_sec"),
            (F.sum(F.octet_length("value")) / F.lit(float(seconds))).alias("bytes_per_sec"),
            F.avg(F.col("failed").cast("double")).alias("error_rate"),
        )
        .select("topic", F.col("w.start").alias("window_start"), "messages_per_sec",
                "bytes_per_sec", "error_rate")
    )
