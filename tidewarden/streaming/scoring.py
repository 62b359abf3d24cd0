"""Raw messages -> scored table, scored topic and dead letters, as one query."""

from __future__ import annotations

import datetime as dt
import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewarden.operators import decode, features, forest
from tidewarden.schema import ANOMALY_THRESHOLD
from tidewarden.sources import readers, sinks
from tidewarden.sources.registry import Registry
from tidewarden.streaming import progress

log = logging.getLogger(__name__)


@dataclass
class Scorer:
    """Scores micro-batches with the version the registry names as active.

    The pointer is read once per batch, so a new or rolled-back version takes
    over between two batches. Loaded models are kept by version.
    """

    registry: Registry
    threshold: float = ANOMALY_THRESHOLD
    loaded: dict = field(default_factory=dict)
    attempts: int = 3
    pause_s: float = 0.5
    refused: str | None = None

    def _load(self, version: str):
        if version == "dummy-v0":
            return None, features.fallback_scaler()
        return (
            forest.Forest.from_df(self.registry.load("forest", version), version),
            features.Scaler.from_df(self.registry.load("scaler", version), version),
        )

    def model(self, version: str):
        """The model of ``version``; while that cannot be loaded, the one in use goes on scoring.

        Only a model that is there replaces the old one. A version that failed ``attempts`` times
        in a row is not tried again until the pointer names another one.
        """
        if version in self.loaded:
            return self.loaded[version]
        if version == self.refused and self.loaded:
            return next(iter(self.loaded.values()))
        for attempt in range(self.attempts):
            try:
                found = self._load(version)
                break
            except Exception as error:  # storage and content alike: the stream must go on
                log.warning("model %s, attempt %d: %s", version, attempt + 1, str(error)[:300])
                time.sleep(self.pause_s * attempt)
        else:
            if not self.loaded:
                raise LookupError(f"no model of version {version!r} and none in use")
            self.refused = version
            return next(iter(self.loaded.values()))
        for old, _ in self.loaded.values():
            if old is not None:
                old.release()
        self.loaded, self.refused = {version: found}, None
        return found

    def score(self, events: DataFrame) -> DataFrame:
        model, scaler = self.model(self.registry.active())
        # By name: an absent feature must not shift the others. List messages carry f0, f1, ...
        vector = features.scaled_vector(F.col("features"), scaler)
        return forest.score_events(
            events.withColumn("_z", vector), "_z", model, self.threshold
        )


@dataclass(frozen=True)
class Targets:
    """Where a scoring query writes."""

    table: str
    topic: str | dict[str, str]
    dead_letters: str
    checkpoint: str


def score_batch(
    messages: DataFrame, batch_id: int, scorer: Scorer, to: Targets, declared: list[str] | None = None
) -> None:
    """One micro-batch. Every write can be repeated, so a retry is harmless.

    The table is written before the topic: whoever sees an event on the topic
    finds it, and all events before it, in the table.
    """
    decoded = messages if "bad" in messages.columns else decode.decode(messages)
    # Held with what is used below: the text of a message only where it could not be read.
    kept = ["event", "bad", *(c for c in ("arrival",) if c in decoded.columns)]
    unread = F.when(F.col("bad").isNotNull(), F.col("payload")).alias("payload")
    decoded = decoded.select(*kept, unread).persist()
    try:
        good = decode.normalise(decoded, declared)
        # The id is normalised first: the table and the topic must carry the same one.
        keyed = good.withColumn("event_id", _event_id())
        scored = scorer.score(keyed).persist()
        try:
            valid, invalid = decode.split_scored(scored)
            sinks.insert_new(valid, to.table)
            sinks.publish(_topic_rows(valid, to.topic), to.topic, batch_id)
            refused = invalid.select(
                F.lit(0).alias("task_id"),
                F.lit("ValueError").alias("error_type"),
                F.lit("score or severity out of range").alias("error_message"),
                F.to_json(F.struct("event_id", "source_id", "anomaly_score")).alias("raw_payload"),
                F.unix_millis(F.current_timestamp()).alias("failed_at_ms"),
            )
            sinks.append_batch(
                decode.dead_letters(decoded).unionByName(refused), to.dead_letters, batch_id
            )
        finally:
            scored.unpersist()
    finally:
        decoded.unpersist()


def _event_id():
    """Canonical id; an event without one gets an id from its content, not a random one."""
    from tidewarden.functions.identity import safe_uuid, uuid5

    content = uuid5(
        F.concat_ws("|", "source_id", F.unix_micros("event_time").cast("string"),
                    F.to_json("feature_vector"))
    )
    return safe_uuid(F.col("event_id"), content)


def _topic_rows(scored: DataFrame, topic: str | dict[str, str]) -> DataFrame:
    return sinks.as_messages(scored.drop("event_date")) if isinstance(topic, dict) else scored


def start_scoring(
    messages: DataFrame,
    registry: Registry,
    to: Targets,
    declared: list[str] | None = None,
    threshold: float = ANOMALY_THRESHOLD,
    interval: str | None = None,
) -> StreamingQuery:
    """Start the query; without ``interval`` it works off what is there and stops."""
    scorer = Scorer(registry, threshold)
    counted = progress.observed(decode.decode(messages))
    writer = (
        counted.writeStream.queryName("scoring")
        .option("checkpointLocation", to.checkpoint)
        .foreachBatch(lambda df, batch_id: score_batch(df, batch_id, scorer, to, declared))
    )
    return (
        writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    ).start()


def control_batch(messages: DataFrame, batch_id: int, registry: Registry) -> None:
    """Move the active-version pointer to what the newest control message asks for.

    A version without stored artifacts is not taken over; the previous one stays.
    """
    row = readers.newest_version(readers.control_messages(messages)).first()
    if row.version is None or row.version == registry.active():
        return
    if row.version in registry.versions("forest"):
        registry.activate(row.version, dt.datetime.now(dt.UTC), "control")


def start_control(
    messages: DataFrame, registry: Registry, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Follow the model control stream (value, event_time)."""
    writer = (
        messages.writeStream.queryName("control")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: control_batch(df, batch_id, registry))
    )
    return (
        writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    ).start()


def start_feed(
    scored: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """A projection of the scored stream (live feed, annotations) to a folder."""
    writer = scored.writeStream.format("json").option("checkpointLocation", checkpoint).option(
        "path", path
    )
    return (
        writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    ).start()


def state_store(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, on disk and in the checkpoint, not on the heap."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
