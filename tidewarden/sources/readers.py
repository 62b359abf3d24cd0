"""Batch and streaming inputs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions.identity import uuid5
from tidewarden.functions.timebuckets import latest_time, time_range
from tidewarden.operators.decode import binarise_label, find_label_column
from tidewarden.schema import REPLAY_SOURCE, REPLAY_TYPE, SCORED_EVENT
from tidewarden.sources import files


def raw_stream(
    spark: SparkSession,
    path: str | None = None,
    kafka: dict[str, str] | None = None,
    max_per_trigger: int = 1000,
) -> DataFrame:
    """Raw messages as a stream of ``value`` and ``arrival`` (broker or file time).

    ``kafka`` (servers and topic) needs the connector on the class path; without
    it a folder of text files stands in. Both start at the earliest message, and
    offsets are committed with the checkpoint, after the sink has written.
    """
    if kafka is not None:
        return (
            spark.readStream.format("kafka")
            .option("startingOffsets", "earliest")
            .option("maxOffsetsPerTrigger", str(max_per_trigger))
            .options(**kafka)
            .load()
            .select("value", F.col("timestamp").alias("arrival"))
        )
    return (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", str(max_per_trigger))
        .load(path)
        .select("value", F.col("_metadata.file_modification_time").alias("arrival"))
    )


def scored_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(SCORED_EVENT).option("maxFilesPerTrigger", str(max_files)).parquet(path)
    )


def scored_table(
    spark: SparkSession, path: str, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> DataFrame:
    """Scored events of a time range; only the days in range are listed and read."""
    return time_range(spark.read.schema(SCORED_EVENT).parquet(path), start, end)


def newest_time(spark: SparkSession, path: str) -> dt.datetime | None:
    """Newest event time of a table, read from its last day alone."""
    prefix = "event_date="
    found = [n for n in files.children(spark, path) if n.startswith(prefix)]
    if not found:
        return None
    day = dt.date.fromisoformat(max(found).removeprefix(prefix))
    return latest_time(scored_table(spark, path).filter(F.col("event_date") == F.lit(day)))


def training_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole training file(s) with a declared schema, plus a 0/1 ``label``.

    The label column is the first whose name contains "label", in any case and
    with stray spaces; everything but BENIGN is 1.
    """
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=True)
    name = find_label_column(df.columns)
    if name is None:
        raise LookupError("no label column")
    return df.withColumn("label", binarise_label(F.col(f"`{name}`")))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def replay_envelope(
    rows: DataFrame, event_id: Column, event_time: Column, source_id: str = REPLAY_SOURCE,
    event_type: str = REPLAY_TYPE,
) -> DataFrame:
    """Rows as raw events: every numeric column becomes a feature.

    The pace is set by the stream that feeds it (files or offsets per trigger),
    not here.
    """
    pairs = [
        x for c in numeric_columns(rows) for x in (F.lit(c), F.col(f"`{c}`").cast("double"))
    ]
    return rows.select(
        uuid5(event_id.cast("string")).alias("event_id"),
        F.lit(source_id).alias("source_id"),
        F.lit(event_type).alias("event_type"),
        F.create_map(*pairs).alias("features"),
        F.unix_millis(event_time).alias("event_time"),
    )


def replay_stream(
    spark: SparkSession, path: str, schema: str, event_id: Column, files_per_trigger: int = 1, **kw
) -> DataFrame:
    """A folder of CSV files replayed as raw events at a set pace."""
    rows = (
        spark.readStream.schema(schema)
        .option("header", "true")
        .option("maxFilesPerTrigger", str(files_per_trigger))
        .csv(path)
    )
    return replay_envelope(rows, event_id, F.current_timestamp(), **kw)


def newest_version(control: DataFrame) -> DataFrame:
    """The version the newest usable control message asks for.

    Reload and rollback messages name it ``version``, ``model_version`` or
    ``target_version``; messages without any are ignored.
    """
    named = control.withColumn(
        "wanted",
        F.coalesce(
            *[F.nullif(F.col(c), F.lit("")) for c in ("version", "model_version", "target_version")]
        ),
    ).filter(F.col("wanted").isNotNull())
    return named.agg(
        F.max_by("wanted", F.struct("event_time", "wanted")).alias("version"),
        F.max("event_time").alias("since"),
    )


CONTROL_ENVELOPE = "version string, model_version string, target_version string"


def control_messages(messages: DataFrame, value: str = "value", at: str = "event_time") -> DataFrame:
    """Control messages decoded from JSON; unreadable ones are dropped."""
    return messages.select(
        F.from_json(F.col(value).cast("string"), CONTROL_ENVELOPE).alias("m"), F.col(at).alias("event_time")
    ).select("m.*", "event_time")
