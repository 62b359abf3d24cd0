"""Outputs that a retried micro-batch can write again without harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.operators.decode import split_ingest
from tidewarden.sources import files

KEYS = ["event_id", "event_time"]
SPANS = 32


def insert_new(batch: DataFrame, path: str, keys: list[str] = KEYS, day: str = "event_date") -> None:
    """Append the rows whose key the table does not hold yet; conflicts are no-ops.

    Of the table only the key columns are read, and of those what lies near the batch: its span of
    time (or of days, without ``event_time``) is cut into ``SPANS`` equal parts, and each part that
    holds rows gives one range. The plan has the same size for any batch: a late row costs its own
    time, scattered rows cost the days between them as well. A batch that is run again after a
    crash finds the rows that did get in and leaves them out, whether all or some had been committed.
    The batch is read four times, keys and times only but for the last: callers hold on to one that
    is costly to make.
    """
    spark, new_rows = batch.sparkSession, batch
    if files.exists(spark, path):
        near = _near(batch, day)
        if near is None:
            return
        held = spark.read.schema(batch.schema).parquet(path).filter(near).select(*keys)
        # The batch is small against its days: first keep the held keys it has
        # (the batch side can be broadcast), then leave those rows out.
        clashes = held.join(batch.select(*keys), keys, "left_semi")
        new_rows = batch.join(clashes, keys, "left_anti")
    # A day may hold most of the batch: rebalancing splits it over tasks. In time
    # order within a file, row group statistics narrow later scans and inserts.
    order = [day] + [c for c in ("event_time",) if c in new_rows.columns]
    (
        new_rows.dropDuplicates(keys)
        .hint("rebalance", F.col(day))
        .sortWithinPartitions(*order)
        .write.partitionBy(day)
        .mode("append")
        .parquet(path)
    )


def _near(new: DataFrame, day: str) -> Column | None:
    """Days and times that the batch touches, as ``SPANS`` ranges at most; None for no rows."""
    timed = "event_time" in new.columns
    at = F.unix_micros("event_time") if timed else F.unix_date(day).cast("long")
    low, high = new.agg(F.min(at), F.max(at)).first()
    if low is None:
        return None if new.isEmpty() else F.lit(True)
    width = (high - low) // SPANS + 1
    part = F.floor((at - low) / F.lit(width)).alias("part")
    ends = new.groupBy(part).agg(F.min(at).alias("low"), F.max(at).alias("high"), F.min(day).alias("a"), F.max(day).alias("b"))
    out = F.lit(False)
    for r in ends.filter("low is not null").collect():
        here = F.col(day).between(F.lit(r.a), F.lit(r.b))
        if timed:
            moment = lambda us: F.timestamp_micros(F.lit(us))
            here = here & F.col("event_time").between(moment(r.low), moment(r.high))
        out = out | here
    return out


def append_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder; a retry replaces it."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def as_messages(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows as keyed JSON messages for a topic; instants as epoch milliseconds."""
    columns = [
        F.unix_millis(c).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes
    ]
    return df.select(
        F.coalesce(F.col(key), F.lit("")).alias("key"), F.to_json(F.struct(*columns)).alias("value")
    )


def publish(messages: DataFrame, target: str | dict[str, str], batch_id: int) -> None:
    """Send keyed messages to a topic, or to a folder where no broker is set."""
    if isinstance(target, dict):
        messages.write.format("kafka").options(**target).save()
    else:
        append_batch(messages, target, batch_id)


def write_alerts(alerts: DataFrame, table: str, topic: str | dict[str, str], batch_id: int) -> None:
    """Alerts to the table (once per alert id) and to the topic."""
    rows = alerts.withColumn("status", F.lit("ACTIVE")).withColumn(
        "created_date", F.col("created_at").cast("date")
    )
    insert_new(
        rows.withColumn("event_time", F.col("created_at")), table, ["alert_id"], "created_date"
    )
    publish(as_messages(alerts, "alert_id"), topic, batch_id)


def publish_events(events: DataFrame, path: str) -> DataFrame:
    """Append submitted events that pass validation; returns the refused ones."""
    accepted, refused = split_ingest(events)
    accepted.write.mode("append").parquet(path)
    return refused
