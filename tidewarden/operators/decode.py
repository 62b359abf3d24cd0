"""Decoding, normalising and validating raw events; bad rows become dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.avro import from_framed
from tidewarden.schema import LABELS, SEVERITIES

# Both envelopes at once. Numbers are read as text so that one odd value does
# not spoil the record; they are typed later, column by column.
ENVELOPE = (
    "event_id string, source_id string, event_type string, event_time string, timestamp string, "
    "features map<string,string>, feature_vector array<string>, metadata map<string,string>, "
    "_corrupt string"
)

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def decode(messages: DataFrame, value: str = "value", avro_schema: str | None = None) -> DataFrame:
    """Parse messages; adds ``event`` (struct), ``payload`` and ``bad`` (why it failed).

    A message without a value is a tombstone and is skipped. With ``avro_schema``
    messages that start with the 0x00 magic byte are read as Avro; all others, and those that
    are no record of the schema, as JSON.
    """
    df = messages.filter(F.col(value).isNotNull())
    payload = F.col(value).cast("string")
    if avro_schema is not None:
        framed = F.hex(F.substring(F.col(value), 1, 1)) == "00"
        payload = F.coalesce(F.when(framed, from_framed(F.col(value), avro_schema)), payload)
        # The same for the Avro reader, which the parse and the payload would both call.
        df = df.select("*", F.explode(F.array(payload)).alias("_payload"))
        payload = F.col("_payload")
    parsed = F.from_json(
        payload, ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    # Through a generator the parse runs once per row; as a plain column it would be
    # repeated by every filter on it that is pushed below the projection.
    df = df.select("*", payload.alias("payload"), F.explode(F.array(parsed)).alias("event")).drop("_payload")
    looks_like_object = F.ltrim(F.col("payload")).startswith("{")
    broken = F.col("event").isNull() | F.col("event._corrupt").isNotNull()
    return df.withColumn(
        "bad",
        F.when(
            broken & ~looks_like_object & F.try_parse_json("payload").isNotNull(),
            F.lit("Expected JSON object"),
        ).when(broken, F.lit("Cannot deserialise message as Avro or JSON")),
    )


def dead_letters(decoded: DataFrame, task_id: int = 0) -> DataFrame:
    """Messages that could not be read, with the payload as it came."""
    return decoded.filter(F.col("bad").isNotNull()).select(
        F.lit(task_id).alias("task_id"),
        F.lit("ValueError").alias("error_type"),
        F.col("bad").alias("error_message"),
        F.col("payload").alias("raw_payload"),
        F.unix_millis(F.current_timestamp()).alias("failed_at_ms"),
    )


def to_number(text: Column) -> Column:
    """Text as a double, null where it is no number.

    Quotes around NaN tokens are dropped, JSON booleans count as 1 and 0, and
    the digit separator ``_`` is accepted between digits. Text made of digits,
    signs, point and exponent alone needs none of that and is cast directly.
    """
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, '^"|"$', "")), r"(?<=\d)_(?=\d)", "")
    unusual = (
        F.when(bare == "true", F.lit(1.0))
        .when(bare == "false", F.lit(0.0))
        .when(bare.rlike(NUMBER), bare.try_cast("double"))
    )
    return F.when(F.translate(text, "0123456789+-.eE", "") == "", text.try_cast("double")).otherwise(
        unusual
    )


def epoch_ms_to_time(ms: Column, now: Column | None = None) -> Column:
    """Epoch milliseconds as an instant; the current time where there is none."""
    return F.coalesce(_from_ms(ms.cast("double")), F.current_timestamp() if now is None else now)


def _from_ms(ms: Column) -> Column:
    """Milliseconds as an instant; null, not an error, for numbers out of range."""
    return F.timestamp_micros((ms * F.lit(1_000)).try_cast("bigint"))


def event_instant(event_time: Column, timestamp: Column, arrival: Column | None = None) -> Column:
    """Epoch milliseconds or ISO-8601 text, whichever the envelope carries, else the arrival.

    Without a known arrival that is the current time, which a retry does not repeat.
    """
    numeric = F.when(event_time.rlike(NUMBER), event_time.try_cast("double"))
    iso = F.coalesce(F.try_to_timestamp(timestamp), F.try_to_timestamp(event_time))
    return F.coalesce(_from_ms(numeric), iso, F.current_timestamp() if arrival is None else arrival)


def names_for(vector: Column) -> Column:
    """Positional names f0 .. fn."""
    return F.transform(
        F.when(F.size(vector) > 0, F.sequence(F.lit(0), F.size(vector) - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.concat(F.lit("f"), i.cast("string")),
    )


def vector_to_map(vector: Column) -> Column:
    return F.map_from_arrays(names_for(vector), vector)


def map_to_vector(features: Column, declared: list[str] | None = None) -> Column:
    """Values in declared order; without a declared list in the order of the names."""
    if declared:
        return F.array(*[F.try_element_at(features, F.lit(n)) for n in declared])
    keys = F.array_sort(F.map_keys(features))
    return F.transform(keys, lambda k: F.try_element_at(features, k))


def normalise(decoded: DataFrame, declared: list[str] | None = None, refused: bool = False) -> DataFrame:
    """Good messages of either envelope as one raw-event record.

    An ``arrival`` column of the messages dates events that carry no time. With ``refused`` bad
    messages stay in, as rows of nulls with the reason in ``bad``.
    """
    e = F.col("event")
    arrival = F.col("arrival") if "arrival" in decoded.columns else None
    # Typed once in a projection of their own, then used several times.
    kept = decoded if refused else decoded.filter(F.col("bad").isNull())
    typed = kept.select(
        "event",
        *(["bad"] if refused else []),
        *([arrival] if arrival is not None else []),
        F.transform_values("event.features", lambda _, v: to_number(v)).alias("numbers"),
        F.transform("event.feature_vector", to_number).alias("vector"),
    )
    numbers, vector = F.col("numbers"), F.col("vector")
    records = typed.select(
        e.event_id.alias("event_id"),
        F.coalesce(e.source_id, F.lit("")).alias("source_id"),
        F.coalesce(e.event_type, F.lit("")).alias("event_type"),
        event_instant(e.event_time, e.timestamp, arrival).alias("event_time"),
        F.coalesce(
            numbers, vector_to_map(vector), F.create_map().cast("map<string,double>")
        ).alias("features"),
        F.coalesce(vector, map_to_vector(numbers, declared)).alias("feature_vector"),
        F.coalesce(e.metadata, F.create_map().cast("map<string,string>")).alias("metadata"),
        *(["bad"] if refused else []),
    )
    if not refused:
        return records
    good = F.col("bad").isNull()
    return records.select(*[c if c == "bad" else F.when(good, F.col(c)).alias(c) for c in records.columns])


def read_vector(feature_vector: Column, declared: list[str] | None = None) -> Column:
    """Stored feature JSON as numbers: a list as it is, an object as its values."""
    is_list = F.ltrim(feature_vector).startswith("[")
    as_list = F.transform(F.from_json(feature_vector, "array<string>"), to_number)
    as_map = F.transform_values(F.from_json(feature_vector, "map<string,string>"),
                                lambda _, v: to_number(v))
    return F.when(is_list, as_list).otherwise(map_to_vector(as_map, declared))


def fill_defaults(events: DataFrame) -> DataFrame:
    """Defaults the table writer uses for absent fields."""
    defaults = {
        "source_id": F.lit("unknown"),
        "anomaly_score": F.lit(0.0),
        "is_anomaly": F.lit(False),
        "model_version": F.lit("unknown"),
    }
    return events.select(
        *[
            F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c)
            for c in events.columns
        ]
    )


def find_label_column(columns: list[str]) -> str | None:
    """The first column whose name contains ``label``."""
    return next((c for c in columns if "label" in c.lower()), None)


def binarise_label(label: Column) -> Column:
    """0 for BENIGN in any case and spacing, 1 for anything else."""
    text = F.upper(F.trim(F.coalesce(label.cast("string"), F.lit("nan"))))
    return F.when(text != "BENIGN", 1).otherwise(0)


# --- validation --------------------------------------------------------------


def ingest_problem(source_id: Column, vector: Column) -> Column:
    """Why an incoming event is refused, null when it is accepted."""
    return (
        F.when(
            source_id.isNull() | ~F.length(source_id).between(1, 128),
            F.lit("source_id must have 1 to 128 characters"),
        )
        .when(
            vector.isNull() | ~F.size(vector).between(1, 1024),
            F.lit("feature_vector must have 1 to 1024 values"),
        )
        .when(
            F.exists(
                vector,
                lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
            ),
            F.lit("feature_vector must not contain NaN or Inf values"),
        )
    )


def split_ingest(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``problem``)."""
    checked = events.withColumn(
        "problem", ingest_problem(F.col("source_id"), F.col("feature_vector"))
    )
    return (
        checked.filter(F.col("problem").isNull()).drop("problem"),
        checked.filter(F.col("problem").isNotNull()),
    )


def batch_problem(batch_size: Column) -> Column:
    """A submitted batch holds 1 to 1000 events."""
    return F.when(~batch_size.between(1, 1000), F.lit("a batch must hold 1 to 1000 events"))


def score_in_range(score: Column) -> Column:
    return F.coalesce(score.between(0.0, 1.0) & ~F.isnan(score), F.lit(False))


def severity_allowed(severity: Column) -> Column:
    return F.coalesce(severity.isin(SEVERITIES), F.lit(False))


def label_allowed(label: Column) -> Column:
    return F.coalesce(label.isin(LABELS), F.lit(False))


def split_scored(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by score range and severity domain."""
    ok = score_in_range(F.col("anomaly_score"))
    if "severity" in scored.columns:
        ok = ok & severity_allowed(F.col("severity"))
    return scored.filter(ok), scored.filter(~ok)
