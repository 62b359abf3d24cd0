"""Model artifacts as Parquet tables by version, and the pointer to the active one.

Models are small (a few thousand tree nodes or weights), so they are written and
read as plain tables. The pointer is an append-only log: moving it, or rolling it
back, adds one row, and readers take the newest.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.sources import files

POINTER = "version string, action string, reason string, event_time timestamp"


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def save(self, kind: str, version: str, rows: DataFrame) -> None:
        """Store one part of a model, e.g. its trees or its scaler."""
        rows.drop("version").write.mode("overwrite").parquet(f"{self.path}/{kind}/version={version}")

    def load(self, kind: str, version: str) -> DataFrame:
        folder = f"{self.path}/{kind}/version={version}"
        if not files.exists(self.spark, folder):
            raise LookupError(f"no {kind} of version {version!r}")
        return self.spark.read.parquet(folder).withColumn("version", F.lit(version))

    def versions(self, kind: str) -> list[str]:
        names = files.children(self.spark, f"{self.path}/{kind}")
        return sorted(n.removeprefix("version=") for n in names if n.startswith("version="))

    def resolve(self, kind: str, version: str = "latest") -> str:
        """``latest`` is the greatest version text; ``default`` if there is none."""
        if version != "latest":
            return version
        return max(self.versions(kind), default="default")

    # --- active version -------------------------------------------------------

    def _pointer(self) -> DataFrame:
        folder = f"{self.path}/_active"
        if not files.exists(self.spark, folder):
            return self.spark.createDataFrame([], POINTER)
        return self.spark.read.schema(POINTER).parquet(folder)

    def activate(
        self, version: str, at: dt.datetime, action: str = "reload", reason: str = ""
    ) -> None:
        row = self.spark.createDataFrame([(version, action, reason, at)], POINTER)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/_active")

    def active(self, default: str = "dummy-v0") -> str:
        """Read once per micro-batch, so a swap takes effect between batches."""
        row = self._pointer().agg(F.max_by("version", "event_time")).first()
        return row[0] or default

    def history(self) -> DataFrame:
        return self._pointer().orderBy("event_time")

    def rollback(self, version: str, at: dt.datetime, reason: str, kind: str) -> None:
        """Point back at an older version, which must still exist."""
        if version not in self.versions(kind):
            raise LookupError(f"no {kind} of version {version!r}")
        self.activate(version, at, "rollback", reason)

    # --- run log ----------------------------------------------------------------

    RUNS = (
        "version string, model_type string, parameters map<string,string>, "
        "metrics map<string,double>, started_at timestamp"
    )

    def log_run(
        self, version: str, model_type: str, parameters: dict, metrics: dict, at: dt.datetime
    ) -> None:
        row = (
            version,
            model_type,
            {k: str(v) for k, v in parameters.items()},
            {k: float(v) for k, v in metrics.items()},
            at,
        )
        self.spark.createDataFrame([row], self.RUNS).coalesce(1).write.mode("append").parquet(
            f"{self.path}/_runs"
        )

    def runs(self) -> DataFrame:
        folder = f"{self.path}/_runs"
        if not files.exists(self.spark, folder):
            return self.spark.createDataFrame([], self.RUNS)
        return self.spark.read.schema(self.RUNS).parquet(folder)


def version_stamp(at: dt.datetime) -> str:
    return at.strftime("%Y%m%d_%H%M%S")


def latest_version(versions: DataFrame, column: str = "version") -> DataFrame:
    """Greatest version text of a table, ``default`` if it is empty."""
    return versions.agg(F.coalesce(F.max(column), F.lit("default")).alias("version"))


def should_promote(new_metric: float, old_metric: float | None) -> bool:
    """Deploy unless the new model is worse."""
    return old_metric is None or new_metric >= old_metric


def promotion_decisions(runs: DataFrame, metric: str) -> DataFrame:
    """Each run against the best run promoted before it.

    A run is promoted when it is not worse than the version active at its time,
    i.e. than the running maximum, because the active metric never falls.
    """
    from pyspark.sql import Window

    before = (
        Window.partitionBy("model_type")
        .orderBy("started_at", "version")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    value = F.col("metrics")[metric]
    return runs.select(
        "model_type", "version", value.alias("new_metric"), F.max(value).over(before).alias("old_metric")
    ).withColumn(
        "deploy", F.col("old_metric").isNull() | (F.col("new_metric") >= F.col("old_metric"))
    )
