"""What running queries report about themselves: rows, outcomes and offsets per micro-batch.

A listener writes one small JSON file per micro-batch to the shared folder; ``plans.monitoring``
turns them into counts and lag. Progress comes from the query itself, so nothing has to be counted
a second time and a restarted query goes on with the same files.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewarden.sources import files

OUTCOMES = "outcomes"


def observed(decoded: DataFrame) -> DataFrame:
    """Counts good and bad messages while a query works on them (column ``bad``)."""
    bad: Column = F.col("bad").isNotNull()
    return decoded.observe(OUTCOMES, F.count_if(~bad).alias("success"), F.count_if(bad).alias("error"))


class ProgressLog(StreamingQueryListener):
    """Writes start, progress and end of every query of the session below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ended: set[str] = set()
        self.news = threading.Condition()

    def _write(self, kind: str, name: str, text: str) -> None:
        files.write_text(self.spark, f"{self.path}/{kind}/{name}.json", text)

    def onQueryStarted(self, event) -> None:
        self._write("started", str(event.runId), f'{{"id":"{event.id}","runId":"{event.runId}"}}')

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write("progress", f"{p.runId}-{p.batchId}", p.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write("ended", str(event.runId), f'{{"id":"{event.id}","runId":"{event.runId}"}}')
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def wait_for(self, run_id: str, seconds: float = 60) -> bool:
        """Until the end of a run has been reported; its progress is written by then."""
        with self.news:
            return self.news.wait_for(lambda: str(run_id) in self.ended, seconds)


SCHEMA = (
    "id string, runId string, batchId bigint, timestamp timestamp, numInputRows bigint, "
    "sources array<struct<description:string,endOffset:string,latestOffset:string,numInputRows:bigint>>, "
    f"observedMetrics struct<{OUTCOMES}:struct<success:bigint,error:bigint>>"
)


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and micro-batch; of a batch that was run again the newest report."""
    text = spark.read.schema("value string").option("wholetext", True).text(f"{path}/progress")
    rows = text.select(F.from_json("value", SCHEMA).alias("p")).select("p.*")
    return rows.groupBy("id", "batchId").agg(F.max_by(F.struct(*rows.columns), "timestamp").alias("p")).select("p.*")
