"""Progress of a stream in a task log, and batches that are written once however often they run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from batida.plans.tasklog import TaskLog


class ProgressLog(StreamingQueryListener):
    """Adds a state to the log for the start, each batch and the end of the queries of one name."""

    def __init__(self, log: TaskLog, name: str):
        self.log, self.name, self.runs = log, name, set()

    def _step(self, seq: int, status: str, batches: int, message: str) -> None:
        self.log.step(self.name, seq, status, batches, batches, 100 if status == "completed" else 0, message)

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.runs.add(str(event.runId))
            self._step(0, "processing", 0, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) in self.runs and p.numInputRows:
            self._step(p.batchId + 1, "processing", p.batchId + 1, f"batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.runs:
            error = event.exception
            self._step(1 << 40, "error" if error else "completed", 0, error.splitlines()[0] if error else "all batches are written")


def write_batches(stream: DataFrame, target: str, checkpoint: str, name: str | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts a query that writes each batch to target/batch=<id>, in place of what a run before left there.

    A batch that runs again after a failure or a restart takes the same rows
    under the same id, so no row is lost or repeated. The query ends when all
    files present are done.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def read_batches(spark: SparkSession, target: str) -> DataFrame:
    """All rows that write_batches wrote, with the number of their batch."""
    return spark.read.option("basePath", target).parquet(target)
