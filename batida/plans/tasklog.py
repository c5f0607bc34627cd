"""The states of tasks as an append-only table on shared storage.

Every step of a task adds a row; nothing is changed in place, so the log
outlives the driver that wrote it, and any session can read it while a task
runs. The latest state of a task is the row with the greatest step count.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batida.storage import file_system

STATES = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("current_step", T.IntegerType()),
        T.StructField("total_steps", T.IntegerType()),
        T.StructField("progress", T.IntegerType()),
        T.StructField("message", T.StringType()),
    ]
)


class TaskLog:
    """A log in a folder that all sessions share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, states: DataFrame) -> None:
        """Appends rows of STATES, in a folder of their own, so that any number of writers may append at once; each append is there as a whole or not at all."""
        states.select(*[F.col(f.name).cast(f.dataType) for f in STATES]).write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def step(self, task_id: str, seq: int, status: str, current_step: int, total_steps: int, progress: int, message: str) -> None:
        """Appends one state, as of now."""
        row = (task_id, seq, datetime.now(timezone.utc), status, current_step, total_steps, progress, message)
        self.add(self.spark.createDataFrame([row], STATES).coalesce(1))

    def states(self) -> DataFrame:
        """All states; none before the first is written."""
        fs, where = file_system(self.spark, self.path)
        if not fs.exists(where):
            return self.spark.createDataFrame([], STATES)
        return self.spark.read.schema(STATES).option("recursiveFileLookup", True).parquet(self.path)

    def latest(self, task: Column | None = None) -> DataFrame:
        """The last state of each task, or of those that `task` selects: a filter on task_id, which reaches the scan."""
        states = self.states() if task is None else self.states().where(task)
        return latest(states)

    def look_up(self, task_id: str) -> DataFrame:
        """The last state of one task; no row if it is not known."""
        return self.latest(F.col("task_id") == task_id)


def latest(states: DataFrame) -> DataFrame:
    """The state with the greatest (seq, at) of each task; partial maxima are taken before the shuffle."""
    row = F.struct(*[f.name for f in STATES])
    return states.groupBy("task_id").agg(F.max_by(row, F.struct("seq", "at")).alias("last")).select("last.*")
