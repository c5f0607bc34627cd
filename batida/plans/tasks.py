"""Extraction runs with a record of their state, as the service's clients see it."""

from __future__ import annotations

import uuid
from datetime import datetime
from threading import Lock

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from batida.model import PREFIX
from batida.operators.layouts import extract
from batida.plans.tasklog import TaskLog
from batida.sources.sinks import EmptyResult, display_name, name_single, write_csv

STEPS = 10
NO_TABLE = "Nenhuma tabela foi encontrada no PDF"
# What a task's record says of its steps.
MESSAGES = {
    "begin": "Iniciando processamento...",
    "pages": "Processando páginas...",
    "join": "Consolidando dados extraídos...",
    "done": "Processamento concluído com sucesso!",
    "empty": "Nenhum dado foi extraído.",
}


def new_record(now: datetime) -> dict:
    return {"progress": 0, "message": "", "status": "processing", "current_step": 0, "total_steps": STEPS, "timestamp": now.isoformat()}


def run(pages: DataFrame, layout: str, folder: str, task_id: str | None = None, prefix: str = PREFIX, log: TaskLog | None = None) -> dict:
    """Writes <folder>/<task_id>.csv and returns the task's record, with the numbers of pages, rows and filled slots.

    No rows at all end in status error with the progress at 100; any other
    failure in status error with the progress at 0. The pass that extracts
    counts too. The Spark jobs of the run are in the job group of the task's
    id, where a status tracker finds them. Each step's state is appended to
    the log, if there is one.
    """
    task_id = task_id or str(uuid.uuid4())
    context = pages.sparkSession.sparkContext
    record = new_record(datetime.now()) | {"task_id": task_id}
    context.setJobGroup(task_id, f"time cards, layout {layout}")
    states = iter(range(1 << 30))

    def say(step: int, message: str, status: str = "processing", **more) -> None:
        record.update(current_step=step, progress=step * 100 // STEPS, message=message, status=status)
        record.update(more)
        if log is not None:
            log.step(task_id, next(states), status, record["current_step"], STEPS, record["progress"], message)

    try:
        say(0, MESSAGES["begin"])
        seen = Observation()
        rows = extract(pages.observe(seen, F.count(F.lit(1)).alias("n_pages")), layout)
        part, target = f"{folder}/{task_id}.parts", f"{folder}/{task_id}.csv"
        say(3, MESSAGES["pages"])
        counts = write_csv(rows, part)
        record.update(counts, n_pages=seen.get["n_pages"])
        say(9, MESSAGES["join"])
        name_single(rows, part, target)
        say(STEPS, MESSAGES["done"], "completed", file_path=target, filename=display_name(datetime.now(), prefix))
    except EmptyResult:
        say(STEPS, MESSAGES["empty"], "error", error=NO_TABLE)
    except Exception as error:
        say(0, str(error), "error", error=str(error))
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(key, None)
    return record


class Tasks:
    """Runs in the background, each with a record that can be looked up while it runs."""

    def __init__(self):
        self._records: dict[str, dict] = {}
        self._threads: dict[str, InheritableThread] = {}
        self._context = None
        self._lock = Lock()

    def submit(self, pages: DataFrame, layout: str, folder: str, prefix: str = PREFIX) -> dict:
        """task_id, message and status of a run that has begun."""
        task_id = str(uuid.uuid4())
        self._context = pages.sparkSession.sparkContext
        self._records[task_id] = new_record(datetime.now()) | {"task_id": task_id}

        def work() -> None:
            done = run(pages, layout, folder, task_id, prefix)
            with self._lock:
                self._records[task_id] |= done

        self._threads[task_id] = InheritableThread(target=work, daemon=True)
        self._threads[task_id].start()
        return {"task_id": task_id, "message": "processing has begun", "status": "processing"}

    def poll(self, task_id: str) -> dict:
        """The record as it stands; KeyError for a task that is not known.

        While the run goes on, the steps between 3 and 8 follow the share of
        finished Spark tasks of its job group.
        """
        with self._lock:
            record = dict(self._records[task_id])
        if record["status"] == "processing":
            tracker = self._context.statusTracker()
            stages = [s for j in tracker.getJobIdsForGroup(task_id) if (job := tracker.getJobInfo(j)) for k in job.stageIds if (s := tracker.getStageInfo(k))]
            total, done = sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages)
            if total:
                step = 3 + done * 5 // total
                record |= {"current_step": step, "progress": step * 100 // STEPS}
        return record

    def wait(self, task_id: str, seconds: float | None = None) -> dict:
        self._threads[task_id].join(seconds)
        return self.poll(task_id)
