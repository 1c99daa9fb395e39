"""Incremental ingestion by Structured Streaming."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import writers


def read_new(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream; the checkpoint is the memory of what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_ids(stream: DataFrame, key: str, when: str | None = None, late: str = "7 days") -> DataFrame:
    """Each id once. With a time column state is dropped after ``late``; without, it grows with the
    number of ids."""
    return stream.withWatermark(when, late).dropDuplicatesWithinWatermark([key]) if when else stream.dropDuplicates([key])


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The batch form: rows whose id is not among those seen."""
    return rows.join(seen.select(key), key, "left_anti")


def with_quarantine(rows: DataFrame, problem: F.Column) -> DataFrame:
    """``error`` beside each row instead of dropping it; good rows have null."""
    return rows.withColumn("error", problem)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take in what is there and stop."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def poll(stream: DataFrame, path: str, checkpoint: str, every: str = "60 seconds"):
    """The running form."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def watch(spark: SparkSession, marker: str, state: str, work, every: float = 60.0, once: bool = False, force: bool = False, sleep=time.sleep) -> int:
    """Call ``work`` with a marker's content whenever its ``ready_at`` is not the one of the last run, which
    a file ``state`` keeps (only runs that end well count). ``once``: look once; ``force``: run at the
    first look whatever the state says. How often it ran."""
    runs = 0
    while True:
        found = writers.read_file(spark, marker)
        if found is not None:
            content = json.loads(found)
            try:
                last = json.loads(writers.read_file(spark, state) or "{}").get("ready_at")
            except ValueError:
                last = None
            if force or last != content.get("ready_at"):
                work(content)
                writers.replace_file(spark, state, json.dumps(content))
                runs, force = runs + 1, False
        if once:
            return runs
        sleep(every)


def with_retries(call, tries: int = 3, step: float = 3.0, sleep=time.sleep):
    """The result of ``call``; after a failure it is tried again ``step`` seconds later, then twice as long,
    and so on; the last failure is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            sleep(step * (k + 1))


class Breaker:
    """Stops a run that only fails: open after ``most`` misses in a row without a single success."""

    def __init__(self, most: int = 20) -> None:
        self.most, self.misses, self.good = most, 0, 0

    def note(self, ok: bool) -> bool:
        """Whether to go on."""
        self.good += ok
        self.misses = 0 if ok else self.misses + 1
        return self.good > 0 or self.misses < self.most


def due(last: str | None, now: str, schedule: str = "@weekly") -> bool:
    """Whether a scheduled run is due at ``now`` (ISO times, UTC): a run in each day or week from Sunday,
    counted by its beginning; ``None`` and ``@once`` run only by hand or for the first time."""
    import datetime

    if schedule in (None, "None", "@once"):
        return schedule == "@once" and last is None
    days = {"@daily": 1, "@weekly": 7}[schedule]
    at = lambda t: (datetime.datetime.fromisoformat(t.replace("Z", "+00:00")).date().toordinal()) // days
    return last is None or at(now) > at(last)
