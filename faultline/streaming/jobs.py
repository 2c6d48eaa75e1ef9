"""Analysis jobs as a stream of events: each job's state advances by event and fails when nothing comes in time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# States of a job and the percentage done at each
PROGRESS = {"PENDING": 5, "CLONING": 15, "PARSING": 40, "BUILDING_GRAPH": 65, "SCORING": 85, "COMPLETED": 100}
FINAL = ("COMPLETED", "FAILED")
EVENTS = "job_id string, at timestamp, status string"
STATES = "job_id string, status string, progress int, ms long, reason string"
#: Minutes without an event after which an open job fails, and by which an event may be late.
TIMEOUT, LATE = 30, 10


def _rank(status: str) -> int:
    """Final states beat open ones, and of two final ones the first stays."""
    return 1000 if status in FINAL else PROGRESS.get(status, 0)


class Jobs(StatefulProcessor):
    """The state of one job: status, progress, time of its last event. Events that bring it no further change nothing but that time."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, progress int, last long")

    def _timer(self, last) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last + self.timeout * 60_000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get() if self.state.exists() else None
        status, progress, last = known if known else (None, 0, None)
        before = status
        for r in sorted(rows, key=lambda r: (r["ms"], _rank(r["status"]))):
            if r["status"] not in PROGRESS and r["status"] != "FAILED":
                continue
            last = r["ms"] if last is None else max(last, r["ms"])
            if status is None or status not in FINAL and _rank(r["status"]) > _rank(status):
                status, progress = r["status"], PROGRESS.get(r["status"], progress)
        if status is None:
            return
        self.state.update((status, progress, last))
        if status in FINAL:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        else:
            self._timer(last)
        if status != before:
            yield Row(job_id=key[0], status=status, progress=progress, ms=last, reason="event")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, progress, last = self.state.get()
        if status not in FINAL:
            self.state.update(("FAILED", progress, last))
            yield Row(job_id=key[0], status="FAILED", progress=progress, ms=last, reason="timeout")

    def close(self) -> None:
        pass


def states(events: DataFrame, timeout: int = TIMEOUT, late: int = LATE) -> DataFrame:
    """job_id, status, progress, at, reason: a row each time a job of a stream of events (job_id, at, status) changes its state.

    States only advance, so late and repeated events change nothing; COMPLETED and FAILED are final. A job that is open when the watermark
    has passed its last event by `timeout` minutes fails where it stands. Events behind the watermark and of unknown states are
    dropped. Needs the RocksDB state store; a job's state is three values, so what is kept grows with jobs, not events.
    """
    timed = events.withWatermark("at", f"{late} minutes").withColumn("ms", F.unix_millis("at"))
    out = timed.groupBy("job_id").transformWithState(statefulProcessor=Jobs(timeout), outputStructType=STATES, outputMode="Update", timeMode="EventTime")
    return out.select("job_id", "status", "progress", F.timestamp_millis("ms").alias("at"), "reason")


def final_states(events: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """job_id, status, progress, reason: where jobs stand when all events (job_id, at, status) are in and no more will come."""
    known = F.col("status").isin(*PROGRESS, "FAILED")
    percent = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PROGRESS.items() for x in p]), F.col("status")), F.lit(0))
    final = F.col("status").isin(*FINAL)
    e = events.where(known).withColumns({"percent": percent, "final": final})
    job = Window.partitionBy("job_id")
    # an event too long after the one before finds the job failed
    e = e.withColumn("gap", F.col("at") > F.lag("at").over(job.orderBy("at", "percent")) + F.expr(f"INTERVAL {timeout} MINUTES"))
    e = e.withColumn("broken", F.max(F.col("gap").cast("int")).over(job.orderBy("at", "percent").rowsBetween(Window.unboundedPreceding, 0)))
    e = e.where("coalesce(broken, 0) = 0").withColumn("done", F.min(F.when(F.col("final"), F.col("at"))).over(job)).where("done IS NULL OR at <= done")
    d = e.groupBy("job_id").agg(F.min_by("status", F.when(F.col("final"), F.struct("at", F.col("status") != "COMPLETED"))).alias("end"), F.max(F.when(F.col("status") != "FAILED", F.col("percent"))).alias("most"))
    progress = F.when(F.col("end") == "COMPLETED", 100).otherwise(F.coalesce("most", F.lit(0)))
    return d.select("job_id", F.coalesce("end", F.lit("FAILED")).alias("status"), progress.cast("int").alias("progress"), F.when(F.col("end").isNull(), "timeout").otherwise("event").alias("reason"))
