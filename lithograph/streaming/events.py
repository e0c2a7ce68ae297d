"""Streaming forms of the audit log: append, upsert to the latest, windowed counts.

Each takes a stream and a sink folder, processes what is there (availableNow) and returns
the result as a table, so that a batch query can be held against it.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from lithograph.functions.storage import ensure_checkpoint_dir
from lithograph.sources.keyed import KeyedTable


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/streams/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; new files below the folder would be read as they come."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def _run(writer, folder: str) -> None:
    query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def append_log(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """Append-only copy of one kind of event."""
    folder = work_folder(spark, "append")
    rows = event_stream(spark, sf_dir).where(F.col("event_type") == event_type)
    _run(rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out"), folder)
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def merged(rows: DataFrame, keys: list[str], order: list[str], folder: str, mode: str = "append", buckets: int = 16) -> DataFrame:
    """The latest row of each key of a stream, as a table of which each batch rewrites the buckets it touches; a repeated batch changes nothing."""
    table = KeyedTable(rows.sparkSession, f"{folder}/table", rows.schema, tuple(keys), buckets)

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order, number)
        table.vacuum()

    _run(rows.writeStream.outputMode(mode).foreachBatch(merge), folder)
    return table.read()


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each (user, type), merged batch by batch."""
    rows = event_stream(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", "value")
    return merged(rows, ["user_id", "event_type"], ["ts", "event_id"], work_folder(spark, "upsert"))


def tumbling_counts(spark: SparkSession, sf_dir: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, each window written once, when the watermark has passed it; its state goes then."""
    folder = work_folder(spark, "windows")
    rows = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    _run(counts.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out"), folder)
    return spark.read.schema(counts.schema).parquet(f"{folder}/out")


#: What an event asks of a job.
JOB_STATES = {"signup": "pending", "view": "running", "click": "running", "purchase": "completed", "error": "failed"}
#: State -> states that may come next; a job that has ended takes no further step until it begins anew.
TRANSITIONS = {"none": ("pending",), "pending": ("running", "failed"), "running": ("running", "completed", "failed"), "completed": ("pending",), "failed": ("pending",)}
OPEN_STATES = ("pending", "running")
JOB_SCHEMA = "user_id long, status string, steps long, refused long, late long, stuck long, ts timestamp, version long"


class JobMachine(StatefulProcessor):
    """One job for each key: its state, and a timer that fails it when event time has passed its last step by ``patience``.

    Steps come in the order of (time, id) within a batch.  One that the table of transitions
    does not allow is refused and counted, and so is one that is older than the last step that
    was taken or refused (late); those behind the watermark never come here.  A timer that was
    set before a later step does nothing.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, steps long, refused long, late long, stuck long, last long, event long, version long")

    def _held(self) -> list:
        return list(self.job.get()) if self.job.exists() else ["none", 0, 0, 0, 0, -1, -1, 0]

    def _told(self, key, job) -> pd.DataFrame:
        status, steps, refused, late, stuck, last, _, version = job
        return pd.DataFrame({"user_id": [key[0]], "status": [status], "steps": [steps], "refused": [refused], "late": [late], "stuck": [stuck], "ts": [pd.Timestamp(last * 1000)], "version": [version]})

    def handleInputRows(self, key, rows, timerValues):
        job = self._held()
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for ts, event_id, kind in zip(events["ts"], events["event_id"], events["event_type"]):
            asked, at = JOB_STATES[kind], ts.value // 1000
            if (at, int(event_id)) <= (job[5], job[6]):
                job[3] += 1
                continue
            job[5], job[6] = at, int(event_id)
            if asked in TRANSITIONS[job[0]]:
                job[0], job[1] = asked, job[1] + 1
            else:
                job[2] += 1
        job[7] += 1
        self.job.update(tuple(job))
        # Long before the watermark nothing can be due yet; a step moves the timer on.
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if job[0] in OPEN_STATES:
            self.handle.registerTimer(job[5] // 1000 + self.patience_ms)
        yield self._told(key, job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        job = self._held()
        if job[0] in OPEN_STATES and expiredTimerInfo.getExpiryTimeInMs() >= job[5] // 1000 + self.patience_ms:
            job[0], job[4], job[7] = "failed", job[4] + 1, job[7] + 1
            self.job.update(tuple(job))
            yield self._told(key, job)

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def jobs(events: DataFrame, folder: str, patience: str = "2 hours", lateness: str = "10 minutes") -> DataFrame:
    """(user_id, status, steps, refused, late, stuck) from a stream (user_id, event_type, ts, event_id): a job for each user."""
    spark = events.sparkSession
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)  # keyed state with timers needs this store
    try:
        rows = events.withWatermark("ts", lateness).groupBy("user_id")
        told = rows.transformWithStateInPandas(JobMachine(int(pd.Timedelta(patience).total_seconds() * 1000)), JOB_SCHEMA, "update", "eventTime")
        return merged(told, ["user_id"], ["version"], folder, "update").drop("ts", "version")
    finally:
        spark.conf.unset(STATE_STORE[0]) if before is None else spark.conf.set(STATE_STORE[0], before)


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the steps of one job."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    return jobs(rows, work_folder(spark, "jobs"))


def conversation_windows(spark: SparkSession, sf_dir: str, turns: int = 6) -> DataFrame:
    """(conv_id, last_turn, window): the roles of the last turns of each conversation, kept as state of that size."""
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/conversations.parquet*")

    def slide(key, parts, state):
        held = list(zip(*state.get)) if state.exists else []
        for part in parts:
            held = sorted({*held, *zip(part["turn"].astype(int).tolist(), part["role"].tolist())})[-turns:]
        state.update(tuple(list(x) for x in zip(*held)))
        yield pd.DataFrame({"conv_id": [key[0]], "last_turn": [held[-1][0]], "window": [",".join(f"{t}:{r}" for t, r in held)]})

    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role")
    windows = slim.groupBy("conv_id").applyInPandasWithState(slide, "conv_id long, last_turn long, window string", "turns array<long>, roles array<string>", "update", GroupStateTimeout.NoTimeout)
    return merged(windows, ["conv_id"], ["last_turn"], work_folder(spark, "conversations"), "update")
