"""Structured Streaming: sittings as session windows, day counts, latest snapshots, and timed refreshes."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.calendar import latest
from tallyloom.shared import table_path


def sitting_windows(records: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(session_id, starts_at, ends_at, records) of a stream of (session_id, ts): gap windows, closed by the watermark.

    Records are taken by time here, not in file order: an equal gap stays in, as in the batch fold. State holds open
    windows only and shrinks as the watermark passes.
    """
    w = F.session_window("ts", gap)
    g = records.withWatermark("ts", late).groupBy("session_id", w.alias("w")).agg(F.count(F.lit(1)).alias("records"), F.min("ts").alias("starts_at"), F.max("ts").alias("ends_at"))
    return g.select("session_id", "starts_at", "ends_at", "records")


def day_counts(archived: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, source_agent, sessions) of a stream of (source_agent, archived_at): tumbling UTC days."""
    g = archived.withWatermark("archived_at", late).groupBy(F.window("archived_at", "1 day").alias("w"), "source_agent").agg(F.count(F.lit(1)).alias("sessions"))
    return g.select(F.to_date("w.start").alias("day"), "source_agent", "sessions")


def keep_latest(listing: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep one row per session, its newest snapshot, in versions below `path` as listing rows stream in.

    Every batch merges into the last whole version and writes the next one; a version counts once its mark is written,
    so a batch that fails or runs twice changes nothing that was published.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = published(batch, path)
        now = latest(batch) if done is None or done >= number else latest(spark.read.parquet(f"{path}/v={done}").unionByName(batch))
        if done is None or done < number:
            now.write.mode("overwrite").parquet(f"{path}/v={number}")
            publish(batch, path, number)

    return listing.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def publish(df: DataFrame, path: str, number: int, note: dict | None = None) -> None:
    """Mark version `number` as whole; the note's entries stand beside its number."""
    spark = df.sparkSession
    row = json.dumps({"version": number, "at": dt.datetime.now(dt.UTC).isoformat(), **(note or {})})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_marks/{number}")


def published(df: DataFrame, path: str) -> int | None:
    """The newest whole version."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_marks")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    found = [int(s.getPath().getName()) for s in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(found, default=None)


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream comes to once its input is read, as a table in the shared folder: nothing is gathered on the driver."""
    spark = stream.sparkSession
    path = table_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{path}/v={number}")
            publish(batch, path, number)
        else:
            batch.write.mode("append").parquet(f"{path}/v=0")
            publish(batch, path, 0)

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}-marks").trigger(availableNow=True).start()
    q.awaitTermination()
    last = published(stream, path)
    return spark.createDataFrame([], stream.schema) if last is None else spark.read.schema(stream.schema).parquet(f"{path}/v={last}")


def note_of(spark: SparkSession, path: str, number: int) -> dict:
    """What was noted with version `number`."""
    return json.loads(spark.read.text(f"{path}/_marks/{number}").first().value)


def refresh_once(spark: SparkSession, path: str, number: int, build: Callable[[], str]) -> dict:
    """Build the payload anew and publish it below path as generation `number`, at most once.

    If building fails, the last good body is published again with the time since when it is stale; without one the
    error is raised. All that is known lies in the folder, so a restart goes on where the last process ended.
    """
    base = spark.range(0)
    last = published(base, path)
    if last is not None and last >= number:
        return note_of(spark, path, last)
    try:
        note = {"body_of": number, "stale_since": None, "error": None}
        spark.createDataFrame([(build(),)], "body string").coalesce(1).write.mode("overwrite").parquet(f"{path}/v={number}")
    except Exception as e:  # the next refresh tries again; until then readers keep the last payload
        if last is None:
            raise
        before = note_of(spark, path, last)
        note = {"body_of": before["body_of"], "stale_since": before["stale_since"] or dt.datetime.now(dt.UTC).isoformat(), "error": str(e)}
    publish(base, path, number, note)
    return note


def generations(spark: SparkSession, path: str) -> DataFrame:
    """(generation, stale_since, error, body) of what was published below path."""
    notes = spark.read.text(f"{path}/_marks/*").select(F.from_json("value", "version int, body_of int, stale_since string, error string").alias("n"))
    bodies = spark.read.option("basePath", path).parquet(f"{path}/v=*").select(F.col("v").cast("int").alias("body_of"), "body")
    return notes.select(F.col("n.version").alias("generation"), "n.stale_since", "n.error", "n.body_of").join(bodies, "body_of").drop("body_of")


def refresh(ticks: DataFrame, build: Callable[[], str], path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """refresh_once at every tick of a stream, with its batches as generations."""
    spark = ticks.sparkSession
    return ticks.writeStream.foreachBatch(lambda _, number: refresh_once(spark, path, number, build)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
