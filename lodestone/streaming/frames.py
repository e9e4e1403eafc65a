"""The frame and request log as a stream: the frame controller with state, and windowed request counts.

Event-time windows with a watermark are an addition of this engine; frames alone drive the controller.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.cache import Control, step
from lodestone.session import scratch_path


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (frame, ts, camera, node, elapsed_ms, error) from event files."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path[:-1] + f"[{path[-1]}]")  # a pattern: a stream of one file is a folder's
    return events.select(F.col("event_id").alias("frame"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 8).cast("long").alias("camera"), F.col("user_id").alias("node"), (10 + F.col("event_id") % 90).cast("double").alias("elapsed_ms"), F.col("value").alias("error"))


def control(frames: DataFrame, settings: Control = Control()) -> DataFrame:
    """Per camera, over batches: (camera, frame, fps, current_error); the state is the last rate and error."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fps, error = state.get if state.exists else (settings.min_fps, settings.target)
        rows = pd.concat(parts).sort_values("frame")
        out = []
        for frame, elapsed in zip(rows["frame"], rows["elapsed_ms"]):
            fps, error = step(fps, error, elapsed, settings)
            out.append((key[0], frame, fps, error))
        state.update((fps, error))
        yield pd.DataFrame(out, columns=["camera", "frame", "fps", "current_error"])

    return frames.groupBy("camera").applyInPandasWithState(run, "camera long, frame long, fps double, current_error double", "fps double, error double", "append", GroupStateTimeout.NoTimeout)


def windowed(frames: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(camera, start, frames, error) of tumbling windows; later rows than the watermark allows are left out."""
    w = frames.withWatermark("ts", late).groupBy("camera", F.window("ts", size)).agg(F.count("*").alias("frames"), F.max("error").alias("error"))
    return w.select("camera", F.col("window.start").alias("start"), "frames", "error")


def sessions(frames: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(camera, start, end, frames) of sessions that end with a gap."""
    s = frames.withWatermark("ts", late).groupBy("camera", F.session_window("ts", gap)).agg(F.count("*").alias("frames"))
    return s.select("camera", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "frames")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives when all that is there has been read, as a table in the shared folder."""
    spark = stream.sparkSession
    to = scratch_path(spark, "stream")
    schema = stream.schema
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{to}-state").trigger(availableNow=True).start(to)
    else:  # the last complete result
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{to}-state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(to)).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(to)
