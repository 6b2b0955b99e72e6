"""Streams: bars by event time with a watermark, and running state of each entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The events of Parquet files as a stream; ``folder`` is a folder, or a pattern of files (a single file must be given as one)."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_bars(events: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``code, start`` and prices of tumbling (or sliding) windows; events later than the watermark are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    o = F.struct("ts", "event_id")
    rows = events.where(F.col("value").isNotNull()).withWatermark("ts", late).groupBy(F.col("user_id").alias("code"), w.alias("w"))
    bars = rows.agg(F.min_by("value", o).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", o).alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("code", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def session_bars(events: DataFrame, gap: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """``code, start, end, n`` of sessions that a pause of ``gap`` ends."""
    rows = events.withWatermark("ts", late).groupBy(F.col("user_id").alias("code"), F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("n")).select("code", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def high_water(events: DataFrame) -> DataFrame:
    """``code, last_id, n_new, n_late``: of each batch the events past the entity's newest time so far, and those that are late or repeated.

    Spark hands over an entity's events of a batch in parts and in no order: of each part the times past the mark are kept (16 bytes an event), and put in order once all are there.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else -(2**63)
        n, times, ids = 0, [], []
        for rows in parts:
            us, own = rows["us"].to_numpy(), rows["event_id"].to_numpy()
            past = us > mark
            n += len(us)
            times.append(us[past].astype(np.int64))
            ids.append(own[past])
        us, own = np.concatenate(times), np.concatenate(ids)
        new, last = len(np.unique(us)), -1
        if new:
            mark = int(us.max())
            last = int(own[us == mark].min())
        state.update((mark,))
        yield pd.DataFrame({"code": [key[0]], "last_id": [last], "n_new": [new], "n_late": [n - new]})

    rows = events.select(F.col("user_id").alias("code"), F.unix_micros("ts").alias("us"), "event_id")
    return rows.groupBy("code").applyInPandasWithState(step, "code long, last_id long, n_new long, n_late long", "mark long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there now to Parquet and stop."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
