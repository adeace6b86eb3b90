"""Streams: deduplication in a window, windowed counts, suppression of repeated alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import new_path


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of a folder or a single file."""
    schema = spark.read.parquet(path).schema
    where, _, name = path.rpartition("/")
    if name.endswith(".parquet"):  # a stream reads folders: this one, with the file's name as its filter
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(where)
    return spark.readStream.schema(schema).parquet(path)


def first_seen(events: DataFrame, key: str, ts: str, window: str) -> DataFrame:
    """Each key once within the window; what comes again later is new."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, ts: str, key: str, value: str, size: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def suppressed(events: DataFrame, key: str, ts: str, hours: int) -> DataFrame:
    """(key, ts) of alerts that go out: one that was sent silences its key for so many hours.

    What counts is the last alert sent, not the last one seen, so the state is that one time a key.
    """
    gap = pd.Timedelta(hours=hours)

    def send(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for moment in sorted(m for b in batches for m in b[ts]):
            if last is None or moment - last >= gap:
                out.append(moment)
                last = moment
        if last is not None:
            state.update((int(last.value // 1000),))
        yield pd.DataFrame({key: [keys[0]] * len(out), ts: out})

    kind = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(send, f"{key} {kind[key]}, {ts} timestamp", "last long", "append", "NoTimeout")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and return what it put out."""
    spark = stream.sparkSession
    out, mark = new_path(spark, "stream-out"), new_path(spark, "stream-mark")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
