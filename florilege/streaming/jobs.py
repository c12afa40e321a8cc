"""Structured Streaming: decision upsert, duplicate suppression, event windows, and admission of requests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.storage import checkpoint_dir


def stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet file or folder as a stream; the path may be either."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path.rstrip("/")[:-1] + "[" + path.rstrip("/")[-1] + "]")


def run(df: DataFrame, mode: str, timeout: float | None = None) -> DataFrame:
    """What a stream gives once all its input is read, from a table in the shared folder.

    complete mode replaces the table with each batch, append mode adds to it; a repeated batch writes its folder anew.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = df.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/" + ("all" if mode == "complete" else f"batch={number}"))

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination(timeout) if timeout else query.awaitTermination()
    out = spark.read.schema(schema)
    return out.parquet(f"{folder}/out/all") if mode == "complete" else out.option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def upsert_decisions(decisions: DataFrame) -> DataFrame:
    """The store's rows as a stateful aggregation: first and last times and sources, and how often seen.

    Ties go to the greater source and decision, as in the batch form. Use it in complete or update mode.
    """
    seen = F.coalesce("last_seen", "first_seen")
    first = F.min(F.struct("first_seen", F.coalesce("first_source", F.lit("")).alias("s")))
    last = F.max(F.struct(seen.alias("t"), F.coalesce("last_source", "first_source", F.lit("")).alias("s"), "decision", "reason"))
    out = decisions.groupBy("normalized_url").agg(first.alias("f"), last.alias("l"), F.sum("seen_count").alias("seen_count"))
    return out.select("normalized_url", "l.decision", "l.reason", F.col("f.first_seen").alias("first_seen"), F.col("l.t").alias("last_seen"), F.col("f.s").alias("first_source"), F.col("l.s").alias("last_source"), "seen_count")


def distinct_events(events: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """Events without repeats of the keys within the watermark's delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def window_counts(events: DataFrame, time: str, length: str, slide: str | None, *keys: str) -> DataFrame:
    """(window_start, keys.., n): events in tumbling or sliding windows."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def admission(events: DataFrame, key: str, time: str, most: int, seconds: float) -> DataFrame:
    """(key, time, wait): requests of each key in the order of their times with the seconds each must wait.

    A request is admitted if fewer than ``most`` were admitted in the ``seconds`` before it; else it waits until the
    oldest of them leaves the window. State is at most ``most`` admission times a key. Batch form: requests of one
    key are sorted in one task, state doesn't grow with them.
    """
    from collections import deque

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque()
        for b in batches:
            waits = []
            for k, t in zip(b[key], b[time].astype("int64") / 1e6, strict=True):
                if k != now:
                    now, held = k, deque()
                start = max(t, held[-1]) if held else t
                while held and start - held[0] >= seconds:
                    held.popleft()
                if len(held) >= most:
                    start = max(start, held[0] + seconds)
                    while held and start - held[0] >= seconds:
                        held.popleft()
                held.append(start)
                waits.append(round(start - t, 6))
            yield b.assign(wait=waits)

    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.unix_micros(F.col(time).cast("timestamp")).alias(time))
    out = rows.repartition(key).sortWithinPartitions(key, time).mapInPandas(admit, f"`{key}` {rows.schema[key].dataType.simpleString()}, `{time}` long, wait double")
    return out.select(key, F.timestamp_micros(time).alias(time), "wait")


def admission_stream(events: DataFrame, key: str, time: str, most: int, seconds: float) -> DataFrame:
    """The stream form of admission: state by key of at most ``most`` admission times."""

    def admit(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        times = sorted(t for b in batches for t in b["_t"])
        waits = []
        for t in times:
            t /= 1e6
            start = max([t, *held[-1:]])
            held = [x for x in held if start - x < seconds]
            if len(held) >= most:
                start = max(start, held[0] + seconds)
                held = [x for x in held if start - x < seconds]
            held.append(start)
            waits.append(round(start - t, 6))
        state.update((held[-most:],))
        yield pd.DataFrame({"key": [str(k[0])] * len(times), "micros": times, "wait": waits})

    rows = events.select(F.col(key), F.unix_micros(F.col(time).cast("timestamp")).alias("_t")).where(F.col(key).isNotNull() & F.col("_t").isNotNull())
    return rows.groupBy(key).applyInPandasWithState(admit, "key string, micros long, wait double", "held array<double>", "append", "NoTimeout")
