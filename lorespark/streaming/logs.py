"""The log operators over streams: windows with watermarks, keyed state with checkpoints, per-batch side effects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespark.operators.logs import BOUNDS, RECENT

# How long a query log is kept, the gap window, how often a source is polled.
RETENTION, GAP_WINDOW, GAP_STEP, POLL = "30 days", "7 days", "1 day", "60 seconds"


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, at: str, key: str, value: str, size: str, late: str = RETENTION) -> DataFrame:
    return sliding(events, at, key, value, size, size, late)


def sliding(events: DataFrame, at: str, key: str, value: str, size: str, step: str, late: str = RETENTION) -> DataFrame:
    """start, end, key, n, total per window; rows later than the watermark are dropped."""
    out = events.withWatermark(at, late).groupBy(F.window(at, size, step).alias("w"), key)
    return out.agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = RETENTION) -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key)
    return out.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def series(requests: DataFrame) -> DataFrame:
    """The counters and cumulative histogram of each series, kept in checkpointed state across restarts."""
    counts = [F.count_if(F.col("seconds") <= b).alias(f"le_{i}") for i, b in enumerate(BOUNDS)]
    return requests.groupBy("surface", "name").agg(F.count("*").alias("requests"), F.count_if("error").alias("errors"), *counts)


def gap_candidates(log: DataFrame) -> DataFrame:
    """Queries without results by sliding window of the gap report."""
    return (
        log.where("results = 0").withWatermark("at", RETENTION).groupBy(F.window("at", GAP_WINDOW, GAP_STEP).alias("w"), "query", "scopes")
        .agg(F.count("*").alias("times"), F.max("at").alias("last_at")).select(F.col("w.start").alias("start"), "query", "scopes", "times", "last_at")
    )


def last_n(events: DataFrame, key: str, at: str, value: str, n: int = RECENT) -> DataFrame:
    """key, at, value: the newest n values of each key after every batch, in state of bounded size."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for f in frames:
            held += list(zip(f[at].astype("int64") // 1000, f[value]))
        held = sorted(held, reverse=True)[:n]
        state.update(([h[0] for h in held], [float(h[1]) for h in held]))
        yield pd.DataFrame({key: [k[0]] * len(held), at: pd.to_datetime([h[0] for h in held], unit="us"), value: [float(h[1]) for h in held]})

    kind = dict(events.dtypes)[key]
    out, held = f"{key} {kind}, {at} timestamp, {value} double", "ats array<long>, vals array<double>"
    return events.groupBy(key).applyInPandasWithState(step, out, held, "update", GroupStateTimeout.NoTimeout)


def served_now(calls: DataFrame) -> DataFrame:
    """Documents served by 24-hour window sliding by the hour: the window's end bounds the state, as an age limit would."""
    return (
        calls.withWatermark("at", "24 hours").groupBy(F.window("at", "24 hours", "1 hour").alias("w"), "path")
        .agg(F.count("*").alias("times"), F.max("at").alias("last_at")).select(F.col("w.end").alias("end"), "path", "times", "last_at")
    )


def poll(stream: DataFrame, sync: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Runs sync on each batch, one after the other: every minute, or once over what there is."""
    writer = stream.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()
