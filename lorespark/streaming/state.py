"""Streams with state that expires: served documents, counters that can be saved and restored, lookups spaced in time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lorespark.operators.logs import BOUNDS, SAMPLES, SERVED, SERVED_HOURS

# Least seconds between two looks at a proposal's request, and at a client; version of saved counters.
STATUS_EVERY, PROBE_EVERY, SAVED_VERSION = 600, 60, 1


def prepare(spark: SparkSession) -> None:
    """The state store that such streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# ---- documents served lately ----
SERVED_ROW = "instance string, path string, times long, last_at timestamp, via string"


class ServedSet(StatefulProcessor):
    """Of each instance: path to (times, last, via). A document goes when it was not served for `hours`, and the oldest go beyond `most`."""

    def __init__(self, most: int = SERVED, hours: int = SERVED_HOURS):
        self.most, self.window = most, hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.docs = handle.getMapState("docs", "path string", "times long, last long, via string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows))
        calls = sorted(zip(calls["at"].astype("datetime64[us]").astype("int64").tolist(), calls["name"], calls["path"]))
        held = {k[0]: tuple(v) for k, v in self.docs.iterator()}
        touched = set()
        for at, name, path in calls:
            times, last, via = held.get(path, (0, at, name))
            if last - at > self.window:
                continue  # later than the set remembers
            times = 1 if at - last > self.window else times + 1
            held[path] = (times, *max((last, via), (at, name)))
            touched.add(path)
        for path in touched:
            self.docs.updateValue((path,), held[path])
        if len(held) > self.most:
            newest = max(last for _, last, _ in held.values())
            held = self._drop(held, [p for p, (_, last, _) in held.items() if newest - last > self.window])
            order = sorted(held, key=lambda p: (-held[p][1], p))
            held = self._drop(held, order[self.most :])
        yield self._all(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = {k[0]: tuple(v) for k, v in self.docs.iterator()}
        held = self._drop(held, [p for p, (_, last, _) in held.items() if now - last > self.window])
        yield self._all(key, held)

    def _drop(self, held: dict, gone: list[str]) -> dict:
        for p in gone:
            self.docs.removeKey((p,))
        return {p: v for p, v in held.items() if p not in set(gone)}

    def _all(self, key, held: dict) -> pd.DataFrame:
        """The whole set, newest first, or a row without path where it is empty; the next timer waits for the document that goes first."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held:
            self.handle.registerTimer((min(last for _, last, _ in held.values()) + self.window) // 1000 + 1)
        order = sorted(held, key=lambda p: (-held[p][1], p)) or [None]
        values = [held.get(p, (0, None, None)) for p in order]
        return pd.DataFrame({"instance": key[0], "path": order, "times": [v[0] for v in values], "last_at": pd.to_datetime([v[1] for v in values], unit="us"), "via": [v[2] for v in values]})


def served_set(calls: DataFrame, most: int = SERVED, hours: int = SERVED_HOURS, late: str = "0 seconds") -> DataFrame:
    """instance, path, times, last_at, via: after each batch, the whole set of each instance that it changed.

    calls (a stream): instance, at, name, paths; a path counts once a call. times counts the calls since the document was last away
    for more than `hours`. State is at most `most` documents of an instance.
    """
    each = calls.withWatermark("at", late).select("instance", "at", "name", F.explode(F.array_distinct("paths")).alias("path")).where("path <> ''")
    return each.groupBy("instance").transformWithStateInPandas(ServedSet(most, hours), SERVED_ROW, "Update", "EventTime")


def served_runs(calls: DataFrame, hours: int = SERVED_HOURS, most: int = SERVED) -> DataFrame:
    """What served_set() holds after all of a table's calls: instance, path, times, last_at, via of documents served within `hours` before the instance's last call."""
    from pyspark.sql import Window

    each = calls.select("instance", "at", "name", F.explode(F.array_distinct("paths")).alias("path")).where("path <> ''")
    order = Window.partitionBy("instance", "path").orderBy("at", "name")
    gap = F.expr(f"interval {hours} hours")
    runs = each.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(order) > gap, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    last = runs.groupBy("instance", "path", "run").agg(F.count("*").alias("times"), F.max(F.struct("at", "name")).alias("v"))
    newest = last.groupBy("instance", "path").agg(F.max(F.struct("run", "times", "v")).alias("r")).select("instance", "path", "r.times", "r.v")
    ends = calls.groupBy("instance").agg(F.max("at").alias("end"))
    kept = newest.join(ends, "instance").where(F.col("v.at") >= F.col("end") - gap)
    place = F.row_number().over(Window.partitionBy("instance").orderBy(F.desc("v.at"), "path"))
    return kept.withColumn("place", place).where(F.col("place") <= most).select("instance", "path", "times", F.col("v.at").alias("last_at"), F.col("v.name").alias("via"))


# ---- counters that can be saved, restored and reset ----
SERIES_ROW = "surface string, name string, requests long, errors long, tokens long, chunks long, omitted long, seconds double, buckets array<long>, samples array<double>"
_SERIES = ["requests", "errors", "tokens", "chunks", "omitted", "seconds", "buckets", "samples"]


class Counters(StatefulProcessor):
    """Of each surface and name: counters, cumulative histogram and the last samples. Saved counters are where a new stream starts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("series", SERIES_ROW.split(", ", 2)[2])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.held.update(tuple(list(row[c]) if c in ("buckets", "samples") else float(row[c]) if c == "seconds" else int(row[c]) for c in _SERIES))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        old = self.held.get() if self.held.exists() else (0, 0, 0, 0, 0, 0.0, [0] * len(BOUNDS), [])
        took = new["seconds"].to_numpy(float)
        plain = [len(new), int(new["error"].sum()), int(new["tokens"].sum()), int(new["chunks"].sum()), int(new["omitted"].sum()), float(took.sum())]
        buckets = np.array(old[6]) + (took[:, None] <= np.array(BOUNDS)[None, :]).sum(0)
        now = (*(a + b for a, b in zip(old[:6], plain)), buckets.tolist(), [*old[7], *took.tolist()][-SAMPLES:])
        self.held.update(now)
        yield pd.DataFrame({"surface": [key[0]], "name": [key[1]], **{c: [v] for c, v in zip(_SERIES, now)}})


def counters(requests: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """After each batch, the counters of each series that it changed (SERIES_ROW). requests (a stream): event_id, at, surface, name, seconds, tokens, chunks, omitted, error.

    saved: rows of restored(); a new stream (a new checkpoint) counts on from them. Without them it starts at nothing, which is a reset.
    """
    start = saved.groupBy("surface", "name") if saved is not None else None
    columns = ["surface", "name", "event_id", "at", "seconds", "tokens", "chunks", "omitted", "error"]
    return requests.select(*columns).groupBy("surface", "name").transformWithStateInPandas(Counters(), SERIES_ROW, "Update", "None", initialState=start)


def saved(series: DataFrame, since: str) -> DataFrame:
    """json: one line for each series, with the version and the time that the counting began at. series: the newest row of each."""
    return series.select(F.to_json(F.struct(F.lit(SAVED_VERSION).alias("version"), F.lit(since).alias("since"), *series.columns)).alias("json"))


def restored(lines: DataFrame) -> DataFrame:
    """The rows that saved() wrote as json, with since. Lines of another version are an error, so nothing is half restored."""
    shape = f"version int, since string, {SERIES_ROW}"
    rows = lines.select(F.from_json("json", shape).alias("r")).select("r.*")
    wrong = F.raise_error(F.concat(F.lit("saved counters have version "), F.coalesce(F.col("version").cast("string"), F.lit("none")), F.lit(f", not {SAVED_VERSION}"))).cast("boolean")
    return rows.where(F.coalesce(F.when(F.col("version") == SAVED_VERSION, True), wrong)).drop("version")


# ---- lookups spaced in time ----
class Spaced(StatefulProcessor):
    """Of each key: a lookup at once, and none sooner than `every` seconds after the last; what is asked meanwhile is one lookup at that time."""

    def __init__(self, every: int):
        self.every = every * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        due = self.last.get()[0] + self.every if self.last.exists() else now
        if now >= due:
            yield self._look(key, now)
        elif not list(self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._look(key, timerValues.getCurrentProcessingTimeInMs())

    def _look(self, key, now: int) -> pd.DataFrame:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((now,))
        return pd.DataFrame({"key": [str(key[0])], "at": pd.to_datetime([now], unit="ms")})


def spaced(asked: DataFrame, key: str, every: int = STATUS_EVERY) -> DataFrame:
    """key, at: the lookups that a stream of wishes for them (key) leads to, each key's at least `every` seconds apart."""
    return asked.groupBy(key).transformWithStateInPandas(Spaced(every), "key string, at timestamp", "Update", "ProcessingTime")
