"""Streams with state: replays against loops, after restarts, and with a clock set by hand."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorespark.operators import logs
from lorespark.sources.snapshots import Snapshots
from lorespark.streaming import sinks
from lorespark.streaming import state as S

AT = dt.datetime(2024, 1, 10)


class Handle:
    """States and timers of one key, for processors that are called by hand."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, set()

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def iterator(self):
        return iter(list(self.map.items()))

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        self.map.pop(k, None)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Clock:
    def __init__(self, ms=0):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms

    getCurrentWatermarkInMs = getCurrentProcessingTimeInMs


@pytest.mark.parametrize("most", [3, 2000])
def test_served_set_against_a_loop(most):
    r = random.Random(most)
    handle, held, now = Handle(), {}, AT
    one = S.ServedSet(most, 24)
    one.init(handle)
    for _ in range(60):
        batch = []
        for _ in range(r.randint(1, 4)):
            now += dt.timedelta(hours=r.choice([0, 1, 5, 30]))
            batch.append((now, r.choice(["search", "bundle"]), f"d{r.randint(1, 6)}"))
        got = pd.concat(list(one.handleInputRows(("x",), iter([pd.DataFrame(batch, columns=["at", "name", "path"])]), Clock())))
        for at, name, path in sorted(batch):
            n, last, via = held.get(path, (0, at, name))
            held[path] = (1 if at - last > dt.timedelta(hours=24) else n + 1, *max((last, via), (at, name)))
        if len(held) > most:
            held = {p: v for p, v in held.items() if now - v[1] <= dt.timedelta(hours=24)}
            held = dict(sorted(held.items(), key=lambda x: (-x[1][1].timestamp(), x[0]))[:most])
        assert {r.path: (r.times, r.last_at.to_pydatetime(), r.via) for r in got.itertuples()} == held
        assert len(handle.timers) == 1
        if r.random() < 0.3:  # time goes on without calls
            late = int((now + dt.timedelta(hours=25)).replace(tzinfo=dt.UTC).timestamp() * 1000)
            empty = pd.concat(list(one.handleExpiredTimer(("x",), Clock(late), None)))
            assert empty.path.tolist() == [None] and not handle.map and not handle.timers
            held, now = {}, now + dt.timedelta(hours=25)


def run(stream, step, checkpoint, mode="update"):
    q = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def files(df, folder, parts):
    for i, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(str(folder))


def test_served_stream_after_a_restart(spark, tmp_path):
    S.prepare(spark)
    r = random.Random(2)
    rows = [("a" if i % 3 else "b", AT + dt.timedelta(hours=2 * i), r.choice(["search", "bundle"]), [f"d{r.randint(1, 4)}" for _ in range(3)] + [""]) for i in range(40)]
    calls = spark.createDataFrame(rows, "instance string, at timestamp, name string, paths array<string>")
    store = Snapshots(spark, f"file://{tmp_path}/store")
    for half in (F.col("at") < AT + dt.timedelta(hours=41), F.col("at") >= AT + dt.timedelta(hours=41)):
        files(calls, tmp_path / "in", [half])
        stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
        run(S.served_set(stream), sinks.keep_newest(store, "served", ["instance"]), tmp_path / "check")
    got = {tuple(x) for x in store.table("served").where("path is not null").collect()}
    ends = {i: max(x[1] for x in rows if x[0] == i) for i in "ab"}
    got = {x for x in got if ends[x[0]] - x[3] <= dt.timedelta(hours=24)}
    assert got == {tuple(x) for x in S.served_runs(calls).collect()} and len(got) > 3
    # within one day it is what the batch report says
    day = calls.where(F.col("at") >= AT + dt.timedelta(hours=60)).withColumn("call_id", F.monotonically_increasing_id())
    report = logs.served(day.where("instance = 'a'").select("call_id", "at", "name", F.explode("paths").alias("path")).where("path <> ''"), F.lit(ends["a"]))
    runs = S.served_runs(day.where(F.col("at") >= ends["a"] - dt.timedelta(hours=24)).where("instance = 'a'"))
    assert {(x.path, x.times, x.last_at, x.via) for x in report.collect()} == {(x.path, x.times, x.last_at, x.via) for x in runs.collect()}


def requests(spark, n, seed):
    r = random.Random(seed)
    rows = [(i, AT + dt.timedelta(seconds=i), r.choice(["mcp", "http"]), r.choice(["a", "b"]), r.random() * 3, r.randint(0, 99), r.randint(0, 5), r.randint(0, 2), r.random() < 0.1) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, at timestamp, surface string, name string, seconds double, tokens long, chunks long, omitted long, error boolean")


def test_counters_are_saved_restored_and_reset(spark, tmp_path):
    S.prepare(spark)
    every = requests(spark, 900, 5)
    early, late = F.col("event_id") < 500, F.col("event_id") >= 500
    store = Snapshots(spark, f"file://{tmp_path}/store")
    step = lambda name: sinks.keep_newest(store, name, ["surface", "name"])
    files(every, tmp_path / "one", [early & (F.col("event_id") < 200), early & (F.col("event_id") >= 200)])
    read = lambda f: spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f))
    run(S.counters(read("one")), step("first"), tmp_path / "c1")
    S.saved(store.table("first"), "2024-01-10").write.text(str(tmp_path / "saved"))
    lines = spark.read.text(str(tmp_path / "saved")).withColumnRenamed("value", "json")
    back = S.restored(lines)
    assert {r.since for r in back.collect()} == {"2024-01-10"} and back.count() == 4
    # a new checkpoint counts on from what was saved; the first stream, restarted, counts on too
    files(every, tmp_path / "two", [late])
    files(every, tmp_path / "one", [late])
    run(S.counters(read("two"), back.drop("since")), step("second"), tmp_path / "c2")
    run(S.counters(read("one")), step("first"), tmp_path / "c1")
    exact = lambda df: {(r.surface, r.name): (r.requests, r.errors, r.tokens, r.chunks, r.omitted, round(r.seconds, 6), tuple(r.buckets), tuple(r.samples)) for r in df.collect()}
    assert exact(store.table("first")) == exact(store.table("second"))
    whole = {(r.surface, r.name): r for r in logs.series(every).collect()}
    for k, v in exact(store.table("second")).items():
        w = whole[k]
        assert v[:6] == (w.requests, w.errors, w.tokens, w.chunks, w.omitted, w.seconds) and v[6] == tuple(w[f"le_{i}"] for i in range(12))
        last = [r.seconds for r in every.where((F.col("surface") == k[0]) & (F.col("name") == k[1])).orderBy("at").collect()]
        assert list(v[7]) == last[-512:]
    # a reset: nothing from before
    run(S.counters(read("two")), step("third"), tmp_path / "c3")
    assert {k: v[0] for k, v in exact(store.table("third")).items()} == {(r.surface, r.name): r.requests for r in logs.series(every.where(late)).collect()}
    with pytest.raises(Exception, match="version 9"):
        S.restored(spark.createDataFrame([('{"version": 9}',)], "json string")).collect()


def test_lookups_are_spaced():
    """A clock set by hand: wishes at any time, timers when they are due."""
    r = random.Random(1)
    handle, one = Handle(), S.Spaced(S.STATUS_EVERY)
    one.init(handle)
    now, looked, wished = 0, [], []
    for _ in range(300):
        now += r.choice([1_000, 30_000, 400_000, 900_000])
        for t in [t for t in handle.listTimers() if t <= now]:
            handle.deleteTimer(t)
            looked += [int(f["at"].iloc[0].timestamp() * 1000) for f in one.handleExpiredTimer(("k",), Clock(t), None)]
        if r.random() < 0.7:
            wished.append(now)
            looked += [int(f["at"].iloc[0].timestamp() * 1000) for f in one.handleInputRows(("k",), iter([pd.DataFrame({"k": ["k"]})]), Clock(now))]
        assert len(handle.timers) <= 1
    expected, last = [], None
    for w in wished:  # at once, or when the time is over; one lookup serves all wishes until then
        due = w if last is None else max(w, last + 600_000)
        if last is None or last < w:
            expected.append(due)
            last = due
    assert [x for x in looked] == [x for x in expected if x <= now]
    assert all(b - a >= 600_000 for a, b in zip(looked, looked[1:]))


def test_gaps_stream_with_late_feedback(spark, tmp_path):
    r = random.Random(3)
    log = [(f"l{i}", AT + dt.timedelta(hours=i), "search", f"q{r.randint(1, 8)}", "domain", r.randint(0, 2), 0.5, 0.1, f"l{i}") for i in range(60)]
    usage = [(f"l{i}", AT + dt.timedelta(hours=i + r.choice([1, 30, 100])), r.random() < 0.3) for i in range(60) for _ in range(r.choice([0, 1, 2]))]
    end = AT + dt.timedelta(days=60)
    log_rows = spark.createDataFrame(log + [("end", end, "search", "end", "x", 1, 0.5, 0.1, "end"), ("end2", end + dt.timedelta(days=30), "search", "end", "x", 1, 0.5, 0.1, "end2")], "log_id string, at timestamp, name string, query string, scopes string, results int, top_score double, margin double, bundle_id string")
    usage_rows = spark.createDataFrame(usage + [("none", end, False), ("none", end + dt.timedelta(days=30), False)], "bundle_id string, at timestamp, useful boolean")
    out = tmp_path / "rated"
    for k, (a, b) in enumerate([(AT - dt.timedelta(1), AT + dt.timedelta(hours=30)), (AT + dt.timedelta(hours=30), AT + dt.timedelta(days=20)), (end, end + dt.timedelta(1)), (end + dt.timedelta(2), end + dt.timedelta(90))]):
        between = (F.col("at") >= a) & (F.col("at") < b)
        files(log_rows, tmp_path / "log", [between])
        files(usage_rows, tmp_path / "usage", [between])
        streams = [spark.readStream.schema(x.schema).parquet(str(tmp_path / n)) for n, x in (("log", log_rows), ("usage", usage_rows))]
        q = sinks.rated_log(*streams).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    rated = spark.read.parquet(str(out)).where("log_id not like 'end%'")
    assert rated.select("log_id").distinct().count() == 60
    plain = spark.createDataFrame(usage, usage_rows.schema).drop("at")
    expected = logs.gaps_no_useful(log_rows.where("log_id not like 'end%'"), plain, F.lit(AT), 20)
    columns = ["query", "scopes", "times", "last_at", "reason"]
    assert [tuple(x) for x in sinks.gaps_of(rated, F.lit(AT), 20).select(columns).collect()] == [tuple(x) for x in expected.select(columns).collect()] != []


def test_drift_is_replaced_and_bundles_dropped_once(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/store")
    aged = spark.createDataFrame([("domain/a.md", ["svc/**"], AT), ("domain/b.md", ["lib/x.go"], AT)], "path string, refs array<string>, updated_at timestamp")
    bundles = spark.createDataFrame([("k", "f")], "cache_key string, fingerprint string")
    commits = lambda *c: spark.createDataFrame([(h, AT + dt.timedelta(days=d), p) for h, d, p in c], "hash string, when timestamp, paths array<string>")
    store.commit({"aged": aged, "bundles": bundles})
    step = sinks.follow_commits(store, "main")
    report = lambda: {r.path: r.commits for r in store.table("drift").collect()}
    step(commits(("h1", 1, ["svc/a.go"])), 0)
    assert report() == {"domain/a.md": 1} and store.table("bundles").count() == 0
    store.commit({"bundles": bundles})
    step(commits(("h1", 1, ["svc/a.go"])), 0)  # the same batch again, after a restart
    assert report() == {"domain/a.md": 1} and store.table("bundles").count() == 1
    step(commits(("h2", -1, ["svc/a.go"]), ("h3", 2, ["doc/x"])), 1)  # nothing that documents are behind of
    assert store.table("bundles").count() == 1 and store.table("commits").count() == 3
    step(commits(("h4", 3, ["svc/b.go", "lib/x.go"])), 2)
    assert report() == {"domain/a.md": 2, "domain/b.md": 1} and store.table("bundles").count() == 0
    # a second repository: a document keeps the report with most commits
    sinks.follow_commits(store, "other")(commits(("o1", 4, ["lib/x.go"]), ("o2", 5, ["lib/x.go"])), 0)
    assert report() == {"domain/a.md": 2, "domain/b.md": 2}
