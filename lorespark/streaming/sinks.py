"""What streams leave in an index: batches applied once, whichever way a stream is restarted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators import logs, staleness
from lorespark.sources.snapshots import Snapshots
from lorespark.sources.written import written
from lorespark.streaming.logs import GAP_WINDOW

#: How long after a question its feedback counts, and how late rows may come.
FEEDBACK, LATE = GAP_WINDOW, "1 hour"


def once(store: Snapshots, name: str, apply: Callable[[DataFrame, dict], tuple[dict[str, DataFrame], dict[str, str]]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that commits what apply makes of a batch and the newest manifest, together with the batch's number.

    A batch whose number the store has already is not applied again.
    """

    def step(batch: DataFrame, number: int) -> None:
        was = store.latest()
        if int(was["state"].get(f"batch of {name}", -1)) >= number:
            return
        tables, state = apply(batch, was)
        store.commit(tables, {**state, f"batch of {name}": str(number)}, on=was)

    return step


def follow_commits(store: Snapshots, repo: str) -> Callable[[DataFrame, int], None]:
    """Keeps the commits of a repository (hash, when, paths) and the drift report of the store's documents (path, refs, updated_at).

    The report is replaced as a whole. Bundles say how far documents are behind, so they are dropped when the report changes, and kept
    when it does not.
    """

    def apply(batch: DataFrame, was: dict) -> tuple[dict[str, DataFrame], dict[str, str]]:
        have = lambda n: store.table(n, was) if n in was["tables"] else None
        new = batch.select(F.lit(repo).alias("repo"), "hash", "when", "paths")
        old = have("commits")
        commits = written((new if old is None else old.unionByName(new)).dropDuplicates(["repo", "hash"]))
        reports = None
        for r in [r.repo for r in commits.select("repo").distinct().collect()]:
            one = staleness.drift(store.table("aged", was), commits.where(F.col("repo") == r).drop("repo")).withColumn("repo", F.lit(r))
            reports = one if reports is None else reports.unionByName(one)
        if reports is None:
            return {"commits": commits}, {}
        report = written(staleness.drift_of_repositories(reports))
        before = have("drift")
        same = before is not None and before.select(report.columns).exceptAll(report).isEmpty() and report.exceptAll(before.select(report.columns)).isEmpty()
        tables = {"commits": commits}
        if not same:
            tables["drift"] = report
            tables |= {n: have(n).where("false") for n in ("bundles", "recent") if have(n) is not None}
        return tables, {}

    return once(store, f"commits of {repo}", apply)


def keep_newest(store: Snapshots, table: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Keeps the newest row of each key of a stream of updates, such as counters()."""

    def apply(batch: DataFrame, was: dict) -> tuple[dict[str, DataFrame], dict[str, str]]:
        if table not in was["tables"]:
            return {table: batch}, {}
        old = store.table(table, was)
        return {table: old.join(batch.select(*keys).distinct(), keys, "left_anti").select(batch.columns).unionByName(batch)}, {}

    return once(store, table, apply)


def rated_log(log: DataFrame, usage: DataFrame, feedback: str = FEEDBACK, late: str = LATE) -> DataFrame:
    """Rows of a stream of questions (log_id, at, ..., bundle_id), one for each feedback (bundle_id, at, useful) within `feedback` after it, or one with a null.

    A question with feedback comes at once, one without when its time for feedback is over; both streams' watermarks bound the state.
    """
    rated = usage.select(F.col("bundle_id").alias("of"), F.col("at").alias("rated_at"), "useful").withWatermark("rated_at", late)
    when = F.expr(f"bundle_id = of and rated_at >= at and rated_at <= at + interval {feedback}")
    return log.withWatermark("at", late).join(rated, when, "leftOuter").drop("of")


def gaps_of(rated: DataFrame, since, limit: int) -> DataFrame:
    """gaps_no_useful() of the rows that rated_log() wrote."""
    log = rated.drop("useful", "rated_at").dropDuplicates(["log_id"])
    # feedback stands with the question that it followed
    usage = rated.where("useful is not null").select(F.col("log_id").alias("bundle_id"), "useful")
    return logs.gaps_no_useful(log.withColumn("bundle_id", F.col("log_id")), usage, since, limit)
