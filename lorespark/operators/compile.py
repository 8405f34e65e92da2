"""Bundles for many tasks at once: look up by key, retrieve for the keys that are missing only, compile, store.

Keys are looked up among the RECENT bundles used last, then in the table of all bundles, then compiled. Both are tables of a snapshot
store and change in one version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import bundle, retrieval, staleness
from lorespark.sources.snapshots import Snapshots
from lorespark.sources.written import written

# Bundles held as used last; scopes and tokens of a task that names none.
RECENT, SCOPES, TOKENS = 256, ("domain", "conventions"), retrieval.DEFAULT_TOKENS

BUNDLE = (
    "cache_key string, bundle_id string, task string, scopes array<string>, max_tokens long, fingerprint string, model string, content string, tokens long, "
    "sections array<struct<chunk_id:string,doc_path:string,scope:string,heading:string,tokens:bigint>>, truncated boolean, created_at timestamp, top_score double, margin double"
)


def requests(tasks: DataFrame, fingerprint: str, model: str = "", scopes: tuple[str, ...] = SCOPES, max_tokens: int = TOKENS) -> DataFrame:
    """task_id, task, query, scopes, paths, max_tokens, cache_key, bundle_id of tasks (task_id, task and, if there, query, scopes, paths, max_tokens).

    Tasks without text go: there is nothing to compile for them. A query of its own takes part in the key. Scopes and paths count as
    sets. The bundle's id is the first 16 digits of its key.
    """
    of = lambda name, kind: F.col(name) if name in tasks.columns else F.lit(None).cast(kind)
    task = F.trim(F.regexp_replace("task", r"^\s+|\s+$", ""))
    query = F.coalesce(F.nullif(F.trim(F.regexp_replace(of("query", "string"), r"^\s+|\s+$", "")), F.lit("")), task)
    named = F.coalesce(of("scopes", "array<string>"), F.expr("cast(array() as array<string>)"))
    default = F.array(*map(F.lit, scopes)) if scopes else F.expr("cast(array() as array<string>)")
    asked = tasks.select(
        "task_id", task.alias("task"), query.alias("query"), T.normalized_list(F.when(F.size(named) > 0, named).otherwise(default)).alias("scopes"),
        T.normalized_paths(F.coalesce(of("paths", "array<string>"), F.expr("cast(array() as array<string>)"))).alias("paths"),
        F.when(of("max_tokens", "long") > 0, of("max_tokens", "long")).otherwise(F.lit(max_tokens)).cast("long").alias("max_tokens"),
    ).where("task <> ''")
    subject = F.when(F.col("query") == F.col("task"), F.col("task")).otherwise(F.concat("task", F.lit("\x00q:"), F.sha2("query", 256)))
    key = T.cache_key(subject, F.col("scopes"), F.col("max_tokens"), F.lit(fingerprint), F.lit(model), F.col("paths"))
    return asked.withColumn("cache_key", key).withColumn("bundle_id", F.substring("cache_key", 1, 16))


def new_bundles(asked: DataFrame, found: DataFrame, fingerprint: str, model: str, at: str) -> DataFrame:
    """A row of the bundle table for each request, from its ranked sections.

    found: query_id (the bundle's id), rank, chunk_id, content, tokens, doc_path, heading, scope, updated_at, changes, changed_at, top_score, margin.
    """
    ranked = found.withColumnRenamed("query_id", "bundle_id")
    texts = bundle.compile_bundle(ranked.drop("top_score", "margin"), asked, fingerprint)
    sure = ranked.groupBy("bundle_id").agg(F.max("top_score").alias("top_score"), F.max("margin").alias("margin"))
    made = asked.drop("tokens").join(texts, "bundle_id").join(sure, "bundle_id", "left")
    kept = made.select("bundle_id", "kept").join(bundle.pack(ranked, bundle.heads(asked, fingerprint)).select("bundle_id", F.explode("selected").alias("s")), "bundle_id").where("s.rank <= kept")
    item = F.struct(bundle.scope_rank(F.col("scope")).alias("s"), F.col("rank").cast("int").alias("r"), F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), "doc_path", "scope", "heading", F.col("tokens").cast("long").alias("tokens")).alias("x"))
    listed = ranked.join(kept.select("bundle_id", F.col("s.rank").alias("rank")), ["bundle_id", "rank"]).groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias("sections"))
    none = F.expr("cast(array() as array<struct<chunk_id:string,doc_path:string,scope:string,heading:string,tokens:bigint>>)")
    return made.join(listed, "bundle_id", "left").select(
        "cache_key", "bundle_id", "task", "scopes", "max_tokens", F.lit(fingerprint).alias("fingerprint"), F.lit(model).alias("model"), F.col("text").alias("content"), F.col("tokens").cast("long").alias("tokens"),
        F.coalesce("sections", none).alias("sections"), "truncated", F.lit(at).cast("timestamp").alias("created_at"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("margin", F.lit(0.0)).alias("margin"),
    )


def finder(
    chunks: DataFrame, vectors: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, docs: DataFrame | None = None, drift: DataFrame | None = None, mode: str | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """A `find` for compile_tasks() over sections: the CANDIDATES best of the search entry, those of documents that govern the paths put forward.

    chunks: chunk_id, doc_id, doc_path, heading, scope, position, content, tokens and, if known, updated_at; docs: path, refs; drift: path,
    commits, last_change_at.
    """

    def find(requests: DataFrame) -> DataFrame:
        governing = None
        if docs is not None:
            asked = requests.select("query_id", F.explode("paths").alias("code_path"))
            governing = staleness.governing(docs, asked).withColumnRenamed("path", "doc")
        way = mode or ("bm25" if vectors is None else "hybrid")
        hits, near = retrieval.sections(chunks, requests.select("query_id", "query", "scopes"), vectors, None, bundle.CANDIDATES * retrieval.HITS_PER_TOP, True, way, governing, embed)
        # at most CANDIDATES rows of a query are sent to the sections, so that these are not shuffled
        best = chunks.join(F.broadcast(hits.where(F.col("rank") <= bundle.CANDIDATES).select("query_id", "rank", "chunk_id")), "chunk_id")
        if "updated_at" not in best.columns:
            best = best.withColumn("updated_at", F.lit(None).cast("timestamp"))
        if drift is not None:
            best = retrieval.attach_drift(best, drift)
        else:
            best = best.withColumn("changes", F.lit(None).cast("int")).withColumn("changed_at", F.lit(None).cast("timestamp"))
        if near is not None:
            best = best.join(retrieval.margin(near).withColumnRenamed("top", "top_score"), "query_id", "left")
        else:
            best = best.withColumn("top_score", F.lit(0.0)).withColumn("margin", F.lit(0.0))
        # written, as bundles read them several times
        return written(best.select("query_id", "rank", "chunk_id", "content", "tokens", "doc_path", "heading", "scope", "updated_at", "changes", "changed_at", "top_score", "margin"))

    return find


def compile_tasks(
    store: Snapshots, tasks: DataFrame, find: Callable[[DataFrame], DataFrame], fingerprint: str, model: str = "", at: str = "1970-01-01", recent: int = RECENT,
    scopes: tuple[str, ...] = SCOPES, max_tokens: int = TOKENS,
) -> DataFrame:
    """task_id, source (recent, table or new), cached, and the bundle (see BUNDLE) of each task that has text.

    find: takes requests (query_id, query, scopes, paths) and gives their ranked sections (see new_bundles); it is called for keys
    that are in neither table, and not at all if there are none. tasks are one call, in the order of task_id: what a key's first
    task finds or makes, its later tasks find as recent. A bundle's hits count the calls that found it in the table only. Afterwards
    the `recent` keys used last are held; those of this call are newer than all before, later tasks newer than earlier ones.
    """
    spark = store.spark
    was = store.latest()
    asked = requests(tasks, fingerprint, model, scopes, max_tokens)
    have = lambda name, schema: store.table(name, was) if name in was["tables"] else spark.createDataFrame([], schema)
    bundles, held = have("bundles", f"{BUNDLE}, hits long"), have("recent", f"{BUNDLE}, call long, place long")
    first = asked.groupBy("cache_key").agg(F.min_by(F.struct("bundle_id", "task", "query", "scopes", "paths", "max_tokens"), "task_id").alias("r"), F.max("task_id").alias("last"))
    marked = first.join(held.select("cache_key", F.lit(True).alias("in_recent")), "cache_key", "left").join(bundles.select("cache_key", F.lit(True).alias("in_table")), "cache_key", "left")
    source = F.when(F.col("in_recent"), "recent").when(F.col("in_table"), "table").otherwise("new")
    looked = marked.select("cache_key", "r.*", "last", source.alias("source"))
    missing = looked.where("source = 'new'").drop("source", "last")
    columns = [c.split(" ")[0] for c in BUNDLE.split(", ")]
    known = bundles
    if not missing.isEmpty():
        found = find(missing.select(F.col("bundle_id").alias("query_id"), "query", "scopes", "paths"))
        made = new_bundles(missing, found, fingerprint, model, at).withColumn("hits", F.lit(0).cast("long"))
        stamped = lambda df: df.withColumn("at", F.col("created_at"))
        known = bundle.put_bundles(stamped(bundles), stamped(made)).drop("at")
    store.commit({"bundles": bundle.use_bundles(known, looked.where("source = 'table'").select("cache_key")).select(*columns, "hits"), "looked": looked}, on=was)
    # from here on what was looked up and made is read, not computed
    now = store.latest()
    bundles, looked = store.table("bundles", now), store.table("looked", now)
    rows = held.select(*columns).unionByName(bundles.select(*columns)).dropDuplicates(["cache_key"])
    newest = looked.select("cache_key", "last").orderBy(F.desc("last"), "cache_key").limit(recent)
    place = F.row_number().over(Window.orderBy(F.desc("last"), "cache_key"))  # of `recent` rows at most
    used = rows.join(newest, "cache_key").withColumn("call", F.lit(now["version"]).cast("long")).withColumn("place", place.cast("long"))
    before = held.join(newest, "cache_key", "left_anti")
    both = used.select(*columns, "call", "place").unionByName(before.select(*columns, "call", "place"))
    store.commit({"recent": both.orderBy(F.desc("call"), "place").limit(recent)}, on=now)
    later = Window.partitionBy("cache_key").orderBy("task_id")
    each = asked.select("task_id", "cache_key", F.row_number().over(later).alias("n")).join(looked.select("cache_key", "source"), "cache_key")
    each = each.withColumn("source", F.when(F.col("n") > 1, "recent").otherwise(F.col("source"))).drop("n")
    return each.join(rows, "cache_key").select("task_id", "source", (F.col("source") != "new").alias("cached"), *columns)


def invalidate(store: Snapshots) -> int:
    """Drops every bundle, those used last too: for when what bundles say depends on more than the index, such as code drift."""
    was = store.latest()
    return store.commit({name: store.table(name, was).where("false") for name in ("bundles", "recent") if name in was["tables"]}, on=was)
