"""Context bundles: deduplicate and pack ranked sections, order by scope, render, shrink to the budget, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as T

# Sections alike from here on are one; candidates per bundle.
ALIKE, CANDIDATES = 0.85, 40
# Tokens that a bundle's head and each section's header count besides their own.
HEAD_EXTRA, SECTION_EXTRA = 4, 2


def scope_rank(scope: Column) -> Column:
    return F.when(scope == "domain", 0).when(scope == "conventions", 1).otherwise(2)


def _header() -> Column:
    return T.section_header(F.col("doc_path"), F.col("heading"), F.col("updated_at"), F.col("changes"), F.col("changed_at"))


def heads(tasks: DataFrame, fingerprint: str, max_tokens: int | None = None) -> DataFrame:
    """bundle_id, task, scopes, fingerprint, budget, head_cost of tasks (bundle_id, task, scopes and, without max_tokens, max_tokens).

    The budget is 95 % of max_tokens; head_cost is what a bundle of no sections takes, and 4.
    """
    most = F.col("max_tokens") if max_tokens is None else F.lit(max_tokens)
    named = tasks.select("bundle_id", "task", "scopes", F.lit(fingerprint).alias("fingerprint"), T.budget(most).alias("budget"))
    return named.withColumn("head_cost", T.token_count(_bundle(F.lit(0), F.lit(0), F.expr("cast(array() as array<string>)"))) + HEAD_EXTRA)


def pack(ranked: DataFrame, heads: DataFrame) -> DataFrame:
    """Per bundle_id: selected (rank, chunk_id in rank order), truncated, tokens (with the head's and the sections' overhead), room (for a cut section).

    ranked: bundle_id, rank, chunk_id, content, tokens, doc_path, heading, updated_at, changes, changed_at; heads: bundle_id, budget, head_cost.
    The head's cost stands at the start; a section costs its tokens, those of its header line, and 2. A section goes if it has the
    id, content or 85 % of the terms of a selected one, or does not fit; if none fits, the first is cut. One fold over at most 40
    candidates of a bundle, so a bundle's state is bounded.
    """
    top = ranked.where(F.col("rank") <= CANDIDATES)
    overhead = (T.token_count(_header()) + SECTION_EXTRA).alias("o")
    trimmed = F.regexp_replace("content", r"^\s+|\s+$", "")
    item = F.struct("rank", F.col("chunk_id").cast("string").alias("id"), F.sha2(trimmed, 256).alias("hash"), F.col("tokens").cast("long").alias("t"), overhead, T.term_set(F.col("content")).alias("terms"))
    lists = top.groupBy("bundle_id").agg(F.array_sort(F.collect_list(item)).alias("items")).join(heads.select("bundle_id", "budget", "head_cost"), "bundle_id")
    kept = "cast(array() as array<struct<rank:int,id:string,hash:string,terms:array<string>>>)"
    start = F.struct(F.col("head_cost").cast("long").alias("used"), F.expr(kept).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        twin = F.exists(s["kept"], lambda k: (k["id"] == x["id"]) | (k["hash"] == x["hash"]) | (T.jaccard(k["terms"], x["terms"]) >= ALIKE))
        cost = s["used"] + x["t"] + x["o"]
        take = (cost <= F.col("budget")) & ~twin
        one = F.struct(x["rank"].cast("int").alias("rank"), x["id"].alias("id"), x["hash"].alias("hash"), x["terms"].alias("terms"))
        return F.struct(F.when(take, cost).otherwise(s["used"]).alias("used"), F.when(take, F.array_append(s["kept"], one)).otherwise(s["kept"]).alias("kept"))

    done = lists.select("bundle_id", "budget", "head_cost", F.get("items", F.lit(0)).alias("first"), F.aggregate("items", start, step).alias("s"))
    room = F.col("budget") - F.col("head_cost") - F.col("first.o") - T.token_count(F.lit(T.CUT_MARK))
    cut = (F.size("s.kept") == 0) & (room >= T.LEAST_ROOM)
    picked = F.transform("s.kept", lambda k: F.struct(k["rank"].alias("rank"), k["id"].alias("chunk_id")))
    first = F.array(F.struct(F.col("first.rank").cast("int").alias("rank"), F.col("first.id").alias("chunk_id")))
    return done.select("bundle_id", F.when(cut, first).otherwise(picked).alias("selected"), cut.alias("truncated"), F.col("s.used").alias("tokens"), room.alias("room"))


def near_duplicates(sections: DataFrame, key: str, text: str, least: float = ALIKE) -> DataFrame:
    """a, b (a < b), jaccard of sections whose term sets are alike by at least `least`; those without terms are left out.

    Two such sets share one of the first n - ceil(least n) + 1 terms of each, in the order of rarity, so only these meet, and the ratio is
    computed on the pairs that have met. A term that many sections hold comes last and seldom counts among the first.
    """
    sets = sections.select(F.col(key).alias("id"), T.term_set(F.col(text)).alias("terms")).where(F.size("terms") > 0)
    each = sets.select("id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    rarity = each.groupBy("term").agg(F.count("*").alias("df"))
    heads = each.join(rarity, "term").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("l"))
    first = F.slice("l", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int"))
    heads = heads.select("id", "n", F.explode(first).alias("f")).select("id", "n", F.col("f.term").alias("term"))
    x, y = heads.alias("x"), heads.alias("y")
    sizes = F.expr(f"least(x.n, y.n) >= {least} * greatest(x.n, y.n) - 1e-9")
    met = x.join(y, F.expr("x.term = y.term and x.id < y.id")).where(sizes).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    left, right = (sets.select(F.col("id").alias(c), F.col("terms").alias(f"terms_{c}")) for c in "ab")
    return met.join(left, "a").join(right, "b").select("a", "b", T.jaccard(F.col("terms_a"), F.col("terms_b")).alias("jaccard")).where(F.col("jaccard") >= least)


def order(sections: DataFrame) -> DataFrame:
    """place in the bundle: domain, conventions, then the rest, by rank inside."""
    from pyspark.sql import Window

    return sections.withColumn("place", F.row_number().over(Window.partitionBy("bundle_id").orderBy(scope_rank(F.col("scope")), "rank", "chunk_id")))


def _section() -> Column:
    """One section as it stands in a bundle: its header and body."""
    return F.concat(F.lit("\n"), _header(), F.lit("\n\n"), T.body(F.col("content")), F.lit("\n"))


def _bundle(n: Column, tokens: Column, texts: Column) -> Column:
    """A bundle's text from the columns of heads, the number of its sections, their tokens and their texts."""
    head = F.concat(
        F.lit("<!-- context bundle "), F.col("bundle_id"), F.lit(" · "), n.cast("string"), F.lit(" section(s), ~"), tokens.cast("string"),
        F.lit(" tokens · scopes: "), F.array_join("scopes", ", "), F.lit(" · index "), F.col("fingerprint"), F.lit(" · task: "), T.one_line(F.col("task")), F.lit(" -->\n"),
    )
    return F.concat(head, F.when(n > 0, F.array_join(texts, "")).otherwise(F.lit("\n(no matching knowledge)\n")))


def render(sections: DataFrame, heads: DataFrame) -> DataFrame:
    """bundle_id, text: a comment line, then each section's header and body. Equal input gives equal bytes.

    sections: bundle_id, place, doc_path, heading, content, tokens, updated_at, changes, changed_at; heads: bundle_id, task,
    scopes, fingerprint.
    """
    parts = sections.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("place", _section().alias("text")))).alias("p"), F.count("*").alias("n"), F.sum("tokens").alias("t"))
    joined = heads.join(parts, "bundle_id", "left")
    texts = F.coalesce(F.transform("p", lambda x: x["text"]), F.expr("cast(array() as array<string>)"))
    return joined.select("bundle_id", _bundle(F.coalesce("n", F.lit(0)), F.coalesce("t", F.lit(0)), texts).alias("text"))


def shrink(sections: DataFrame, heads: DataFrame) -> DataFrame:
    """bundle_id, kept, text, tokens: the most leading ranks whose rendered text fits; if not even one does, the text of none.

    A bundle's sections (at most 40) are rendered once and move once; inside the row, prefixes are joined from the longest on
    until one fits, mostly the first. heads: as for render(), and budget.
    """
    item = F.struct(scope_rank(F.col("scope")).alias("s"), F.col("rank").cast("int").alias("rank"), F.col("chunk_id").cast("string").alias("id"), _section().alias("text"), F.col("tokens").cast("long").alias("t"))
    parts = sections.groupBy("bundle_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    none = F.expr("cast(array() as array<int>)")
    joined = heads.join(parts, "bundle_id", "left")
    joined = joined.withColumn("ranks", F.array_append(F.coalesce(F.sort_array(F.array_distinct(F.transform("p", lambda x: x["rank"])), asc=False), none), F.lit(0)))

    def cut(keep: Column) -> Column:
        kept = F.filter("p", lambda x: x["rank"] <= keep)
        text = F.when(keep > 0, _bundle(F.size(kept), F.aggregate(kept, F.lit(0).cast("long"), lambda t, x: t + x["t"]), F.transform(kept, lambda x: x["text"])))
        text = F.coalesce(text, _bundle(F.lit(0), F.lit(0), F.expr("cast(array() as array<string>)")))
        # an array of one, so that the text is made once
        return F.get(F.transform(F.array(text), lambda x: F.struct(keep.alias("keep"), x.alias("text"), T.token_count(x).cast("long").alias("tokens"))), F.lit(0))

    start = F.struct(F.lit(None).cast("int").alias("keep"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("tokens"))
    step = lambda s, keep: F.when((s["tokens"] <= F.col("budget")) & (s["keep"] > 0), s).otherwise(cut(keep))
    best = joined.select("bundle_id", F.aggregate("ranks", start, step).alias("b"))
    return best.select("bundle_id", F.col("b.keep").alias("kept"), F.col("b.text").alias("text"), F.col("b.tokens").alias("tokens"))


def compile_bundle(ranked: DataFrame, tasks: DataFrame, fingerprint: str, max_tokens: int | None = None) -> DataFrame:
    """bundle_id, kept, text, tokens, truncated for each task: pack, order, render, shrink to 95 % of max_tokens.

    ranked: bundle_id, rank, chunk_id, content, tokens, doc_path, heading, scope, updated_at, changes, changed_at; tasks:
    bundle_id, task, scopes and, without the argument, max_tokens. A task without sections gets a bundle that says so.
    """
    top = heads(tasks, fingerprint, max_tokens)
    packed = pack(ranked, top)
    chosen = packed.select("bundle_id", F.explode("selected").alias("s"), "truncated", "room").select("bundle_id", F.col("s.chunk_id").alias("chunk_id"), "truncated", "room")
    picked = ranked.withColumn("chunk_id", F.col("chunk_id").cast("string")).join(chosen, ["bundle_id", "chunk_id"])
    cut = F.concat(T.truncate(F.col("content"), F.col("room")), F.lit(T.CUT_MARK))
    picked = picked.withColumn("content", F.when(F.col("truncated"), cut).otherwise(F.col("content")))
    picked = picked.withColumn("tokens", F.when(F.col("truncated"), T.token_count(F.col("content"))).otherwise(F.col("tokens")))
    texts = shrink(picked.drop("truncated", "room"), top)
    return texts.join(packed.select("bundle_id", "truncated"), "bundle_id", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def put_bundles(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows (cache_key, bundle_id, at, ...): a row that is there stays, of new ones with one key the first by at and bundle_id."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*[c for c in cache.columns if c != "cache_key"])
    return both.groupBy("cache_key").agg(F.min_by(row, F.struct("_new", "at", "bundle_id")).alias("r")).select("cache_key", "r.*")


def use_bundles(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """The cache with its hits counted up: by one for each row of asked (cache_key) that it has."""
    times = asked.groupBy("cache_key").agg(F.count("*").alias("_times"))
    return cache.join(times, "cache_key", "left").withColumn("hits", F.col("hits") + F.coalesce("_times", F.lit(0))).select(cache.columns)


def prune_bundles(cache: DataFrame, fingerprint: str) -> DataFrame:
    return cache.where(F.col("fingerprint") == fingerprint)


def render_hits(hits: DataFrame) -> DataFrame:
    """query_id, text: numbered sections without their heading lines, after a line with the count."""
    one = F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("doc_path"), F.lit(" — "), F.col("heading"), F.lit("\n"), T.body(F.col("content"))).alias("text"))
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("l"), F.sum("tokens").alias("t"))
    head = F.concat(F.size("l").cast("string"), F.lit(" section(s), ~"), F.col("t").cast("string"), F.lit(" tokens\n\n"))
    return lists.select("query_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["text"]), "\n\n")).alias("text"))


def issue_bundle(issues: DataFrame, ranked: DataFrame, tasks: DataFrame, fingerprint: str, max_tokens: int) -> DataFrame:
    """bundle_id, text, tokens: the issue's text first, cut by lines to half the budget, then the rules that fit in the rest.

    issues: bundle_id, issue; the others as in compile_bundle. The whole stays within the budget of a plain bundle.
    """
    budget = max(1, int(max_tokens * T.BUDGET_SHARE))
    first = issues.select("bundle_id", T.truncate(F.col("issue"), F.lit(budget // 2)).alias("head"))
    rules = compile_bundle(ranked, tasks, fingerprint, max(1, int((budget - budget // 2 - 2) / T.BUDGET_SHARE)))
    both = first.join(rules.select("bundle_id", F.col("text").alias("rules")), "bundle_id", "left")
    text = F.concat_ws("\n\n", "head", "rules")
    return both.select("bundle_id", text.alias("text"), T.token_count(text).alias("tokens"))
