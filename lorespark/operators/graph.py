"""The link graph of a knowledge base: resolution, degrees, orphans, broken links, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.mentions import document_names, mentions, plain_text
from lorespark.sources.written import written

# Fixed value: a document with more links out is over-linked.
OVER_LINKED = 12


def clean_path(path: Column) -> Column:
    """Without empty and . parts; .. takes the part before it away."""
    empty = F.expr("cast(array() as array<string>)")
    step = lambda done, part: F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0), F.slice(done, 1, F.size(done) - 1)).otherwise(F.array_append(done, part))
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def resolve_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """links (from_path, target, kind) with to_path; empty where nothing fits.

    A Markdown link is relative to its file. A wiki link with a slash is tried as given, with .md, relative, relative with
    .md; then its base name anywhere, the shortest path first, then by name. Each way is an equi join.
    """
    folder = F.regexp_extract("from_path", r"^(.*)/[^/]*$", 1)
    relative = clean_path(F.concat_ws("/", folder, F.trim("target")))
    t = F.trim("target")
    slash = t.contains("/")
    ways = F.when(F.col("kind") == "markdown", F.array(relative)).when(slash, F.array(t, F.concat(t, F.lit(".md")), relative, F.concat(relative, F.lit(".md")))).otherwise(F.expr("cast(array() as array<string>)"))
    key = ["from_path", "target", "kind"]
    asked = links.select(*key).distinct()
    tries = asked.select(*key, F.posexplode(ways).alias("way", "path"))
    exact = tries.join(paths.select("path"), "path").groupBy(*key).agg(F.min_by("path", "way").alias("exact"))
    base = lambda p: F.lower(F.regexp_replace(F.regexp_extract(p, r"([^/]*)$", 1), r"\.md$", ""))
    named = paths.groupBy(base(F.col("path")).alias("_base")).agg(F.min(F.struct(F.octet_length("path").alias("n"), "path")).alias("p")).select("_base", F.col("p.path").alias("named"))
    # only wiki links without an exact path ask for a name; the others have keys of their own, which no name is, so that they do not meet in one task
    asks = F.col("exact").isNull() & (F.col("kind") != "markdown")
    alone = F.concat(F.lit("/"), F.xxhash64(*key).cast("string"))
    found = links.join(exact, key, "left").withColumn("_base", F.coalesce(F.when(asks, base(t)), alone)).join(named, "_base", "left")
    return found.select(*links.columns, F.coalesce("exact", "named", F.lit("")).alias("to_path"))


def edges(links: DataFrame) -> DataFrame:
    return links.where("to_path <> '' and from_path <> to_path").select("from_path", "to_path").distinct()


def link_graph(paths: DataFrame, links: DataFrame) -> DataFrame:
    """path, links_in, links_out (distinct, without self links and broken ones), orphan (none in), over_linked."""
    e = edges(links)
    into = e.groupBy(F.col("to_path").alias("path")).agg(F.count("*").alias("i"))
    out = e.groupBy(F.col("from_path").alias("path")).agg(F.count("*").alias("o"))
    both = paths.select("path").join(into, "path", "left").join(out, "path", "left")
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    return both.select("path", i.alias("links_in"), o.alias("links_out"), (i == 0).alias("orphan"), (o > OVER_LINKED).alias("over_linked"))


def orphans(paths: DataFrame, links: DataFrame) -> DataFrame:
    return paths.select("path").join(edges(links).select(F.col("to_path").alias("path")), "path", "left_anti")


def broken_links(links: DataFrame) -> DataFrame:
    return links.where("to_path = ''").select("from_path", "target").distinct()


def links_of(links: DataFrame, path: str) -> DataFrame:
    """direction (out, back) and path of a document's links."""
    e = edges(links)
    out = e.where(F.col("from_path") == path).select(F.lit("out").alias("direction"), F.col("to_path").alias("path"))
    return out.union(e.where(F.col("to_path") == path).select(F.lit("back"), "from_path"))


def ignore_links(ignored: DataFrame, new: DataFrame) -> DataFrame:
    """The pairs (from_path, to_path) that are not to be suggested, with new ones; each once."""
    return ignored.select("from_path", "to_path").union(new.select("from_path", "to_path")).distinct()


def clear_ignored(ignored: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The pairs that stay ignored: none, or with paths (path) those that start at none of these."""
    return ignored.where("false") if paths is None else ignored.join(paths.select(F.col("path").alias("from_path")), "from_path", "left_anti").select("from_path", "to_path")


def leading(counted: DataFrame, names: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Of counted (from_path, name, mentions) the rows that the first `limit` suggestions can come from. Pairs of documents are not made for it.

    A row suggests something for sure if more documents have its name than its own document, and than pairs of it are known. The first `limit` documents
    with such a row, by mentions and path, give as many suggestions, so rows that come later than all of these are not needed.
    """
    holders = names.select("name", "to_path").distinct().groupBy("name").agg(F.count("*").alias("h"), F.min("to_path").alias("one"))
    held = counted.join(holders, "name").where("h > 1 or one <> from_path")
    taken = known.groupBy("from_path").agg(F.count("*").alias("taken"))
    sure = held.join(taken, "from_path", "left").where(F.greatest(F.col("h") - 1, F.lit(1)) > F.coalesce("taken", F.lit(0)))
    first = sure.groupBy("from_path").agg(F.max("mentions").alias("m")).orderBy(F.desc("m"), "from_path").limit(limit)
    n, last = first.agg(F.count("*"), F.max(F.struct((-F.col("m")).alias("m"), "from_path"))).first()
    held = held.select(*counted.columns)
    return held.where((F.col("mentions") > -last.m) | ((F.col("mentions") == -last.m) & (F.col("from_path") <= last.from_path))) if n and n == limit else held


def suggest_links(docs: DataFrame, links: DataFrame, ignored: DataFrame, limit: int) -> DataFrame:
    """from_path, to_path, name, mentions: documents that name another without a link either way.

    docs: path, title, body. All names are looked for in one scan of each text (see mentions()); heading lines do not count. Only
    counts that the first `limit` suggestions can come from (see leading()) are joined with the documents that have a name, as many
    documents may share one and all name each other. The best name of a pair is the most frequent, then the first.
    """
    names = document_names(docs)
    texts = docs.select("path", plain_text(F.col("body")).alias("text"))
    counted = written(mentions(texts, names).withColumnRenamed("path", "from_path"))
    e = edges(links)
    known = e.union(e.select("to_path", "from_path")).union(ignored.select("from_path", "to_path")).distinct()
    pairs = leading(counted, names, known, limit).join(names, "name").where("from_path <> to_path")
    best = pairs.groupBy("from_path", "to_path").agg(F.min(F.struct((-F.col("mentions")).alias("m"), "which", "name")).alias("b"))
    open_ = best.join(known, ["from_path", "to_path"], "left_anti").select("from_path", "to_path", F.col("b.name").alias("name"), (-F.col("b.m")).alias("mentions"))
    return open_.orderBy(F.desc("mentions"), "from_path", "to_path").limit(limit)
