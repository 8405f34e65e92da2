"""Registered queries of the retrieval engine over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import bench, bundle, compile, evaluation, graph, index, ingest, logs, retrieval, staleness
from lorespark.plans import tables as D
from lorespark.sources.snapshots import Snapshots
from lorespark.sources.written import shared_folder, written
from lorespark.streaming import state

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
TOP = 10


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query(f"SELECT lang, count(*) AS documents, CAST(sum({D.sql_tokens('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_stats(s, d):
    return D.table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(T.token_count(F.col("text"))).alias("tokens"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({D.sql_terms('text')}) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 100")
def terms_topn(s, d):
    return D.table(s, d, "documents").select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query(f"WITH {D.CHUNKS} SELECT lang AS scope, count(DISTINCT d.doc_id) AS documents, count(c.chunk_id) AS chunks, CAST(coalesce(sum(c.tokens), 0) AS BIGINT) AS tokens FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY lang")
def scope_stats(s, d):
    return ingest.scope_stats(D.chunks(s, d), D.table(s, d, "documents").select("doc_id", F.col("lang").alias("scope")))


_VECTOR = f"""WITH {D.QUERY_VECTORS}, scored AS (
  SELECT query_id, vec_id AS chunk_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 6) AS score
  FROM embeddings e, qv {{where}}
) SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10"""


@query(_VECTOR.format(where=""))
def vector_topk(s, d):
    return retrieval.vector_topk(D.vectors(s, d), D.query_vectors(s, d).drop("scopes"), TOP)


@query(_VECTOR.format(where="WHERE e.label IN (qv.label, qv.label + 1)"))
def vector_topk_scoped(s, d):
    return retrieval.vector_topk(D.vectors(s, d), D.query_vectors(s, d), TOP, scoped=True)


def _bm25_sql(chunks: str, limit: int, scoped: bool) -> str:
    scope = "JOIN chunks c USING (chunk_id) JOIN queries q USING (query_id) WHERE list_contains(q.scopes, c.scope)" if scoped else ""
    return f"""{D.QUERIES}, {chunks}, words AS (
  SELECT chunk_id, unnest({D.sql_words('content')}) AS term FROM chunks
), dl AS (SELECT chunk_id, count(*) AS dl FROM words GROUP BY chunk_id
), st AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT count(*) FROM words) / (SELECT count(*) FROM chunks) AS avgdl
), tf AS (SELECT chunk_id, term, count(*) AS f FROM words GROUP BY ALL
), asked AS (SELECT query_id, term, count(*) AS times, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT query_id, unnest({D.sql_terms('query')}) AS term FROM queries) GROUP BY query_id, term
), rarity AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, avgdl FROM tf, st WHERE term IN (SELECT term FROM asked) GROUP BY term, n, avgdl
), s AS (
  SELECT query_id, chunk_id, sum(times * (CASE WHEN idf <= 0 THEN 0.000001 ELSE idf END) * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)))) AS raw, count(*) = max(n_terms) AS all_terms
  FROM asked JOIN rarity USING (term) JOIN tf USING (term) JOIN dl USING (chunk_id) GROUP BY query_id, chunk_id
), scored AS (SELECT query_id, chunk_id, round(raw, 6) AS score, all_terms FROM s {scope}
), bm25 AS (
  SELECT query_id, chunk_id, score, all_terms, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY all_terms DESC, score DESC, chunk_id) AS rank FROM scored) WHERE rank <= {limit}
)"""


_WHOLE = f"chunks AS (SELECT doc_id AS chunk_id, doc_id, lang AS scope, 0 AS position, text AS content, {D.sql_tokens('text')} AS tokens FROM documents)"


@query(f"WITH {_bm25_sql(D.CHUNKS, 10, False)} SELECT * FROM bm25")
def bm25_topk(s, d):
    return retrieval.bm25(D.chunks(s, d), D.queries(s, d), TOP)


@query(f"WITH {_bm25_sql(_WHOLE, 30, True)} SELECT * FROM bm25")
def bm25_and_first(s, d):
    return retrieval.bm25(D.whole(s, d), D.queries(s, d), 3 * TOP, scoped=True)


@query()
def bm25_stemmed(s, d):
    return retrieval.bm25(D.whole(s, d), D.queries(s, d), TOP, stem=True)


def _hybrid(s, d):
    lexical = retrieval.bm25(D.whole(s, d), D.queries(s, d), retrieval.FUSION_DEPTH)
    return retrieval.hybrid(lexical, retrieval.vector_topk(D.vectors(s, d), D.query_vectors(s, d).drop("scopes"), retrieval.FUSION_DEPTH))


_VEC50 = """vs AS (
  SELECT query_id, vec_id AS chunk_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 6) AS score FROM embeddings, qv
), vec AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs) WHERE rank <= 50)"""
_PARTS = """parts AS (
  SELECT query_id, chunk_id, (CASE WHEN all_terms THEN 1.0 ELSE 0.25 END)::DOUBLE / (60 + rank) AS s FROM bm25
  UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) FROM vec
), fused AS (SELECT query_id, chunk_id, round(sum(s), 9) AS score FROM parts GROUP BY ALL
), hybrid AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM fused)"""
_FUSED = f"{_bm25_sql(_WHOLE, 50, False)}, {D.QUERY_VECTORS}, {_VEC50}, {_PARTS}"


@query(f"WITH {_FUSED} SELECT * FROM hybrid")
def rrf_hybrid(s, d):
    return _hybrid(s, d)


@query(f"""WITH {_bm25_sql(_WHOLE, 50, True)}, {D.QUERY_VECTORS}, vs AS (
  SELECT qv.query_id, vec_id AS chunk_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 6) AS score
  FROM embeddings e, qv JOIN queries q USING (query_id) WHERE list_contains(q.scopes, ['de', 'en', 'es', 'fr'][e.label % 4 + 1])
), vec AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs) WHERE rank <= 50), {_PARTS}
SELECT * FROM hybrid""")
def rrf_hybrid_scoped(s, d):
    queries = D.queries(s, d)
    vectors = D.vectors(s, d).withColumn("scope", F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("scope") % 4 + 1))
    asked = D.query_vectors(s, d).drop("scopes").join(queries.select("query_id", "scopes"), "query_id")
    lexical = retrieval.bm25(D.whole(s, d), queries, retrieval.FUSION_DEPTH, scoped=True)
    return retrieval.hybrid(lexical, retrieval.vector_topk(vectors, asked, retrieval.FUSION_DEPTH, scoped=True))


@query(f"""WITH {_FUSED}, sections AS (
  SELECT DISTINCT q.query_id, source AS doc, doc_id AS chunk_id FROM queries q JOIN documents ON source = 'src' || q.query_id % 20
), listed AS (
  SELECT query_id, chunk_id, doc, row_number() OVER (PARTITION BY query_id, doc ORDER BY rank IS NULL, rank, chunk_id) AS i FROM sections LEFT JOIN hybrid USING (query_id, chunk_id)
), placed AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY doc, i) AS rank FROM listed WHERE i <= 3
), again AS (
  SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS s FROM hybrid UNION ALL SELECT query_id, chunk_id, 1.5::DOUBLE / (60 + rank) FROM placed WHERE rank <= 6
), summed AS (SELECT query_id, chunk_id, round(sum(s), 9) AS score FROM again GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM summed""")
def governed_rerank(s, d):
    docs = D.table(s, d, "documents")
    chunks = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.lit(0).alias("position"))
    asked = D.queries(s, d).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("doc"))
    return retrieval.governed(_hybrid(s, d), asked, chunks)


@query(f"""WITH {D.QUERY_VECTORS}, {_VEC50}, l AS (SELECT query_id, list(vs.score ORDER BY rank) AS x FROM vec JOIN vs USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, x[1] AS top, round(x[1] - x[len(x) // 2 + 1], 6) AS margin FROM l""")
def confidence_margin(s, d):
    return retrieval.margin(retrieval.vector_topk(D.vectors(s, d), D.query_vectors(s, d).drop("scopes"), retrieval.FUSION_DEPTH))


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, {D.sql_tokens('text')} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations
), f AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS omitted, CAST([] AS BIGINT[]) AS ids FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL
  SELECT f.conv_id, t.i, CASE WHEN len(ids) < 4 AND used + tokens <= 300 THEN used + tokens ELSE used END, CASE WHEN len(ids) < 4 AND used + tokens > 300 THEN omitted + 1 ELSE omitted END,
         CASE WHEN len(ids) < 4 AND used + tokens <= 300 THEN list_append(ids, turn) ELSE ids END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1
) SELECT conv_id, array_to_string(ids, ',') AS picked, used AS tokens, omitted FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1""")
def budget_fill(s, d):
    turns = D.table(s, d, "conversations").select("conv_id", "turn", T.token_count(F.col("text")).alias("tokens"))
    filled = retrieval.budget_fill(turns, "conv_id", "turn", "tokens", "turn", 300, 4)
    return filled.withColumn("picked", F.array_join(F.col("picked").cast("array<string>"), ","))


def _bundles(s, d):
    """Turns of conversations as ranked sections of a bundle."""
    t = D.table(s, d, "conversations")
    return t.select(
        F.col("conv_id").cast("string").alias("bundle_id"), F.col("turn").cast("int").alias("rank"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("text").alias("content"),
        T.token_count(F.col("text")).alias("tokens"), F.concat(F.lit("domain/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("doc_path"), F.col("role").alias("heading"),
        F.when(F.col("role") == "user", "domain").when(F.col("turn") % 3 == 0, "conventions").otherwise("projects/x").alias("scope"), F.expr("timestamp'2024-01-02 03:04:05'").alias("updated_at"),
        (F.col("turn") % 3).cast("int").alias("changes"), F.expr("timestamp'2024-02-03 00:00:00'").alias("changed_at"),
    )


def _tasks(s, d):
    """The first turn of each conversation as its task."""
    return D.table(s, d, "conversations").where("turn = 0").select(F.col("conv_id").cast("string").alias("bundle_id"), F.col("text").alias("task"), F.array(F.lit("conventions"), F.lit("domain")).alias("scopes"))


_FLAT = r"replace(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '--', '—')"
_PACK = rf"""WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CAST(conv_id * 1000 + turn AS VARCHAR) AS id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content, list_distinct({D.sql_terms('text')}) AS terms,
         {D.sql_tokens('text')} AS tokens, {D.sql_tokens("header")} + 2 AS overhead
  FROM (SELECT *, '## domain/' || conv_id || '.md — ' || role || ' (updated 2024-01-02' || CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '; code changed since: 1 commit, last 2024-02-03' ELSE '; code changed since: 2 commits, last 2024-02-03' END || ')' AS header FROM conversations) WHERE turn <= 40
), h AS (
  SELECT conv_id, {D.sql_tokens("head")} + 4 AS cost
  FROM (SELECT conv_id, '<!-- context bundle ' || conv_id || ' · 0 section(s), ~0 tokens · scopes: conventions, domain · index 0123456789abcdef · task: ' || CASE WHEN length({_FLAT}) > 120 THEN substr({_FLAT}, 1, 119) || '…' ELSE {_FLAT} END
        || ' -->' || chr(10) || chr(10) || '(no matching knowledge)' || chr(10) AS head FROM conversations WHERE turn = 0)
), f AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, cost AS used, CAST([] AS STRUCT(id VARCHAR, content VARCHAR, terms VARCHAR[])[]) AS kept FROM h
  UNION ALL
  SELECT conv_id, i, CASE WHEN take THEN used + tokens + overhead ELSE used END, CASE WHEN take THEN list_append(kept, {{'id': id, 'content': content, 'terms': terms}}) ELSE kept END
  FROM (SELECT f.conv_id, t.i, used, kept, id, content, terms, tokens, overhead,
               used + tokens + overhead <= 399 AND len(list_filter(kept, lambda k: k.content = content OR CASE WHEN len(k.terms) + len(terms) = 0 THEN true
                 ELSE len(list_intersect(k.terms, terms)) / (len(k.terms) + len(terms) - len(list_intersect(k.terms, terms))) >= 0.85 END)) = 0 AS take
        FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
), done AS (
  SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
)
SELECT CAST(done.conv_id AS VARCHAR) AS bundle_id, used AS tokens, len(kept) = 0 AND 399 - cost - t.overhead - {D.sql_tokens("chr(10) || '[… truncated]'")} >= 40 AS truncated,
       CASE WHEN len(kept) = 0 AND 399 - cost - t.overhead - {D.sql_tokens("chr(10) || '[… truncated]'")} >= 40 THEN t.id ELSE array_to_string(list_transform(kept, lambda k: k.id), ',') END AS selected
FROM done JOIN h ON h.conv_id = done.conv_id JOIN t ON t.conv_id = done.conv_id AND t.i = 1"""


@query(_PACK)
def bundle_pack(s, d):
    packed = bundle.pack(_bundles(s, d), bundle.heads(_tasks(s, d), "0123456789abcdef", 420))
    return packed.select("bundle_id", F.array_join(F.transform("selected", lambda x: x["chunk_id"]), ",").alias("selected"), "truncated", "tokens")


def _sections(s, d):
    """Lines of documents as sections of a knowledge base."""
    path = F.concat(F.lit("domain/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return D.chunks(s, d).select("chunk_id", path.alias("doc_id"), path.alias("doc_path"), F.concat(F.lit("line "), F.col("position").cast("string")).alias("heading"), "scope", "position", "content", "tokens")


def _store(s):
    return Snapshots(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}")


@query()
def bundles_of_tasks(s, d):
    """From task texts to bundles: look-up, retrieval, packing, store. Every third task is asked twice."""
    asked = D.queries(s, d).select(F.col("query_id").alias("task_id"), F.col("query").alias("task"), "scopes")
    asked = asked.union(asked.where("task_id % 3 = 0").withColumn("task_id", F.col("task_id") + 1_000_000))
    made = compile.compile_tasks(_store(s), asked, compile.finder(_sections(s, d)), "0123456789abcdef")
    return made.select("task_id", "source", "cached", "cache_key", "bundle_id", "content", "tokens", F.size("sections").alias("sections"), "truncated")


@query()
def bundle_bench(s, d):
    """Benchmark texts as golden queries; a document is expected whose number ends as theirs does."""
    paths = D.table(s, d, "documents").select(F.concat(F.lit("domain/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), (F.col("doc_id") % 100).alias("k"))
    expected = paths.groupBy("k").agg(F.collect_list(F.struct("path", F.lit(None).cast("string").alias("heading"))).alias("expected"))
    golden = D.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), (F.col("item_id") % 100).alias("k")).join(expected, "k").drop("k")
    return bench.bench(_store(s), _sections(s, d), golden, compile.finder(_sections(s, d)), "0123456789abcdef", (2000, 500), ["domain/7.md", "domain/12.md"])


@query()
def bundle_compile(s, d):
    return bundle.compile_bundle(_bundles(s, d), _tasks(s, d), "0123456789abcdef", 1000)


@query("""SELECT CAST(conv_id AS VARCHAR) AS bundle_id, conv_id * 1000 + turn AS chunk_id,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 0 WHEN turn % 3 = 0 THEN 1 ELSE 2 END, turn, conv_id * 1000 + turn) AS INT) AS place FROM conversations""")
def bundle_order(s, d):
    return bundle.order(_bundles(s, d)).select("bundle_id", "chunk_id", "place")


@query(f"""WITH t AS (SELECT item_id, list_sort(list_distinct({D.sql_terms('text')})) AS terms FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))), 6) AS jaccard
FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))) >= 0.05""")
def near_duplicates(s, d):
    found = bundle.near_duplicates(D.table(s, d, "benchmark"), "item_id", "text", 0.05)
    return found.withColumn("jaccard", F.round("jaccard", 6))


@query("""SELECT item_id, sha256('v2' || chr(0) || text || chr(0) || 'conventions,domain' || chr(0) || '2000' || chr(0) || 'f00d' || chr(0) || 'hash-64' || chr(0) || 'a/b.go' || chr(1) || 'c.go') AS cache_key FROM benchmark""")
def cache_key(s, d):
    scopes = T.normalized_list(F.array(F.lit(" domain"), F.lit("conventions "), F.lit("domain"), F.lit("")))
    paths = T.normalized_paths(F.array(F.lit("./c.go"), F.lit("a\\b.go"), F.lit("c.go")))
    return D.table(s, d, "benchmark").select("item_id", T.cache_key(F.col("text"), scopes, F.lit(2000), F.lit("f00d"), F.lit("hash-64"), paths).alias("cache_key"))


def _snapshot(s, d):
    return D.table(s, d, "documents").select(F.concat(F.lit("domain/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("content_hash"), "doc_id")


@query("SELECT substr(sha256(string_agg('domain/' || doc_id || '.md' || chr(0) || sha256(text) || chr(10), '' ORDER BY 'domain/' || doc_id || '.md')), 1, 16) AS fingerprint FROM documents")
def index_fingerprint(s, d):
    return ingest.fingerprint(_snapshot(s, d))


@query("""WITH now AS (SELECT 'domain/' || doc_id || '.md' AS path, sha256(text) AS h, doc_id FROM documents WHERE doc_id % 11 <> 0),
old AS (SELECT 'domain/' || doc_id || '.md' AS path, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 0)
SELECT path, CASE WHEN old.h IS NULL THEN 'new' WHEN now.h IS NULL THEN 'deleted' WHEN old.h = now.h THEN 'same' ELSE 'changed' END AS status FROM now FULL JOIN old USING (path)""")
def incremental_diff(s, d):
    now = _snapshot(s, d)
    old = now.where("doc_id % 10 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("content_hash")))
    return ingest.reconcile(now.where("doc_id % 11 <> 0"), old)


@query("""SELECT doc_id AS chunk_id, sha256(source || chr(10) || text) AS text_hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def pending_vectors(s, d):
    docs = D.table(s, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_path"), F.lit(0).alias("position"), F.col("source").alias("heading"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"))
    have = D.vectors(s, d).select("chunk_id").join(chunks.select("chunk_id", "content_hash"), "chunk_id")
    have = have.withColumn("content_hash", F.when(F.col("chunk_id") % 3 == 0, "stale").otherwise(F.col("content_hash"))).withColumn("model", F.when(F.col("chunk_id") % 5 == 0, "other").otherwise("hash-64"))
    return ingest.pending_vectors(chunks, have, "hash-64").select("chunk_id", F.sha2("text", 256).alias("text_hash"))


@query("""SELECT doc_id, sha256(string_agg(content, chr(10) || chr(10) ORDER BY position)) AS text_hash FROM (
  SELECT doc_id, unnest(str_split(text, chr(10))) AS content, unnest(range(len(str_split(text, chr(10))))) AS position FROM documents) WHERE trim(content, ' ') <> '' GROUP BY doc_id""")
def reassemble(s, d):
    return ingest.reassemble(D.chunks(s, d).withColumnRenamed("doc_id", "doc_path")).select(F.col("doc_path").alias("doc_id"), F.sha2("text", 256).alias("text_hash"))


@query()
def html_to_markdown(s, d):
    from lorespark.sources.markup import html_to_markdown as convert

    return convert(D.table(s, d, "pages"))


@query()
def chunk_documents(s, d):
    return ingest.chunk_documents(D.markdown(s, d))


@query(f"""SELECT 'domain/' || doc_id || '.md' AS from_path, CAST(i AS INT) AS position, t AS target, k AS kind FROM documents, (VALUES (0, 'wikilink'), (1, 'markdown')) v(i, k),
  LATERAL (SELECT CASE WHEN k = 'wikilink' THEN source ELSE '../' || lang || '/a.md' END AS t)""")
def extract_links(s, d):
    return ingest.extract_links(D.linked_bodies(s, d))


@query(f"WITH {D.LINKS} SELECT from_path, target, kind, to_path FROM links")
def resolve_links(s, d):
    return graph.resolve_links(D.part_links(s, d), D.part_paths(s, d))


@query(f"""WITH {D.LINKS}, i AS (SELECT to_path AS path, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT from_path AS path, count(*) AS n FROM edges GROUP BY 1)
SELECT path, coalesce(i.n, 0) AS links_in, coalesce(o.n, 0) AS links_out, coalesce(i.n, 0) = 0 AS orphan, coalesce(o.n, 0) > 12 AS over_linked FROM paths LEFT JOIN i USING (path) LEFT JOIN o USING (path)""")
def link_graph(s, d):
    return graph.link_graph(D.part_paths(s, d), graph.resolve_links(D.part_links(s, d), D.part_paths(s, d)))


@query(f"WITH {D.LINKS} SELECT path FROM paths WHERE path NOT IN (SELECT to_path FROM edges)")
def orphans(s, d):
    return graph.orphans(D.part_paths(s, d), graph.resolve_links(D.part_links(s, d), D.part_paths(s, d)))


@query(f"WITH {D.LINKS} SELECT DISTINCT from_path, target FROM links WHERE to_path = ''")
def broken_links(s, d):
    return graph.broken_links(graph.resolve_links(D.part_links(s, d), D.part_paths(s, d)))


@query(rf"""WITH docs AS (
  SELECT 'domain/' || source || '-' || doc_id || '.md' AS path, source || '-' || doc_id AS base, array_to_string(str_split(str_split(text, chr(10))[1], ' ')[1:3], ' ') AS title,
         lower(regexp_replace(text, '(?m)^\s*#[^\n]*$', '', 'g')) AS body FROM documents
), listed AS (
  SELECT path, [lower(trim(title)), lower(trim(regexp_extract(title, '^([^:(]+)[:(]', 1))), lower(trim(replace(base, '-', ' ')))] AS l FROM docs
), names AS (
  SELECT path, unnest(l) AS name, unnest(range(3)) AS which FROM listed
), kept AS (
  SELECT path, name, min(which) AS which FROM names WHERE strlen(name) >= 5 AND name NOT IN ('readme', 'index', 'overview', 'notes', 'glossary', 'introduction') GROUP BY ALL
), asked AS (
  SELECT DISTINCT name, regexp_extract(name, '[0-9a-z_]+') AS word FROM kept
), words AS (
  SELECT path, unnest(list_distinct(regexp_extract_all(body, '[0-9a-z_]+'))) AS word FROM docs
), near AS (
  SELECT path, name FROM words JOIN asked USING (word) UNION ALL SELECT path, name FROM docs JOIN asked ON word = '' AND contains(body, name)
), met AS (
  SELECT path AS from_path, name, len(regexp_extract_all(body, '\b' || regexp_escape(name) || '\b')) AS mentions FROM near JOIN docs USING (path) WHERE contains(body, name)
)
SELECT from_path, path AS to_path, name, mentions FROM met JOIN kept USING (name) WHERE mentions > 0 AND from_path <> path
QUALIFY row_number() OVER (PARTITION BY from_path, path ORDER BY mentions DESC, which, name) = 1 ORDER BY mentions DESC, from_path, to_path LIMIT 100""")
def link_suggestions(s, d):
    docs = D.table(s, d, "documents")
    docs = docs.select(F.concat(F.lit("domain/"), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat_ws(" ", F.slice(F.split(F.split("text", "\n")[0], " "), 1, 3)).alias("title"), F.col("text").alias("body"))
    none = docs.select(F.col("path").alias("from_path"), F.col("path").alias("to_path")).where(F.lit(False))
    return graph.suggest_links(docs, none, none, 100)


_MATCHED = f"""{D.SOURCES}, hit AS (
  SELECT DISTINCT s.path, c.hash, c.ts, c.code_path FROM (SELECT path, updated_at, unnest(patterns) AS p FROM sources) s JOIN commits c ON c.ts > s.updated_at AND regexp_matches(c.code_path, s.p)
)"""


@query(f"""WITH {_MATCHED}, per AS (SELECT path, hash, ts, min(code_path) AS code_path FROM hit GROUP BY ALL)
SELECT path, count(*) AS commits, max(ts) AS last_change, arg_min(code_path, (-epoch_us(ts), hash)) AS last_path FROM per GROUP BY path""")
def drift(s, d):
    return staleness.drift(D.sources(s, d), D.commits(s, d))


@query(f"""WITH {D.SOURCES}, dirs AS (
  SELECT DISTINCT dir FROM (SELECT unnest([split_part(code_path, '/', 1), CASE WHEN code_path LIKE '%/%/%' THEN split_part(code_path, '/', 1) || '/' || split_part(code_path, '/', 2) END]) AS dir FROM commits) WHERE dir IS NOT NULL
), hit AS (SELECT DISTINCT dir FROM dirs, (SELECT unnest(patterns) AS p FROM sources) WHERE regexp_matches(dir, p) OR regexp_matches(dir || '/file', p))
SELECT (SELECT count(*) FROM hit) AS covered, (SELECT count(*) FROM dirs) AS total, coalesce((SELECT string_agg(dir, ',' ORDER BY dir) FROM dirs WHERE dir NOT IN (SELECT dir FROM hit)), '') AS uncovered""")
def coverage(s, d):
    paths = D.commits(s, d).select(F.explode("paths").alias("code_path")).distinct()
    return staleness.coverage(staleness.directories(paths, 2), D.sources(s, d))


@query(f"""WITH {D.SOURCES} SELECT DISTINCT o_orderkey AS query_id, s.path FROM orders JOIN commits c ON c.hash = o_orderkey JOIN (SELECT path, unnest(patterns) AS p FROM sources) s ON regexp_matches(c.code_path, s.p)""")
def governing(s, d):
    return staleness.governing(D.sources(s, d), D.commits(s, d).select(F.col("hash").alias("query_id"), F.explode("paths").alias("code_path")))


@query(f"WITH {D.SOURCES} SELECT path, updated_at FROM sources WHERE updated_at IS NOT NULL ORDER BY updated_at, path LIMIT 10")
def stalest(s, d):
    return staleness.stalest(D.sources(s, d), 10).select("path", "updated_at")


@query("SELECT code_path AS path, max(o_orderdate) AS last_modified FROM (SELECT o_orderdate, unnest(['svc' || o_custkey % 25 || '/' || replace(o_orderpriority, ' ', '-') || '/main.go', 'doc/' || o_orderstatus || '.txt']) AS code_path FROM orders) GROUP BY 1")
def last_modified(s, d):
    from lorespark.sources.markdown import last_modified as latest

    return latest(D.commits(s, d))


_GAP_COLUMNS = "count(*) AS times, max(ts) AS last_at, max(name) AS name, max(results) AS results, max(top_score) AS top_score, max(margin) AS margin"


@query(f"""WITH {D.LOG}, r AS (SELECT bundle_id, max(CAST(useful AS INT)) AS useful FROM usage GROUP BY 1)
SELECT query, scopes, {_GAP_COLUMNS}, CASE WHEN max(results) = 0 THEN 'no_results' ELSE 'not_useful' END AS reason FROM log LEFT JOIN r USING (bundle_id)
WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND (results = 0 OR r.useful = 0) GROUP BY query, scopes ORDER BY times DESC, last_at DESC, query, scopes LIMIT 20""")
def gaps_no_useful(s, d):
    return logs.gaps_no_useful(D.log(s, d), D.usage(s, d), F.expr("timestamp_ntz'2024-01-24 00:00:00'"), 20)


@query(f"""WITH {D.LOG} SELECT query, scopes, {_GAP_COLUMNS} FROM log WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND results > 0 AND top_score > 0
GROUP BY query, scopes ORDER BY margin, last_at DESC, query, scopes LIMIT 20""")
def gaps_low_confidence(s, d):
    return logs.gaps_low_confidence(D.log(s, d), F.expr("timestamp_ntz'2024-01-24 00:00:00'"), 20)


@query("SELECT count(*) AS entries, min(ts) AS oldest FROM events")
def log_stats(s, d):
    return logs.log_stats(D.log(s, d))


_HISTOGRAM = ", ".join(f"CAST(count_if(seconds <= {b}) AS BIGINT) AS le_{i}" for i, b in enumerate(logs.BOUNDS))


@query(f"""WITH {D.REQUESTS} SELECT surface, name, count(*) AS requests, CAST(count_if(error) AS BIGINT) AS errors, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(chunks) AS BIGINT) AS chunks,
CAST(sum(omitted) AS BIGINT) AS omitted, round(sum(seconds), 6) AS seconds, {_HISTOGRAM}, count(*) AS le_12 FROM requests GROUP BY surface, name""")
def latency_histogram(s, d):
    return logs.series(D.requests(s, d))


_LAST = "SELECT *, row_number() OVER (PARTITION BY surface, name ORDER BY ts DESC, event_id DESC) AS place FROM requests"


@query(f"""WITH {D.REQUESTS}, l AS (SELECT surface, name, list(seconds ORDER BY seconds) AS x FROM ({_LAST}) WHERE place <= 512 GROUP BY ALL)
SELECT surface, name, round(x[CAST(floor(0.5 * (len(x) - 1) + 0.5) AS INT) + 1] * 1000, 6) AS p50_ms, round(x[CAST(floor(0.95 * (len(x) - 1) + 0.5) AS INT) + 1] * 1000, 6) AS p95_ms FROM l""")
def latency_percentiles(s, d):
    return logs.percentiles(D.requests(s, d), "event_id")


@query(f"WITH {D.REQUESTS} SELECT surface, name, event_id, CAST(place AS INT) AS place FROM ({_LAST}) WHERE place <= 100")
def recent_last_n(s, d):
    return logs.last_n(D.requests(s, d), ["surface", "name"], "at", logs.RECENT, "event_id").select("surface", "name", "event_id", "place")


@query("""WITH c AS (SELECT DISTINCT event_id, ts, event_type, 'domain/' || user_id % 40 || '.md' AS path FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00')
SELECT path, count(*) AS times, max(ts) AS last_at, max_by(event_type, (ts, event_type)) AS via FROM c GROUP BY path ORDER BY last_at DESC, path LIMIT 2000""")
def recently_served(s, d):
    e = D.table(s, d, "events")
    calls = e.select(F.col("event_id").alias("call_id"), F.col("ts").alias("at"), F.col("event_type").alias("name"), F.concat(F.lit("domain/"), (F.col("user_id") % 40).cast("string"), F.lit(".md")).alias("path"))
    return logs.served(calls, F.expr(f"timestamp_ntz'{D.NOW}'"))


_EXPOSED = ", ".join(
    [f"'requests_total' || l || ',status=\"ok\"}} ' || (n - errors)", f"'requests_total' || l || ',status=\"error\"}} ' || errors"]
    + [f"'{x}_total' || l || '}} ' || {x}" for x in ("tokens", "chunks", "omitted")]
    + [f"'seconds_bucket' || l || ',le=\"{b}\"}} ' || le_{i}" for i, b in enumerate(logs.BOUNDS)]
    + ["'seconds_bucket' || l || ',le=\"+Inf\"} ' || n", "'seconds_sum' || l || '} ' || CAST(CAST(seconds AS DECIMAL(18, 3)) AS VARCHAR)", "'seconds_count' || l || '} ' || n"]
).replace("}}", "}")


@query(f"""WITH {D.REQUESTS}, s AS (
  SELECT '{{surface="' || surface || '",name="' || name || '"' AS l, count(*) AS n, CAST(count_if(error) AS BIGINT) AS errors, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(chunks) AS BIGINT) AS chunks,
         CAST(sum(omitted) AS BIGINT) AS omitted, round(sum(seconds), 6) AS seconds, {_HISTOGRAM} FROM requests GROUP BY surface, name
) SELECT 'lorespark_' || unnest([{_EXPOSED}]) AS line FROM s""")
def prometheus_text(s, d):
    return logs.prometheus(logs.series(D.requests(s, d)))


@query("SELECT CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS open, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS merged, CAST(count_if(o_orderstatus NOT IN ('O', 'F')) AS BIGINT) AS closed FROM orders")
def proposal_counts(s, d):
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "merged").otherwise("closed")
    return logs.proposal_counts(D.table(s, d, "orders").select(status.alias("status")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' THEN 'merged' WHEN o_orderkey % 5 = 0 THEN (CASE WHEN o_custkey % 2 = 0 THEN 'closed' ELSE 'open' END)
WHEN o_custkey % 3 = 0 THEN 'merged' WHEN o_custkey % 2 <> 0 OR o_custkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'open' ELSE 'closed' END AS status FROM orders""")
def proposal_status(s, d):
    o, k, c = D.table(s, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    status = logs.next_status(F.when(F.col("o_orderstatus") == "O", "open").otherwise("merged"), F.when(k % 5 == 0, "closed"), c % 2 == 0, c % 3 == 0, c % 7 != 0, k % 11 == 0)
    return o.select(k.alias("id"), status.alias("status"))


@query("""WITH c AS (SELECT user_id AS client, ts, CASE event_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN NULL ELSE 200 END AS code, user_id % 9 <> 0 AS reachable FROM events
), a AS (SELECT client, count(code) AS requests, CAST(count_if(code = 500) AS BIGINT) AS failures, max(ts) FILTER (code IN (200, 404)) AS last_ok, max(ts) FILTER (code = 500) AS last_error, bool_and(reachable) AS up FROM c GROUP BY client)
SELECT client, requests, failures, last_ok, last_error, CASE WHEN NOT up THEN 'down' WHEN coalesce(last_error > last_ok, last_error IS NOT NULL) THEN 'degraded' WHEN requests = 0 THEN 'idle' ELSE 'ok' END AS status FROM a""")
def health(s, d):
    m = F.col("event_id") % 6
    code = F.when(m == 0, 404).when(m == 1, 500).when(m == 2, F.lit(None)).otherwise(200)
    return logs.health(D.table(s, d, "events").select(F.col("user_id").alias("client"), F.col("ts").alias("at"), code.alias("code"), (F.col("user_id") % 9 != 0).alias("reachable")))


def _ranks(s, d):
    """Judged documents of a query's language class among its hits: expected are documents of good quality with small ids."""
    labels = D.table(s, d, "labels").where("quality = 1")
    expected = labels.select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("expected_id"), F.col("doc_id").cast("string").alias("path"), F.lit(None).cast("string").alias("heading"))
    hits = _hybrid(s, d).select("query_id", "rank", F.col("chunk_id").cast("string").alias("path"), F.lit("x").alias("heading"))
    return evaluation.found(hits, expected)


_RANKS = f"""{_FUSED}, e AS (SELECT doc_id % 10 AS query_id, doc_id FROM labels WHERE quality = 1
), r AS (SELECT e.query_id, e.doc_id, h.rank FROM e LEFT JOIN hybrid h ON h.query_id = e.query_id AND h.chunk_id = e.doc_id
), m AS (
  SELECT query_id, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS r5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS r10, coalesce(1.0 / min(rank), 0.0) AS mrr,
         sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0.0 END) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg10
  FROM r GROUP BY query_id
)"""


@query(f"WITH {_RANKS} SELECT query_id, round(r5, 6) AS r5, round(r10, 6) AS r10, round(mrr, 6) AS mrr, round(ndcg10, 6) AS ndcg10 FROM m")
def eval_metrics(s, d):
    return evaluation.per_query(_ranks(s, d)).select("query_id", *[F.round(c, 6).alias(c) for c in ("r5", "r10", "mrr", "ndcg10")])


@query(f"""WITH {_RANKS}, t AS (SELECT m.*, CASE WHEN query_id % 3 = 0 THEN 'keyword' ELSE 'paraphrase' END AS type FROM m)
SELECT coalesce(type, 'all') AS type, count(*) AS queries, round(avg(r5), 6) AS r5, round(avg(r10), 6) AS r10, round(avg(mrr), 6) AS mrr, round(avg(ndcg10), 6) AS ndcg10 FROM t GROUP BY ROLLUP (type)""")
def eval_by_type(s, d):
    per = written(evaluation.per_query(_ranks(s, d)))
    return evaluation.evaluate(per, per.select("query_id", F.when(F.col("query_id") % 3 == 0, "keyword").otherwise("paraphrase").alias("type")))


@query(f"""WITH s AS (SELECT lang AS mode, {D.sql_tokens('text')} AS tokens, doc_id % 4 <> 0 AS covered FROM documents), l AS (SELECT mode, list(tokens ORDER BY tokens) AS x FROM s GROUP BY mode)
SELECT mode, round(avg(tokens), 6) AS mean, any_value(x[len(x) // 2 + 1]) AS median, max(tokens) AS max, round(avg(CAST(covered AS INT)), 6) AS coverage FROM s JOIN l USING (mode) GROUP BY mode""")
def token_bench(s, d):
    docs = D.table(s, d, "documents")
    return evaluation.token_bench(docs.select(F.col("lang").alias("mode"), T.token_count(F.col("text")).alias("tokens"), (F.col("doc_id") % 4 != 0).alias("covered")))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def window_tumbling(s, d):
    from lorespark.streaming import logs as streams

    e = D.table(s, d, "events")
    return streams.tumbling(e, "ts", "event_type", "value", "1 day").drop("end")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) - to_days(k) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, (SELECT unnest(range(7)) AS k) GROUP BY ALL""")
def window_sliding(s, d):
    from lorespark.streaming import logs as streams

    return streams.sliding(D.table(s, d, "events"), "ts", "event_type", "value", "7 days", "1 day").drop("end")


@query("""WITH e AS (SELECT user_id, ts, coalesce(CAST(ts >= lag(ts) OVER w + INTERVAL 6 HOUR AS INT), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, k""")
def window_session(s, d):
    from lorespark.streaming import logs as streams

    return streams.sessions(D.table(s, d, "events"), "ts", "user_id", "6 hours")


@query(f"""WITH {D.LINKS} SELECT 'out' AS direction, to_path AS path FROM edges WHERE from_path = 'projects/p1/part-1.md' UNION ALL SELECT 'back', from_path FROM edges WHERE to_path = 'projects/p1/part-1.md'""")
def links_of_document(s, d):
    return graph.links_of(graph.resolve_links(D.part_links(s, d), D.part_paths(s, d)), "projects/p1/part-1.md")


@query(f"""WITH {D.LINKS} SELECT DISTINCT from_path, to_path FROM links WHERE to_path <> ''""")
def ignored_links(s, d):
    found = written(graph.resolve_links(D.part_links(s, d), D.part_paths(s, d)).where("to_path <> ''"))
    return graph.ignore_links(found.where("kind = 'markdown'"), found)


def _stored(s, d):
    """Vectors as stored: some of another model, some of a text that has changed since; and the chunks now."""
    docs = D.table(s, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "source", F.col("lang").alias("scope"), F.sha2("text", 256).alias("content_hash"))
    have = D.vectors(s, d).drop("scope").join(chunks.select("chunk_id", "content_hash"), "chunk_id")
    have = have.withColumn("content_hash", F.when(F.col("chunk_id") % 3 == 0, "stale").otherwise(F.col("content_hash"))).withColumn("model", F.when(F.col("chunk_id") % 5 == 0, "other").otherwise("hash-64"))
    return have, chunks


@query("SELECT vec_id AS chunk_id, lang AS scope FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0")
def current_vectors(s, d):
    return retrieval.current_vectors(*_stored(s, d), "hash-64").select("chunk_id", "scope")


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 5 = 0 THEN 'other' ELSE 'hash-64' END AS model FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang IN ('de', 'en')")
def pruned_vectors(s, d):
    vectors, chunks = _stored(s, d)
    return ingest.prune_vectors(vectors, chunks.where("scope in ('de', 'en')")).select("chunk_id", "model")


@query("""SELECT 'domain/' || doc_id || '.md' AS path, CASE WHEN lang = 'de' THEN sha256(upper(lang) || text) ELSE sha256(text) END AS content_hash FROM documents WHERE lang <> 'fr'
UNION ALL SELECT DISTINCT 'domain/' || source || '.md', sha256(source) FROM documents""")
def upserted_documents(s, d):
    docs, path = D.table(s, d, "documents"), F.concat(F.lit("domain/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    old = docs.where("lang <> 'fr'").select(path, F.sha2("text", 256).alias("content_hash"))
    changed = docs.where("lang = 'de'").select(path, F.sha2(F.concat(F.upper("lang"), "text"), 256).alias("content_hash"))
    added = docs.select("source").distinct().select(F.concat(F.lit("domain/"), F.col("source"), F.lit(".md")).alias("path"), F.sha2("source", 256).alias("content_hash"))
    return ingest.upsert(old, changed.union(added), "path")


@query("SELECT 'domain/' || doc_id || '.md' AS path, sha256(text) AS content_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def deleted_documents(s, d):
    gone = D.table(s, d, "labels").where("toxic = 1").select(F.concat(F.lit("domain/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return ingest.delete(_snapshot(s, d).drop("doc_id"), gone, "path")


@query(f"""WITH {D.SOURCES}, p AS (SELECT 'svc' || n || '/1-URGENT/main.go' AS path, updated_at FROM sources UNION ALL SELECT path, updated_at FROM sources)
SELECT path, coalesce((SELECT max(ts) FROM commits WHERE code_path = p.path), p.updated_at) AS updated_at FROM p""")
def document_ages(s, d):
    own = D.sources(s, d).select("path", F.col("updated_at").alias("modified_at"))
    code = own.withColumn("path", F.concat(F.lit("svc"), F.regexp_extract("path", r"(\d+)", 1), F.lit("/1-URGENT/main.go")))
    return ingest.ages(own.union(code), D.commits(s, d))


@query(f"WITH {D.SOURCES} SELECT path FROM sources WHERE updated_at IS NULL")
def age_unknown(s, d):
    return staleness.age_unknown(D.sources(s, d))


@query(f"WITH {D.SOURCES} SELECT min(updated_at) AS since FROM sources")
def drift_since(s, d):
    return staleness.since(D.sources(s, d))


@query("SELECT o_orderkey AS hash, o_orderdate AS changed_at FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01 00:00:00' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def changes_since(s, d):
    return staleness.changes_since(D.commits(s, d), F.expr("timestamp_ntz'1997-01-01 00:00:00'"), 50).select("hash", F.col("when").alias("changed_at"))


def _reports(s, d):
    """Order lines as drift reports of several repositories: repo, path, commits, last_change."""
    i = D.table(s, d, "lineitem").withColumn("path", F.concat(F.lit("domain/"), F.col("l_partkey").cast("string"), F.lit(".md")))
    return i.groupBy(F.concat("l_returnflag", "l_linestatus").alias("repo"), "path").agg(F.count("*").alias("commits"), F.max("l_shipdate").alias("last_change"))


_REPORTS = """reports AS (SELECT l_returnflag || l_linestatus AS repo, 'domain/' || l_partkey || '.md' AS path, count(*) AS commits, max(l_shipdate) AS last_change FROM lineitem GROUP BY ALL
), best AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY path ORDER BY commits DESC, repo) = 1)"""


@query(f"WITH {_REPORTS} SELECT repo, path, commits, last_change FROM best")
def drift_of_repositories(s, d):
    return staleness.drift_of_repositories(_reports(s, d))


@query(f"WITH {_REPORTS} SELECT path, commits, last_change FROM best ORDER BY commits DESC, last_change DESC, path LIMIT 20")
def drift_listing(s, d):
    return staleness.drift_listing(staleness.drift_of_repositories(_reports(s, d)), 20).select("path", "commits", "last_change")


@query(f"""WITH {_REPORTS}, a AS (SELECT * FROM reports WHERE repo = 'NO'), b AS (SELECT * FROM best)
SELECT path FROM a FULL JOIN b USING (path) WHERE a.commits IS DISTINCT FROM b.commits OR a.last_change IS DISTINCT FROM b.last_change""")
def drift_changed(s, d):
    return staleness.drift_changed(_reports(s, d).where("repo = 'NO'"), staleness.drift_of_repositories(_reports(s, d)))


@query(f"""WITH {_MATCHED}, per AS (SELECT path, count(DISTINCT hash) AS changes, max(ts) AS changed_at FROM hit GROUP BY path)
SELECT 'domain/' || source || '.md' AS doc_path, doc_id AS chunk_id, coalesce(changes, 0) AS changes, changed_at FROM documents LEFT JOIN per ON per.path = 'domain/' || source || '.md'""")
def drift_attached(s, d):
    hits = D.table(s, d, "documents").select(F.concat(F.lit("domain/"), F.col("source"), F.lit(".md")).alias("doc_path"), F.col("doc_id").alias("chunk_id"))
    found = retrieval.attach_drift(hits, staleness.drift(D.sources(s, d), D.commits(s, d)).withColumnRenamed("last_change", "last_change_at"))
    return found.withColumn("changes", F.coalesce("changes", F.lit(0))).select("doc_path", "chunk_id", "changes", "changed_at")


@query("SELECT count(*) AS events FROM events WHERE event_id % 3 = 0")
def usage_count(s, d):
    return logs.usage_count(D.usage(s, d))


def _cache(s, d):
    """Orders as compiled bundles, one key for each customer."""
    o = D.table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("cache_key"), F.col("o_orderkey").alias("bundle_id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("fingerprint"), (F.col("o_orderkey") % 3).alias("hits"), F.col("o_orderstatus").alias("state"))


@query("""WITH c AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O', o_orderdate, o_orderkey) = 1)
SELECT o_custkey AS cache_key, o_orderkey AS bundle_id, o_orderpriority AS fingerprint, o_orderkey % 3 + (SELECT count(*) FROM events WHERE user_id = o_custkey) AS hits FROM c""")
def bundle_cache(s, d):
    cache = bundle.put_bundles(_cache(s, d).where("state <> 'O'"), _cache(s, d).where("state = 'O'"))
    return bundle.use_bundles(cache, D.table(s, d, "events").select(F.col("user_id").alias("cache_key"))).select("cache_key", "bundle_id", "fingerprint", "hits")


@query("SELECT o_orderkey AS bundle_id FROM orders WHERE o_orderpriority = '3-MEDIUM'")
def bundle_cache_pruned(s, d):
    return bundle.prune_bundles(_cache(s, d), "3-MEDIUM").select("bundle_id")


@query("SELECT count(*) AS bundles, CAST(sum(o_orderkey % 3) AS BIGINT) AS hits FROM orders")
def bundle_stats(s, d):
    return logs.bundle_stats(_cache(s, d))


def _proposals(s, d):
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "merged").otherwise("closed")
    return D.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'merged' ELSE 'closed' END AS status"


@query(f"SELECT o_orderkey AS id, {_STATUS}, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def proposals_newest(s, d):
    return logs.list_proposals(_proposals(s, d), 20)


@query(f"SELECT o_orderkey AS id, {_STATUS}, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey")
def proposals_open(s, d):
    return logs.open_proposals(_proposals(s, d))


@query(f"WITH {D.LOG} SELECT bundle_id, name, query FROM log WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def log_pruned(s, d):
    return logs.prune_log(D.log(s, d), F.expr("timestamp_ntz'2024-01-10 00:00:00'")).select("bundle_id", "name", "query")


@query(f"WITH {D.LOG} SELECT bundle_id, name, scopes FROM log UNION ALL SELECT bundle_id, 'again', 'domain,projects/x' FROM log")
def log_appended(s, d):
    new = D.log(s, d).withColumn("name", F.lit("again")).withColumn("scopes", F.lit("projects/x,domain"))
    return logs.append_log(D.log(s, d), new).select("bundle_id", "name", "scopes")


@query(f"""WITH {D.CHUNKS}, p AS (SELECT 'projects/' || scope || '/' || doc_id || '.md' AS path, scope, tokens FROM chunks)
SELECT scenario, count(DISTINCT path) AS documents, count(*) AS sections, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
  SELECT 'all' AS scenario, * FROM p UNION ALL SELECT 'curated', * FROM p WHERE scope IN ('de', 'fr') OR path = 'projects/en/7.md') GROUP BY scenario""")
def static_baselines(s, d):
    path = F.concat(F.lit("projects/"), F.col("scope"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return evaluation.static_baselines(D.chunks(s, d).select(path.alias("doc_path"), "tokens"), ["projects/de", " projects/fr/ ", "", "projects/en/7.md"])


@query("""WITH c AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS instance, ts, event_type AS name, event_id, unnest(['d' || user_id % 37, 'd' || event_id % 11]) AS path FROM events
), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 24 HOURS THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY instance, path ORDER BY ts, name, event_id)
), r AS (SELECT *, sum(new) OVER (PARTITION BY instance, path ORDER BY ts, name, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g
), l AS (SELECT instance, path, run, count(*) AS times, max(ts) AS last_at, max({'a': ts, 'n': name}).n AS via FROM r GROUP BY ALL
), n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY instance, path ORDER BY run DESC) = 1)
SELECT instance, path, times, last_at, via FROM n JOIN (SELECT instance, max(ts) AS stop FROM c GROUP BY instance) USING (instance) WHERE last_at >= stop - INTERVAL 24 HOURS
QUALIFY row_number() OVER (PARTITION BY instance ORDER BY last_at DESC, path) <= 2000""")
def served_runs(s, d):
    path = lambda c, n: F.concat(F.lit("d"), (F.col(c) % n).cast("string"))
    e = D.table(s, d, "events")
    return state.served_runs(e.select(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("instance"), F.col("ts").alias("at"), F.col("event_type").alias("name"), F.array(path("user_id", 37), path("event_id", 11)).alias("paths")))


@query("""WITH d AS (SELECT doc_id, text, 'domain/' || doc_id || '.md' AS path FROM documents), kept AS (SELECT * FROM d WHERE doc_id % 5 <> 0),
l AS (SELECT path AS from_path, unnest(['[[' || (doc_id + 1) || ']]', '[[' || (doc_id + 5) || ']]']) AS link, unnest([doc_id + 1, doc_id + 5]) AS t FROM kept WHERE doc_id % 7 <> 0
UNION ALL SELECT path, '[[3]]', 3 FROM kept WHERE doc_id % 7 = 0)
SELECT from_path, CAST(t AS VARCHAR) AS target, coalesce(kept.path, '') AS to_path FROM l LEFT JOIN kept ON kept.doc_id = l.t""")
def index_links(s, d):
    """An index that is filled, then changed (every seventh document) and thinned (every fifth): the links that are left, resolved anew each time."""
    docs = D.table(s, d, "documents").select("doc_id", F.concat(F.lit("domain/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("title"))
    named = lambda *ids: F.concat(*[F.concat(F.lit("see [["), i.cast("string"), F.lit("]]\n")) for i in ids])
    bodied = lambda df, *ids: df.withColumn("body", named(*ids)).withColumn("content_hash", F.sha2("body", 256)).drop("doc_id")
    store = _store(s)
    index.upsert_documents(store, bodied(docs, F.col("doc_id") + 1, F.col("doc_id") + 5))
    index.upsert_documents(store, bodied(docs.where("doc_id % 7 = 0"), F.lit(3)))
    index.delete_documents(store, docs.where("doc_id % 5 = 0").select("path"))
    return store.table("links").select("from_path", "target", "to_path")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval over documents and vectors, then the budget fill."""
    found = retrieval.search_context(D.whole(spark, sf_dir), D.queries(spark, sf_dir), D.vectors(spark, sf_dir), D.query_vectors(spark, sf_dir), top_k=10)
    return found.select("query_id", F.array_join(F.col("picked").cast("array<string>"), ",").alias("picked"), "tokens", "omitted", "top_score", "margin")


@query()
def search_context(s, d):
    return flagship(s, d)
