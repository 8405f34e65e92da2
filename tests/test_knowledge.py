"""Ingest, links, staleness, retrieval, bundles, logs and evaluation on small hand-made inputs."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from cutting import first_tokens
from lorespark.functions import text as T
from lorespark.operators import bundle, evaluation, graph, ingest, logs, retrieval, staleness
from lorespark.sources import markdown, markup

AT = dt.datetime(2024, 1, 1)


def test_front_matter(spark):
    text = '---\ntitle: "Refunds"\ntags: [a, b]\nrefs:\n  - src/**\n  - "x.go"\n---\n# Body\n'
    docs = spark.createDataFrame([(text,), ("no front",), ("---\nopen",), ("---\n---\nx",)], "t string")
    fm = ingest.front_matter(F.col("t"))
    a, b, c, d = docs.select(fm["title"].alias("title"), fm["tags"].alias("tags"), fm["refs"].alias("refs"), fm["body"].alias("body"), fm["broken"].alias("broken"), ingest.has_front_matter(F.col("t")).alias("has")).collect()
    assert (a.title, a.tags, a.refs, a.body, a.broken) == ("Refunds", ["a", "b"], ["src/**", "x.go"], "# Body\n", False)
    assert b.body == "no front" and not b.has and c.broken and d.has and d.body == "x" and not d.broken


def test_sections():
    body = "# Title\nintro\n\n## A\ntext\n```\n## not a heading\n```\n### B\nb\n#### C\nc\n## A\nagain\nUnder\n-----\nu\n"
    name, found = ingest.sections("domain/x.md", None, body)
    assert name == "Title"
    assert [h for h, _, _ in found] == ["Title", "Title > A", "Title > A > B", "Title > A (2)", "Title > Under"]
    assert found[0][1] == "intro" and "## not a heading" in found[1][1] and "#### C" in found[2][1]
    assert ingest.sections("p.md", "Front", "text")[0] == "Front" and ingest.sections("p.md", None, "text")[0] == "p.md"


def test_oversize_split():
    parts = ingest.split_oversized("\n\n".join("word " * 120 for _ in range(12)))
    assert len(parts) > 1 and all(T.count_tokens(p) <= ingest.TARGET_TOKENS for p in parts)
    assert all(T.count_tokens(p) <= ingest.MAX_TOKENS for p in ingest.split_oversized("x1 " * 4000))


def test_scan_chunks_and_reconcile(spark, tmp_path):
    for path, text in {"domain/a.md": "---\ntitle: A\n---\n# A\nx\n## S\n[b](b.md)\n", "domain/b.md": "# B\nsee [[a]]\n", "projects/p/c.MD": "c", "readme.md": "no", "domain/.hidden/x.md": "no", "domain/n.txt": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    docs = markdown.documents(markdown.scan(spark, str(tmp_path)))
    rows = {r.path: r for r in docs.collect()}
    assert set(rows) == {"domain/a.md", "domain/b.md", "projects/p/c.MD"} and rows["domain/a.md"].title == "A" and rows["projects/p/c.MD"].scope == "projects/p"
    chunks = ingest.chunk_documents(docs)
    assert [(r.heading, r.position) for r in chunks.where("doc_path = 'domain/a.md'").orderBy("position").collect()] == [("A", 0), ("A > S", 1)]
    assert ingest.reassemble(chunks).where("doc_path = 'domain/b.md'").first().text == "see [[a]]"
    index = docs.select("path", F.when(F.col("path") == "domain/a.md", "old").otherwise(F.col("content_hash")).alias("content_hash")).where("path <> 'domain/b.md'").union(spark.createDataFrame([("domain/z.md", "h")], "path string, content_hash string"))
    assert {r.path: r.status for r in ingest.reconcile(docs, index).collect()} == {"domain/a.md": "changed", "domain/b.md": "new", "domain/z.md": "deleted", "projects/p/c.MD": "same"}
    links = graph.resolve_links(ingest.extract_links(docs), docs)
    assert {(r.from_path, r.to_path) for r in links.collect()} == {("domain/a.md", "domain/b.md"), ("domain/b.md", "domain/a.md")}
    markdown.write_documents(docs, str(tmp_path / "out"))
    assert (tmp_path / "out" / "scope=domain").exists()


def test_links(spark):
    body = "[[a]][[b]] ![[no]] [[c|x]] [[d#h]] `[[code]]`\n```\n[[fence]]\n```\n[x](e.md#top) [y](https://z/f.md) [z](/g.md) ![i](h.md) [t](i.MD \"title\") [x](e.md)"
    got = spark.createDataFrame([(body,)], "b string").select(ingest.links(F.col("b")).alias("l")).first().l
    assert [(x.target, x.kind) for x in got] == [("a", "wikilink"), ("c", "wikilink"), ("d", "wikilink"), ("e.md", "markdown"), ("i.MD", "markdown")]


def test_resolution_and_suggestions(spark):
    paths = spark.createDataFrame([("domain/a/x.md",), ("domain/y.md",), ("projects/p/y.md",), ("domain/late-fees.md",)], "path string")
    asked = [("domain/a/x.md", "../y.md", "markdown", "domain/y.md"), ("domain/a/x.md", "z.md", "markdown", ""), ("domain/a/x.md", "Y", "wikilink", "domain/y.md"), ("domain/a/x.md", "projects/p/y", "wikilink", "projects/p/y.md"), ("domain/a/x.md", "../y", "wikilink", "domain/y.md"), ("domain/a/x.md", "q/late-fees", "wikilink", "domain/late-fees.md")]
    links = spark.createDataFrame([a[:3] for a in asked], "from_path string, target string, kind string")
    got = {(r.target, r.kind): r.to_path for r in graph.resolve_links(links, paths).collect()}
    assert got == {(t, k): to for _, t, k, to in asked}
    docs = spark.createDataFrame([("domain/late-fees.md", "Late fees", "x"), ("domain/b.md", "Other", "# Late fees\nLate fees and late  fees, late fees."), ("domain/c.md", "Third", "translate feesx late fees")], "path string, title string, body string")
    none = spark.createDataFrame([], "from_path string, to_path string")
    assert [(r.from_path, r.to_path, r.mentions) for r in graph.suggest_links(docs, none, none, 5).collect()] == [("domain/b.md", "domain/late-fees.md", 2), ("domain/c.md", "domain/late-fees.md", 1)]
    known = spark.createDataFrame([("domain/late-fees.md", "domain/b.md")], "from_path string, to_path string")
    assert [r.from_path for r in graph.suggest_links(docs, known, none, 5).collect()] == ["domain/c.md"]


def test_links_that_ask_for_no_name_are_spread(spark):
    rows = [(f"domain/{i}.md", f"x{i}.md", "markdown") for i in range(400)] + [("a.md", "N", "wikilink"), ("b.md", None, "wikilink"), ("c.md", "late/n", "wikilink"), ("d.md", "x", None)]
    paths = spark.createDataFrame([("q/n.md",), ("late/n.md",), ("domain/x7.md",)], "path string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = graph.resolve_links(spark.createDataFrame(rows, "from_path string, target string, kind string"), paths)
        # the last join deals links out by name: 4 partitions here
        parts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        got = {(r.from_path, r.target): r.to_path for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(parts) < 200 and sum(parts) == len(rows) == len(got)
    assert {k: v for k, v in got.items() if v} == {("domain/7.md", "x7.md"): "domain/x7.md", ("a.md", "N"): "q/n.md", ("c.md", "late/n"): "late/n.md"}


def test_drift_and_coverage(spark):
    docs = spark.createDataFrame([("d1", ["src/**"], AT), ("d2", ["api/x.go"], AT), ("d3", ["src/**"], None), ("d4", [], AT)], "path string, refs array<string>, updated_at timestamp")
    day = lambda n: AT + dt.timedelta(days=n)
    commits = spark.createDataFrame([("c1", day(1), ["src/a.go", "src/b.go"]), ("c2", day(2), ["src/z.go", "doc/x"]), ("c0", day(0), ["api/x.go"])], "hash string, when timestamp, paths array<string>")
    assert [(r.path, r.commits, r.last_change, r.last_path) for r in staleness.drift(docs, commits).collect()] == [("d1", 2, day(2), "src/z.go")]
    assert [r.hash for r in staleness.changes_since(commits, day(0), 1).collect()] == ["c2"]
    dirs = spark.createDataFrame([("src",), ("api",), ("web",)], "dir string")
    got = staleness.coverage(dirs, docs.unionByName(spark.createDataFrame([("d5", ["api/*"], AT)], docs.schema))).first()
    assert (got.covered, got.total, got.uncovered) == (2, 3, "web")
    assert staleness.drift_changed(staleness.drift(docs, commits), staleness.drift(docs, commits)).count() == 0
    merges = spark.createDataFrame([("m", "p1", ["a", "b"]), ("m", "p2", ["b", "c"])], "hash string, parent string, paths array<string>")
    assert staleness.merge_paths(merges).first().paths == ["b"]


def _chunks(spark, texts):
    return spark.createDataFrame([(i, i, "domain" if i % 2 else "conventions", 0, t, T.count_tokens(t)) for i, t in enumerate(texts)], "chunk_id long, doc_id long, scope string, position int, content string, tokens long")


def test_search_and_budget(spark):
    chunks = _chunks(spark, ["refund order rules", "refund", "order", "nothing here", "refund order order"])
    q = spark.createDataFrame([(1, "How to refund an order?", ["domain", "conventions"])], "query_id long, query string, scopes array<string>")
    hits = retrieval.bm25(chunks, q, 10).orderBy("rank").collect()
    assert [h.all_terms for h in hits] == [True, True, False, False] and {h.chunk_id for h in hits[:2]} == {0, 4}
    assert retrieval.bm25(chunks, spark.createDataFrame([(1, " ")], "query_id long, query string"), 10).count() == 0
    r = random.Random(7)
    for _ in range(5):
        items = [(1, i, i, r.randint(1, 50)) for i in range(20)]
        got = retrieval.budget_fill(spark.createDataFrame(items, "k int, r int, i int, t int"), "k", "r", "t", "i", 100, 6).first()
        used, picked, omitted = 0, [], 0
        for _, i, _, t in items:
            if len(picked) < 6:
                if used + t <= 100:
                    used, picked = used + t, [*picked, i]
                else:
                    omitted += 1
        assert (got.picked, got.tokens, got.omitted) == (picked, used, omitted)


def test_rrf_and_governed(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, chunk_id long, rank int")
    got = {r.chunk_id: (r.score, r["rank"]) for r in retrieval.rrf([(a, 1.0, None), (b, 0.25, F.lit(2))]).collect()}
    assert got[10][0] == pytest.approx(1 / 61, abs=1e-9) and got[11][0] == pytest.approx(1 / 62 + 0.25 / 63, abs=1e-9) and got[11][1] == 1
    chunks = spark.createDataFrame([("d", i, i) for i in range(20, 25)], "doc_id string, chunk_id long, position int")
    gov = retrieval.governed(retrieval.rrf([(a, 1.0, None)]), spark.createDataFrame([(1, "d")], "query_id long, doc string"), chunks).orderBy("rank").collect()
    assert [g.chunk_id for g in gov[:3]] == [20, 21, 22] and len(gov) == 5
    v = spark.createDataFrame([([3.0, 4.0], [[1.0, 0.0], [0.0, 1.0]])], "v array<double>, m array<array<double>>").select(retrieval.normalise(F.col("v")).alias("n"), retrieval.mean_pool(F.col("m")).alias("p")).first()
    assert v.n == [0.6, 0.8] and v.p == pytest.approx([0.5**0.5] * 2)


def _ranked(spark, r, n):
    words = [f"w{i}" for i in range(30)]
    rows = [("b", i, i, c := " ".join(r.choice(words) for _ in range(r.randint(3, 60))), T.count_tokens(c), "domain/d.md", "H", r.choice(["domain", "conventions", "projects/x"]), AT, 0, AT) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "bundle_id string, rank int, chunk_id long, content string, tokens long, doc_path string, heading string, scope string, updated_at timestamp, changes int, changed_at timestamp"), rows


def _packed(rows, budget, head, header):
    """The rule of the engine: the head's cost once, each section with its header's tokens and 2; (kept rows, truncated, used)."""
    kept, used = [], head
    for row in rows:
        terms = set(row[3].split())
        if any(row[3] == k[3] or len(terms & set(k[3].split())) / len(terms | set(k[3].split())) >= 0.85 for k in kept) or used + row[4] + header > budget:
            continue
        kept.append(row)
        used += row[4] + header
    room = budget - head - header - T.count_tokens(T.CUT_MARK)
    return (kept, False, used) if kept or room < T.LEAST_ROOM else (rows[:1], True, used)


def test_pack_against_a_loop(spark):
    r = random.Random(42)
    seen = set()
    for most in (20, 70, 120, 260):
        df, rows = _ranked(spark, r, 25)
        task = spark.createDataFrame([("b", "a  task\nwith -- lines " + "x" * r.choice([0, 200]), ["domain"])], "bundle_id string, task string, scopes array<string>")
        top = bundle.heads(task, "f" * 16, most)
        head = top.first()
        flat = " ".join(head.task.split()).replace("--", "—")
        flat = flat if len(flat) <= 120 else flat[:119] + "…"
        empty = f"<!-- context bundle b · 0 section(s), ~0 tokens · scopes: domain · index {'f' * 16} · task: {flat} -->\n\n(no matching knowledge)\n"
        assert (head.budget, head.head_cost) == (max(1, int(most * 0.95)), T.count_tokens(empty) + 4)
        kept, truncated, used = _packed(rows, head.budget, head.head_cost, T.count_tokens("## domain/d.md — H (updated 2024-01-10)") + 2)
        got = bundle.pack(df, top).first()
        assert ([s.chunk_id for s in got.selected], got.truncated, got.tokens) == ([str(k[2]) for k in kept], truncated, used)
        seen.add((truncated, len(kept) > 1))
    assert seen >= {(False, True)}


def test_what_fits_later_is_taken(spark):
    """Sections of 500, 430 and 100 tokens in a budget of 950: the first and the third."""
    rows = [("b", i, f"c{i}", " ".join(f"{w}{k}" for k in range(n // 2)), n, "domain/d.md", "H", "domain", None, 0, None) for i, (w, n) in enumerate([("a", 500), ("b", 430), ("c", 100)], 1)]
    df = spark.createDataFrame(rows, "bundle_id string, rank int, chunk_id string, content string, tokens long, doc_path string, heading string, scope string, updated_at timestamp, changes int, changed_at timestamp")
    tasks = spark.createDataFrame([("b", "task", ["domain"])], "bundle_id string, task string, scopes array<string>")
    got = bundle.compile_bundle(df, tasks, "f" * 16, 1000).first()
    assert "a0" in got.text and "c0" in got.text and "b0" not in got.text and got.tokens <= 950


def test_compiled_bundles_fit_and_repeat(spark):
    r = random.Random(3)
    tasks = spark.createDataFrame([("b", "a task", ["domain"]), ("none", "x", ["domain"])], "bundle_id string, task string, scopes array<string>")
    df, _ = _ranked(spark, r, 30)
    for most in (120, 400):
        a, b = ({x.bundle_id: x for x in bundle.compile_bundle(df, tasks, "f" * 16, most).collect()} for _ in range(2))
        assert a == b and a["b"].tokens <= most and T.count_tokens(a["b"].text) == a["b"].tokens and "(no matching knowledge)" in a["none"].text


def test_gaps(spark):
    log = spark.createDataFrame([(AT, "s", "q1", "d", 0, 0.0, 0.0, "b1"), (AT, "s", "q1", "d", 2, 1.0, 0.5, "b2"), (AT, "s", "q2", "d", 2, 1.0, 0.1, "b3"), (AT - dt.timedelta(9), "s", "old", "d", 0, 0.0, 0.0, "b4")], "at timestamp, name string, query string, scopes string, results int, top_score double, margin double, bundle_id string")
    usage = spark.createDataFrame([("b2", False), ("b3", True), ("b3", False)], "bundle_id string, useful boolean")
    since = F.lit(AT - dt.timedelta(7))
    assert [(g.query, g.times, g.reason) for g in logs.gaps_no_useful(log, usage, since, 9).collect()] == [("q1", 2, "not_useful")]
    assert [g.query for g in logs.gaps_low_confidence(log, since, 9).collect()] == ["q2", "q1"]


def test_statuses_and_bases(spark):
    rows = [("open", "merged", True, None, None, None), ("open", "closed", False, None, None, None), ("open", None, True, True, False, False), ("open", None, True, False, True, False), ("open", None, True, False, False, False), ("merged", None, True, False, True, False)]
    df = spark.createDataFrame(rows, "s string, pr string, l boolean, landed boolean, has boolean, br boolean")
    assert [r.x for r in df.select(logs.next_status(*map(F.col, ("s", "pr", "l", "landed", "has", "br"))).alias("x")).collect()] == ["merged", "open", "merged", "closed", "open", "merged"]
    with pytest.raises(Exception, match="unknown status"):
        logs.proposal_counts(spark.createDataFrame([("lost",)], "status string")).collect()
    c = spark.createDataFrame([("", "x", "y"), ("h", None, "y"), ("h", "x", "y"), (None, "---\n---\nx", "y"), (None, "x", "y")], "b string, c string, n string")
    assert [r.x for r in c.select(logs.base_problem(F.col("b"), F.col("c"), F.col("n")).alias("x")).collect()] == ["exists", "missing", "changed", "front matter dropped", None]


def test_evaluation(spark):
    expected = spark.createDataFrame([(1, 1, "a", "fees"), (1, 2, "b", None)], "query_id long, expected_id int, path string, heading string")
    hits = spark.createDataFrame([(1, 2, "a", "X > Late fees"), (1, 7, "b", "B"), (1, 1, "a", "other")], "query_id long, rank int, path string, heading string")
    got = evaluation.per_query(evaluation.found(hits, expected)).first()
    assert (got.r5, got.r10, got.mrr) == (0.5, 1.0, 0.5) and got.ndcg10 == pytest.approx((1 / 1.5849625 + 1 / 3) / (1 + 1 / 1.5849625), abs=1e-6)


def test_golden_and_beir(spark, tmp_path):
    (tmp_path / "g.yaml").write_text("queries:\n  - id: q1\n    query: \"how?\"\n    expected:\n      - path: domain/a.md\n        heading: H\n  - id: q2\n    type: typo\n    query: x\n    scopes: [a, b]\n    expected:\n      - {path: p.md}\n")
    a, b = markdown.golden(spark, str(tmp_path / "g.yaml")).collect()
    assert (a.type, a.query, a.expected[0].heading) == ("keyword", "how?", "H") and (b.type, b.scopes, b.expected[0].path) == ("typo", ["a", "b"], "p.md")
    (tmp_path / "bad.yaml").write_text("- id: q1\n  query: x\n")
    with pytest.raises(ValueError):
        markdown.golden(spark, str(tmp_path / "bad.yaml"))
    (tmp_path / "t.yaml").write_text("hybrid:\n  r5: 0.8\n  mrr: 0.7\n")
    assert {(r.mode, r.metric, r.minimum) for r in markdown.thresholds(spark, str(tmp_path / "t.yaml")).collect()} == {("hybrid", "r5", 0.8), ("hybrid", "mrr", 0.7)}


def test_html():
    html = "<h1>T</h1><p>a <b>b</b> <a href='/x'>l</a><br>n</p><ul><li>x<ul><li>y</ul><li>z</ul><table><tr><th>a|b<th>c<tr><td>1</table><pre><code class='language-go'>f()\n</code></pre><blockquote><p>q</blockquote><script>no</script>"
    assert markup.to_markdown(html) == "# T\n\na **b** [l](/x)\nn\n\n- x\n  - y\n- z\n\n| a\\|b | c |\n| --- | --- |\n| 1 |  |\n\n```go\nf()\n```\n\n> q"
    assert markup.to_markdown("") == ""


def test_issues():
    doc = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "hello"}]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "i"}]}]}]}]}
    raw = json.dumps({"key": "A-1", "fields": {"summary": "S", "status": {"name": "Open"}, "labels": ["x", "y"], "description": doc}})
    assert markup.issue_text(raw) == "A-1: S\nStatus: Open\nLabels: x, y\n\nhello\n- i"


def test_streams_equal_batches(spark, tmp_path):
    from lorespark.streaming import logs as S

    rows = [(i, AT + dt.timedelta(hours=i), f"k{i % 3}", float(i)) for i in range(60)]
    events = spark.createDataFrame(rows, "id long, at timestamp, k string, v double")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = S.read_events(spark, str(tmp_path / "in"), events.schema, 1)
    got = S.tumbling(stream, "at", "k", "v", "1 day").writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    got.awaitTermination(120)
    assert set(map(tuple, spark.table("tumbled").collect())) == set(map(tuple, S.tumbling(events, "at", "k", "v", "1 day").collect()))
    last = S.last_n(S.read_events(spark, str(tmp_path / "in"), events.schema, 1), "k", "at", "v", 5).writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    last.awaitTermination(120)
    newest = {r.v for r in spark.table("latest").where("k = 'k0'").collect()}
    assert {57.0, 54.0, 51.0, 48.0, 45.0} <= newest


def test_listing_and_embedding(spark):
    from lorespark.functions.embedding import embed, hash_embed

    hits = spark.createDataFrame([(1, 1, "a b c", "a"), (1, 2, "d e f g h", "d"), (1, 3, "x", "x")], "query_id int, rank int, line string, short string")
    assert tuple(retrieval.list_lines(hits, 5, False).first()) == (1, "a b c", 1, 2)
    assert tuple(retrieval.list_lines(hits, 5, True).first()) == (1, "a b c\nd\nx", 3, 0)
    rows = spark.createDataFrame([(1, "Refund order"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.embedding for r in embed(rows, "id", "t").collect()}
    assert got[1] == pytest.approx(hash_embed(["refund order"])[0].tolist()) and not any(got[2]) and not any(got[3])


def test_issue_bundle_fits(spark):
    df, _ = _ranked(spark, random.Random(9), 20)
    tasks = spark.createDataFrame([("b", "a task", ["domain"])], "bundle_id string, task string, scopes array<string>")
    issue = spark.createDataFrame([("b", "\n".join(f"line {i} of the issue" for i in range(200)))], "bundle_id string, issue string")
    from lorespark.api import issue_bundle

    got = issue_bundle(issue, df, tasks, "f" * 16, 400).first()
    assert got.tokens <= 380 and got.text.startswith("line 0") and "## domain/d.md" in got.text


def _search_tables(spark):
    import random

    r = random.Random(2)
    words = [f"term{i}" for i in range(30)]
    scopes = ["domain", "conventions", "projects/x"]
    chunks = [(i, f"d{i % 7}", scopes[i % 3], i, " ".join(r.choice(words) for _ in range(r.randint(5, 60)))) for i in range(60)]
    chunks = [(*c, len(c[4].split()) * 3) for c in chunks]
    vectors = [(i, [r.uniform(-1, 1) for _ in range(4)], scopes[i % 3]) for i in range(60)]
    queries = [(q, " ".join(r.sample(words, 4)), [["domain"], [], ["domain", "conventions"], ["projects/x"]][q % 4]) for q in range(8)] + [(99, "  ", ["domain"])]
    asked = [(q, [r.uniform(-1, 1) for _ in range(4)], ["projects/x"]) for q in [*range(8), 99]]
    return (
        spark.createDataFrame(chunks, "chunk_id long, doc_id string, scope string, position int, content string, tokens long"),
        spark.createDataFrame(queries, "query_id long, query string, scopes array<string>"),
        spark.createDataFrame(vectors, "chunk_id long, embedding array<double>, scope string"),
        spark.createDataFrame(asked, "query_id long, qe array<double>, scopes array<string>"),
        {c[0]: c for c in chunks}, {q[0]: q[2] for q in queries},
    )


@pytest.mark.parametrize("mode,most,top", [(None, 200, 5), ("bm25", 90, 3), ("vector", 300, 500), (None, 1, 0), (None, 0, 4)])
def test_search_keeps_to_scopes_and_budget(spark, mode, most, top):
    """No way of finding a section leaves the query's scopes, the budget is 95 %, the number of sections is bounded."""
    chunks, queries, vectors, asked, by_id, scopes = _search_tables(spark)
    governing = spark.createDataFrame([(q, f"d{d}") for q in range(8) for d in (1, 4)] + [(99, "d1")], "query_id long, doc string")
    got = retrieval.search_context(chunks, queries, vectors, asked, top_k=top, max_tokens=most, scoped=True, mode=mode, governing=governing, max_top_k=6, default_scopes=["conventions"]).collect()
    budget = max(1, int((most or 2000) * 0.95))
    for g in got:
        allowed = scopes[g.query_id] or ["conventions"]
        assert all(by_id[i][2] in allowed for i in g.picked) and g.budget == budget
        assert g.tokens == sum(by_id[i][5] for i in g.picked) <= budget and len(g.picked) <= min(top or 8, 6)
        assert g.mode == (mode or "hybrid")
        if g.query_id == 99:  # a blank query
            assert (g.picked, g.tokens, g.omitted, g.top_score) == ([], 0, 0, 0)
        else:
            assert (g.top_score == 0) == (mode == "bm25")
    assert sorted(g.query_id for g in got) == [*range(8), 99]


def test_search_embeds_queries_and_degrades(spark):
    """embed makes the query vectors; a query that it fails on is searched by words alone, and gets nothing in mode vector."""
    chunks, queries, vectors, asked, by_id, _ = _search_tables(spark)
    failed = asked.withColumn("qe", F.when(F.col("query_id") % 3 != 0, F.col("qe"))).where("query_id <> 5")
    embed = lambda q: q.join(failed.select("query_id", "qe"), "query_id")
    given = {g.query_id: g for g in retrieval.search_context(chunks, queries, vectors, asked, max_tokens=300).collect()}
    words = {g.query_id: g for g in retrieval.search_context(chunks, queries, max_tokens=300).collect()}
    got = {g.query_id: g for g in retrieval.search_context(chunks, queries, vectors, max_tokens=300, embed=embed).collect()}
    assert len(got) == 9
    for q, g in got.items():
        if q % 3 == 0 or q == 5:  # the lists of hybrid search are longer than those of mode bm25
            assert g.picked[: len(words[q].picked)] == words[q].picked and g.top_score == 0 and g.mode == "hybrid"
        else:
            assert g == given[q]
    alone = {g.query_id: g for g in retrieval.search_context(chunks, queries, vectors, max_tokens=300, embed=embed, mode="vector").collect()}
    assert all((a.picked == []) == (q % 3 == 0 or q == 5) for q, a in alone.items())


def test_search_wants_vectors_and_attaches_drift(spark):
    chunks, queries, vectors, asked, by_id, _ = _search_tables(spark)
    with pytest.raises(ValueError):
        retrieval.search_context(chunks, queries, mode="hybrid")
    filled = retrieval.search_context(chunks, queries, max_tokens=500)
    drift = spark.createDataFrame([("d1", 4, "2024-01-01"), ("other", 9, "2024-01-02")], "path string, commits int, last_change_at string")
    got = retrieval.answers(filled, chunks.withColumn("doc_path", F.col("doc_id")), drift).collect()
    assert len(got) == sum(len(g.picked) for g in filled.collect()) > 0
    assert all((g.changes, g.changed_at) == ((4, "2024-01-01") if g.doc_path == "d1" else (None, None)) for g in got)


def test_texts_are_cut_to_a_budget(spark):
    import random

    from lorespark.functions import text as T

    r = random.Random(6)
    texts = ["", "\n\n\n", "one", "a\n\r\nb\n\n\nc", "x" * 400, ("word " * 300).strip(), "line one\n" + "y" * 900]
    texts += ["".join(r.choice(["alpha ", "\n", "\r", "12345 ", "?!", "überlänge ", "\n\n"]) for _ in range(60)) for _ in range(40)]
    rows = [(t, m) for t in texts for m in (1, 7, 50, 120)]
    df = spark.createDataFrame(rows, "t string, m int")
    cut, fit, lines = T.truncate(F.col("t"), F.col("m")), T.fit(F.col("t"), F.col("m")), T.fit_lines(F.col("t"), F.col("m"))
    for g in df.select("t", "m", cut.alias("cut"), fit.alias("fit"), lines.alias("lines")).collect():
        assert T.count_tokens(g.cut) <= g.m and g.lines.tokens == T.count_tokens(g.lines.text)
        whole = T.count_tokens(g.t) <= g.m
        assert (g.cut == g.t) if whole else g.t.strip().startswith(g.cut.strip())
        leading = g.t.split("\n")
        fitting = max((k for k in range(len(leading) + 1) if all(T.count_tokens("\n".join(leading[:i])) <= g.m for i in range(1, k + 1))), default=0)
        assert g.lines.n == fitting
        if not whole and fitting == 0:
            assert g.cut == first_tokens(g.t, g.m).strip()
        assert g.fit.ok == (whole or g.m - T.count_tokens(T.CUT_MARK) >= T.LEAST_ROOM) and T.count_tokens(g.fit.text) <= g.m


def test_a_bundle_of_one_long_line_is_not_empty(spark):
    from lorespark.operators import bundle

    line = " ".join(f"word{i}" for i in range(3000))
    ranked = spark.createDataFrame([("b", 1, "c", line, 9000, "domain/a.md", "A", "domain", None, 0, None)], "bundle_id string, rank int, chunk_id string, content string, tokens int, doc_path string, heading string, scope string, updated_at timestamp, changes int, changed_at timestamp")
    tasks = spark.createDataFrame([("b", "task", ["domain"])], "bundle_id string, task string, scopes array<string>")
    got = bundle.compile_bundle(ranked, tasks, "f", 1000).collect()[0]
    assert got.kept == 1 and 600 < got.tokens <= 950 and "word5" in got.text and "~9000" not in got.text


def test_bundle_cache(spark):
    kinds = "cache_key string, bundle_id string, at int, hits long, fingerprint string"
    cache = spark.createDataFrame([("k", "a", 5, 1, "f"), ("m", "b", 1, 0, "g")], kinds)
    new = spark.createDataFrame([("k", "c", 1, 0, "f"), ("n", "e", 2, 0, "f"), ("n", "d", 2, 0, "f")], kinds)
    put = bundle.put_bundles(cache, new)
    assert {r.cache_key: r.bundle_id for r in put.collect()} == {"k": "a", "m": "b", "n": "d"}
    asked = spark.createDataFrame([("k",), ("k",), ("n",), ("none",)], "cache_key string")
    assert {r.cache_key: r.hits for r in bundle.use_bundles(put, asked).collect()} == {"k": 3, "m": 0, "n": 1}
    assert [r.cache_key for r in bundle.prune_bundles(cache, "f").collect()] == ["k"]


def test_token_bench_against_a_loop(spark):
    random.seed(3)
    rows = [(m, random.randrange(9), random.random() < 0.5) for m in "ab" for _ in range(random.randrange(1, 40))]
    for r in evaluation.token_bench(spark.createDataFrame(rows, "mode string, tokens long, covered boolean")).collect():
        mine = [x for x in rows if x[0] == r.mode]
        sizes = sorted(x[1] for x in mine)
        assert (r["median"], r["max"]) == (sizes[len(sizes) // 2], sizes[-1])
        assert r["mean"] == pytest.approx(sum(sizes) / len(sizes), abs=1e-6) and r["coverage"] == pytest.approx(sum(x[2] for x in mine) / len(mine), abs=1e-6)


def test_static_baselines(spark):
    chunks = spark.createDataFrame([("domain/a.md", 5), ("domain/a.md", 1), ("domainx/b.md", 7), ("c.md", 2)], "doc_path string, tokens long")
    found = {r.scenario: (r.documents, r.sections, r.tokens) for r in evaluation.static_baselines(chunks, ["domain/", " ", "c.md"]).collect()}
    assert found == {"all": (3, 4, 15), "curated": (2, 3, 8)}
    assert [r.scenario for r in evaluation.static_baselines(chunks, []).collect()] == ["all"]


def test_ignored_and_removed(spark):
    pairs = "from_path string, to_path string"
    once = graph.ignore_links(spark.createDataFrame([("a", "b")], pairs), spark.createDataFrame([("a", "b"), ("b", "a")], pairs))
    assert sorted(map(tuple, once.collect())) == [("a", "b"), ("b", "a")]
    table = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    assert sorted(map(tuple, ingest.upsert(table, spark.createDataFrame([("b", 3), ("c", 4)], table.schema), "path").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [r.path for r in ingest.delete(table, spark.createDataFrame([("b",)], "path string"), "path").collect()] == ["a"]


def test_drift_listing(spark):
    rows = spark.createDataFrame([("b", 2, 5), ("a", 2, 5), ("c", 2, 9), ("d", 7, 1)], "path string, commits int, last_change int")
    assert [r.path for r in staleness.drift_listing(rows, 3).collect()] == ["d", "c", "a"]


def test_metrics_text(spark):
    rows = [("http", "search", 0.003, 10, 2, 1, False), ("http", "search", 9.0, 5, 1, 0, True)]
    calls = spark.createDataFrame(rows, "surface string, name string, seconds double, tokens long, chunks long, omitted long, error boolean")
    lines = [r.line for r in logs.prometheus(logs.series(calls)).collect()]
    name = '{surface="http",name="search"'
    assert lines[:3] == [f'lorespark_requests_total{name},status="ok"}} 1', f'lorespark_requests_total{name},status="error"}} 1', f"lorespark_tokens_total{name}}} 15"]
    assert f'lorespark_seconds_bucket{name},le="0.005"}} 1' in lines and lines[-2:] == [f"lorespark_seconds_sum{name}}} 9.003", f"lorespark_seconds_count{name}}} 2"]
