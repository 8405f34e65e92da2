"""Readers, times, rendered hits and polling."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import bundle, ingest
from lorespark.sources import markdown, markup
from lorespark.streaming import logs as S


def test_beir_folder(spark, tmp_path):
    write = lambda n, rows: (tmp_path / n).write_text("\n".join(map(json.dumps, rows)))
    write("corpus.jsonl", [{"_id": "d1", "title": "T", "text": "body one", "metadata": {}}, {"_id": "d2", "title": "", "text": "two"}])
    write("queries.jsonl", [{"_id": "q1", "text": "ask"}, {"_id": "q2", "text": "more"}])
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t0\nq2\td2\t1\n")
    corpus, queries, relevant = markdown.beir(spark, str(tmp_path))
    assert {tuple(r) for r in corpus.collect()} == {("domain/d1.md", "T", "body one"), ("domain/d2.md", "", "two")}
    assert {tuple(r) for r in queries.collect()} == {("q1", "ask"), ("q2", "more")}
    assert {tuple(r) for r in relevant.collect()} == {("q1", "domain/d1.md", 2), ("q2", "domain/d2.md", 1)}


@pytest.mark.parametrize("text,expected", [
    ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)), (" 2024-01-02T03:04:05.250+02:00", dt.datetime(2024, 1, 2, 1, 4, 5, 250000)),
    ("2024-01-02T03:04:05.000-0730", dt.datetime(2024, 1, 2, 10, 34, 5)), ("2024-01-02", None), ("2024-13-02T03:04:05Z", None), ("soon", None), ("", None), (None, None),
])
def test_times(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(T.parse_time(F.col("t")).alias("t")).first().t == expected


def test_rendered_hits(spark):
    hits = spark.createDataFrame([(1, 2, "domain/b.md", "B", "# B\nsecond", 3), (1, 1, "domain/a.md", "A > S", "first", 4), (2, 1, "domain/c.md", "C", "## only a heading", 5)], "query_id int, rank int, doc_path string, heading string, content string, tokens int")
    got = {r.query_id: r.text for r in bundle.render_hits(hits).collect()}
    assert got == {1: "2 section(s), ~7 tokens\n\n1. domain/a.md — A > S\nfirst\n\n2. domain/b.md — B\nsecond", 2: "1 section(s), ~5 tokens\n\n1. domain/c.md — C\n"}


def test_issue_and_page_tables(spark):
    raw = [json.dumps({"key": "A-1", "fields": {"summary": "S"}}), json.dumps({"key": "A-2"})]
    assert {tuple(r) for r in markup.issues(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()} == {("A-1", "A-1: S"), ("A-2", "A-2: ")}
    page = "<html><head><title>The page</title><style>x{}</style></head><body><p>Some &amp; text</p></body></html>"
    assert [tuple(r) for r in markup.page_hits(spark.createDataFrame([(7, page)], "page_id int, html string")).collect()] == [(7, "The page", "Some & text")]
    assert markup.html_to_markdown(spark.createDataFrame([(1, None), (2, "<h1>T</h1>")], "page_id int, html string")).orderBy("page_id").collect()[1].markdown == "# T"


def test_chunks_of_empty_documents(spark):
    rows = spark.createDataFrame([("domain/a.md", None, None), ("domain/b.md", "B", "")], "path string, title string, body string")
    assert ingest.chunk_documents(rows).count() == 0 and ingest.chunk_documents(rows.where("false")).count() == 0


def test_polling_runs_each_batch_once(spark, tmp_path):
    seen = []
    rows = spark.createDataFrame([(i,) for i in range(6)], "id long")
    for turn in range(2):
        rows.where(F.col("id") % 2 == turn).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.read_events(spark, str(tmp_path / "in"), rows.schema)
        S.poll(stream, lambda batch, n: seen.append((n, sorted(r.id for r in batch.collect()))), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert [ids for _, ids in sorted(seen)] == [[0, 2, 4], [1, 3, 5]]


def test_gap_candidates_and_served_windows(spark, tmp_path):
    at = dt.datetime(2024, 1, 10)
    log = spark.createDataFrame([(at + dt.timedelta(hours=h), q, "domain", r) for h, q, r in [(0, "a", 0), (1, "a", 0), (2, "b", 0), (3, "c", 2), (200, "a", 0)]], "at timestamp, query string, scopes string, results int")
    batch = {(r.start, r.query): r.times for r in S.gap_candidates(log).collect()}
    assert max(n for (_, q), n in batch.items() if q == "a") == 2 and all(q != "c" for _, q in batch) and len({s for s, q in batch if q == "b"}) == 7
    calls = spark.createDataFrame([(at, "x"), (at + dt.timedelta(minutes=10), "x"), (at + dt.timedelta(hours=30), "y")], "at timestamp, path string")
    served = S.served_now(calls).collect()
    assert {r.path: r.times for r in served if r.end == at + dt.timedelta(hours=24)} == {"x": 2} and max(r.times for r in served) == 2
    counts = spark.createDataFrame([("http", "a", 0.002, False), ("http", "a", 9.0, True)], "surface string, name string, seconds double, error boolean")
    one = S.series(counts).first()
    assert (one.requests, one.errors, one.le_0, one.le_1) == (2, 1, 0, 1) and one[f"le_{len(S.BOUNDS) - 1}"] == 1
