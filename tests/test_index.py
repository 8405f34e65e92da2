"""Snapshots, the index that changes as a whole, and bundles compiled with look-up."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import compile as C
from lorespark.operators import index
from lorespark.sources.snapshots import Conflict, Snapshots


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/store")


def numbers(store, name):
    return sorted(r[0] for r in store.table(name).collect())


def test_snapshots(spark, store, tmp_path):
    one, two = spark.range(3), spark.range(3, 7)
    assert store.version() == 0 and not store.has("a")
    assert store.commit({"a": one, "b": two}, {"k": "1", "l": "x"}) == 1
    old = store.latest()
    held = store.table("a")
    assert store.commit({"a": store.table("a").union(two)}, {"k": "2", "l": None}, on=old) == 2
    assert numbers(store, "a") == list(range(7)) and numbers(store, "b") == [3, 4, 5, 6] and (store.state("k"), store.state("l", "no")) == ("2", "no")
    # readers of the old version still see it
    assert held.count() == 3 and store.table("a", old).count() == 3
    with pytest.raises(Conflict):
        store.commit({"b": one}, on=old)
    assert numbers(store, "b") == [3, 4, 5, 6] and store.version() == 2


def test_a_writer_that_dies_changes_nothing(spark, store):
    store.commit({"a": spark.range(2), "b": spark.range(2)})
    fails = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("killed")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        store.commit({"a": spark.range(9), "b": fails})
    assert store.version() == 1 and numbers(store, "a") == [0, 1] and numbers(store, "b") == [0, 1]
    assert store.clean(keep=1) == 1 and numbers(store, "a") == [0, 1]


def docs(spark, texts, **more):
    rows = [(p, None, t, hashlib.sha256(t.encode()).hexdigest()) for p, t in texts.items()]
    return spark.createDataFrame(rows, "path string, title string, body string, content_hash string")


TEXTS = {"domain/a.md": "# A\nsee [[b]] and [c](c.md)\n## S\ntext", "domain/b.md": "# B\nback to [[a]]", "domain/c.md": "# C\nalone"}


def links(store):
    return {(r.from_path, r.target): r.to_path for r in store.table("links").collect()}


def test_documents_change_with_their_chunks_and_links(spark, store):
    index.upsert_documents(store, docs(spark, TEXTS), "c1")
    assert links(store) == {("domain/a.md", "b"): "domain/b.md", ("domain/a.md", "c.md"): "domain/c.md", ("domain/b.md", "a"): "domain/a.md"}
    assert store.table("chunks").where("doc_path = 'domain/a.md'").count() == 2
    chunks = store.table("chunks")
    store.commit({"vectors": chunks.select("chunk_id", F.lit("m").alias("model"))})
    index.upsert_documents(store, docs(spark, {"domain/a.md": "# A\nonly [[c]]"}), "c2")
    assert links(store) == {("domain/a.md", "c"): "domain/c.md", ("domain/b.md", "a"): "domain/a.md"}
    assert store.table("chunks").where("doc_path = 'domain/a.md'").count() == 1 and store.table("documents").count() == 3
    index.delete_documents(store, spark.createDataFrame([("domain/a.md",), ("no/such.md",)], "path string"))
    assert links(store) == {("domain/b.md", "a"): ""}
    assert {r.doc_path for r in store.table("chunks").collect()} == {"domain/b.md", "domain/c.md"} == {r.path for r in store.table("documents").collect()}
    assert {r.chunk_id for r in store.table("vectors").collect()} == {r.chunk_id for r in store.table("chunks").collect()}


def test_sync(spark, store):
    first = index.sync(store, docs(spark, TEXTS), "src", "c1", "t1")
    assert [first[k] for k in ("scanned", "indexed", "skipped", "deleted", "chunks")] == [3, 3, 0, 0, 4]
    bundles = spark.createDataFrame([("k", first["fingerprint"]), ("old", "else")], "cache_key string, fingerprint string")
    store.commit({"bundles": bundles})
    again = index.sync(store, docs(spark, TEXTS), "src", "c2", "t2")
    assert [again[k] for k in ("scanned", "indexed", "skipped", "deleted")] == [3, 0, 3, 0] and again["fingerprint"] == first["fingerprint"]
    assert store.table("bundles").count() == 2 and index.sync_state(store) == {"source": "src", "commit": "c2", "synced_at": "t2", "fingerprint": first["fingerprint"]}
    # older link rules: parsed again once, though nothing changed
    store.commit({"documents": store.table("documents").withColumn("link_rules", F.when(F.col("path") == "domain/b.md", index.LINK_RULES - 1).otherwise(index.LINK_RULES))})
    for expected in (1, 0):
        assert index.sync(store, docs(spark, TEXTS))["indexed"] == expected
    assert {r.cache_key for r in store.table("bundles").collect()} == {"k"}
    changed = {k: v for k, v in TEXTS.items() if k != "domain/c.md"} | {"domain/b.md": "# B\nnew", "projects/p/d.md": "[[b]]"}
    stats = index.sync(store, docs(spark, changed))
    assert [stats[k] for k in ("scanned", "indexed", "skipped", "deleted", "chunks")] == [3, 2, 1, 1, 2] and stats["fingerprint"] != first["fingerprint"]
    assert links(store) == {("domain/a.md", "b"): "domain/b.md", ("domain/a.md", "c.md"): "", ("projects/p/d.md", "b"): "domain/b.md"} and store.table("bundles").count() == 0
    lines = "".join(f"{p}\0{hashlib.sha256(t.encode()).hexdigest()}\n" for p, t in sorted(changed.items()))
    assert stats["fingerprint"] == hashlib.sha256(lines.encode()).hexdigest()[:16]
    assert index.sync(store, docs(spark, changed), force=True)["indexed"] == 3


# ---- bundles compiled with look-up ----
def sections(spark):
    r = random.Random(4)
    words = [f"term{i}" for i in range(25)]
    rows = [(f"c{i}", f"domain/d{i % 5}.md", f"domain/d{i % 5}.md", f"H{i}", ["domain", "conventions", "projects/x"][i % 3], i, " ".join(r.choice(words) for _ in range(30)), 60, dt.datetime(2024, 1, 2)) for i in range(40)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, doc_path string, heading string, scope string, position int, content string, tokens long, updated_at timestamp").cache()


TASK = "task_id int, task string, query string, scopes array<string>, paths array<string>, max_tokens long"


def tasks(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], TASK)


def test_compile_looks_up_before_it_computes(spark, store):
    chunks = sections(spark)
    asked = []

    def find(requests):
        asked.append(sorted(r.query_id for r in requests.collect()))
        return C.finder(chunks, docs=spark.createDataFrame([("domain/d1.md", ["svc/**"])], "path string, refs array<string>"))(requests)

    rows = [(1, "  term1 term2 "), (2, "term3", "term4 term5"), (3, "term1 term2", None, ["conventions", "domain", "domain "]), (4, "   "), (5, "term1 term2", None, None, ["./svc/x.go"]), (6, "term9", None, ["projects/x"], None, 300), (7, "zzz")]
    got = {r.task_id: r for r in C.compile_tasks(store, tasks(spark, rows), find, "f1", at="2024-03-01").collect()}
    assert {t: r.source for t, r in got.items()} == {1: "new", 2: "new", 3: "recent", 5: "new", 6: "new", 7: "new"}
    assert got[1].cache_key == got[3].cache_key == hashlib.sha256("\0".join(["v2", "term1 term2", "conventions,domain", "2000", "f1", "", ""]).encode()).hexdigest()
    other = "term3\0q:" + hashlib.sha256(b"term4 term5").hexdigest()
    assert got[2].cache_key == hashlib.sha256("\0".join(["v2", other, "conventions,domain", "2000", "f1", "", ""]).encode()).hexdigest()
    assert all(r.bundle_id == r.cache_key[:16] and r.tokens <= r.max_tokens * 0.95 for r in got.values())
    assert all(s.scope == "projects/x" for s in got[6].sections) and got[6].sections and all(f"{s.doc_path} — {s.heading}" in got[6].content for s in got[6].sections)
    assert got[7].sections == [] and "(no matching knowledge)" in got[7].content
    # sections of the document that governs the path come first
    assert {s.doc_path for s in got[5].sections[:1]} == {"domain/d1.md"} or "domain/d1.md" in {s.doc_path for s in got[5].sections}
    assert len(asked) == 1 and len(asked[0]) == 5

    def never(requests):
        raise AssertionError("nothing is to be retrieved")

    again = {r.task_id: r for r in C.compile_tasks(store, tasks(spark, rows), never, "f1").collect()}
    assert all(r.cached and r.source == "recent" and r.content == got[t].content and r.created_at == dt.datetime(2024, 3, 1) for t, r in again.items())
    assert {r.hits for r in store.table("bundles").collect()} == {0}
    # another state of the index: other keys
    assert {r.source for r in C.compile_tasks(store, tasks(spark, rows[:1]), find, "f2").collect()} == {"new"}
    C.invalidate(store)
    assert {r.source for r in C.compile_tasks(store, tasks(spark, rows[:1]), find, "f1").collect()} == {"new"} and store.table("bundles").count() == 1


def test_recent_bundles_against_a_loop(spark, store):
    """One call a task, as a service has them: what is held, what hits the table, and the table's hits."""
    chunks = sections(spark).limit(3)
    r = random.Random(6)
    held, table = [], {}
    for call in range(6):
        batch = [r.randint(1, 5) for _ in range(r.choice([1, 1, 1, 3]))]
        got = C.compile_tasks(store, tasks(spark, [(i, f"term{k}") for i, k in enumerate(batch)]), C.finder(chunks), "f", recent=2)
        expected, before = {}, list(held)
        for i, k in enumerate(batch):
            if k in batch[:i]:
                expected[i] = "recent"
            elif k in before:
                expected[i] = "recent"
            elif k in table:
                expected[i], table[k] = "table", table[k] + 1
            else:
                expected[i], table[k] = "new", 0
            held = [x for x in held if x != k] + [k]
        held = held[-2:]
        assert {x.task_id: x.source for x in got.collect()} == expected
        assert [x.task for x in store.table("recent").orderBy(F.desc("call"), "place").collect()] == [f"term{k}" for k in reversed(held)]
        assert {x.task: x.hits for x in store.table("bundles").collect()} == {f"term{k}": n for k, n in table.items()}


def test_tree_fingerprint_does_not_depend_on_rows_places(spark):
    from lorespark.operators import ingest

    rows = [(f"domain/{i}.md", f"h{i}") for i in range(300)]
    make = lambda r, n: ingest.tree_fingerprint(spark.createDataFrame(r, "path string, content_hash string").repartition(n), 16).first()[0]
    parts = {}
    for p, h in sorted(rows):
        parts.setdefault(int(hashlib.sha256(p.encode()).hexdigest()[:8], 16) % 16, []).append(f"{p}\0{h}\n")
    top = "".join(f"{k}\0{hashlib.sha256(''.join(v).encode()).hexdigest()}\n" for k, v in sorted(parts.items()))
    assert make(rows, 1) == make(rows[::-1], 7) == hashlib.sha256(top.encode()).hexdigest()[:16]
    assert make(rows[1:], 3) != make(rows, 3)
    store = Snapshots(spark, f"file://{__import__('tempfile').mkdtemp()}/s")
    assert index.sync(store, docs(spark, TEXTS), digest=ingest.tree_fingerprint)["fingerprint"] == ingest.tree_fingerprint(store.table("documents")).first()[0]


def test_token_bench_of_bundles(spark, store):
    from lorespark.operators.bench import bench

    chunks = sections(spark)
    golden = [(i, f"term{i} term{i + 3}", [(f"domain/d{i % 7}.md", [None, f"H{i}", "no such"][i % 3])]) for i in range(9)]
    table = spark.createDataFrame(golden, "query_id int, query string, expected array<struct<path:string,heading:string>>")
    got = {r.scenario: r for r in bench(store, chunks, table, C.finder(chunks), "f", (400, 150), ["domain/d1.md", " domain/d2.md "]).collect()}
    rows = chunks.collect()
    total = {p: sum(r.tokens for r in rows if r.doc_path == p) for p in {r.doc_path for r in rows}}
    fits = lambda e, have: any(p == e[0] and (e[1] is None or h.endswith(e[1])) for p, h in have)
    assert (got["all"].mean, got["all"].coverage, got["all"].documents) == (sum(total.values()), 1.0, 5)
    part = [(r.doc_path, r.heading) for r in rows if r.doc_path in ("domain/d1.md", "domain/d2.md")]
    assert got["curated"].max == total["domain/d1.md"] + total["domain/d2.md"]
    assert got["curated"].coverage == pytest.approx(sum(any(fits(e, part) for e in g[2]) for g in golden) / 9, abs=1e-6)
    scopes = sorted({r.scope for r in rows})
    for most in (400, 150):
        made = [C.compile_tasks(store, tasks(spark, [(1, q, None, scopes, None, most)]), None, "f").first() for _, q, _ in golden[:3]]
        assert all(m.cached and m.tokens <= most * 0.95 for m in made)  # the bench's own bundles
        bundles = {r.task: r for r in store.table("bundles").where(F.col("max_tokens") == most).collect()}
        sizes = sorted(bundles[q].tokens for _, q, _ in golden)
        covered = [any(fits(e, [(s.doc_path, s.heading) for s in bundles[q].sections]) for e in x) for _, q, x in golden]
        b = got[f"bundle-{most}"]
        assert (b.mean, b.median, b.max) == (pytest.approx(sum(sizes) / 9, abs=1e-6), sizes[4], sizes[-1]) and b.coverage == pytest.approx(sum(covered) / 9, abs=1e-6)
