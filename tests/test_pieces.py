"""Mentions of names and subword pieces against brute force."""

import random
import re
from itertools import product

import pytest

from lorespark.functions import pieces
from lorespark.operators import graph, logs, mentions


def test_names_against_regular_expressions():
    r = random.Random(1)
    parts = ["late fee", "late", "fee late", "(fee", "c++", "größe", "x_y", "a.b", "late late", "fees)"]
    for _ in range(400):
        names = r.sample(parts, r.randint(1, 8))
        text = "".join(r.choice([*parts, " ", " ", "-", "s", "_", "\n", "é", "9", "late late late"]) for _ in range(r.randint(0, 30)))
        expected = {n: k for n in names if (k := len(re.findall(r"\b" + re.escape(n) + r"\b", text, re.ASCII)))}
        assert mentions.count_names(mentions.automaton(names), text) == expected
    assert mentions.count_names(mentions.automaton([]), "text") == {}


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_mentions_in_several_passes(spark, most):
    texts = spark.createDataFrame([("a", "late fees and late fees"), ("b", None), ("c", "nothing"), ("d", "refunds; late-fees, refunds")], "path string, text string")
    names = spark.createDataFrame([(n,) for n in ["late fees", "refunds", "refunds", "fees", "chargeback", "invoices"]], "name string")
    got = {(r.path, r.name): r.mentions for r in mentions.mentions(texts, names, most).collect()}
    assert got == {("a", "late fees"): 2, ("a", "fees"): 2, ("d", "refunds"): 2, ("d", "fees"): 1}
    assert mentions.mentions(texts, names.where("false")).count() == 0


def test_names_by_hashes_against_regular_expressions(spark, monkeypatch):
    monkeypatch.setattr(mentions, "BLOCK", 200)
    r = random.Random(2)
    parts = ["late fee", "late", "fee late", "(fee", "c++", "größe", "x_y", "a.b", "late late", "fees)"]
    texts = [(str(i), "".join(r.choice([*parts, " ", " ", "-", "s", "_", "\n", "é", "9", "late late late"]) for _ in range(r.randint(0, 30)))) for i in range(150)]
    got = mentions.mentions(spark.createDataFrame(texts, "path string, text string"), spark.createDataFrame([(p,) for p in parts], "name string"), 0).collect()
    expected = {(i, n): k for i, text in texts for n in parts if (k := len(re.findall(r"\b" + re.escape(n) + r"\b", text, re.ASCII)))}
    assert {(x.path, x.name): x.mentions for x in got} == expected and len(got) == len(expected)
    # the names' map lets through little else, and the automaton finds the same
    runs, bits = mentions._name_map(spark.createDataFrame([(p,) for p in parts], "name string"))
    assert set().union(*mentions.likely_names([t.encode() for _, t in texts], runs, bits)) <= {p.encode() for p in parts}


@pytest.mark.parametrize("limit", [1, 7, 40, 5000])
def test_suggestions_among_many_of_one_title(spark, limit):
    r = random.Random(limit)
    titles = ["Same title", "Other title", "Rare title"]
    docs = [(f"d/{i:02d}.md", t := titles[0] if i % 3 else r.choice(titles), f"{t}. " + " ".join(r.choice([*titles, "none"]) for _ in range(r.randint(0, 5)))) for i in range(60)]
    known = [(docs[i][0], docs[j][0]) for i in range(0, 60, 7) for j in range(60) if i != j and (i + j) % 4]
    frame = spark.createDataFrame(docs, "path string, title string, body string")
    pairs = spark.createDataFrame(known, "from_path string, to_path string")
    both = {*known, *((b, a) for a, b in known)}
    found = [(-k, a, b) for a, _, body in docs for b, t, _ in docs if a != b and (a, b) not in both and (k := body.lower().count(t.lower()))]
    got = [(-x.mentions, x.from_path, x.to_path) for x in graph.suggest_links(frame, pairs, pairs.where("false"), limit).collect()]
    assert got == sorted(found)[:limit]
    # of rows that name a document, few are left to be joined with all documents of that name
    counted = mentions.mentions(frame.select("path", mentions.plain_text(frame["body"]).alias("text")), mentions.document_names(frame)).withColumnRenamed("path", "from_path")
    left = graph.leading(counted, mentions.document_names(frame), pairs, limit).count()
    assert left <= counted.count() and (limit > 7 or left < 40)


def test_ignored_pairs_are_cleared(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "b")], "from_path string, to_path string")
    assert graph.clear_ignored(pairs).count() == 0
    assert [tuple(r) for r in graph.clear_ignored(pairs, spark.createDataFrame([("a",)], "path string")).collect()] == [("d", "b")]


def test_proposals_are_put(spark):
    kinds = "id string, status string, created_at int"
    old = spark.createDataFrame([("p1", "merged", 1)], kinds)
    put = logs.put_proposals(old, spark.createDataFrame([("p2", None, 2), ("p3", "", 3), ("p4", "closed", 4)], kinds))
    assert {r.id: r.status for r in put.collect()} == {"p1": "merged", "p2": "open", "p3": "open", "p4": "closed"}
    with pytest.raises(Exception, match="proposal exists: p1"):
        logs.put_proposals(old, spark.createDataFrame([("p1", "open", 2)], kinds)).collect()


VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "##a", "a", "b", "##b", "##c", "ab", "##abc", ".", "größ", "gro", "##ss", "中", "!", "uber"]


def test_wordpiece():
    model = pieces.WordPiece(VOCABULARY, 12)
    show = lambda t: [VOCABULARY[i] for i in model.text(t)]
    assert show("Unaffable. AB\tÜber中中!\x00") == ["un", "##aff", "##able", ".", "ab", "uber", "中", "中", "!"]
    assert show("ax b" + "b" * 12 + " �") == ["[UNK]", "[UNK]"] and show("  \n") == []
    r = random.Random(2)
    for _ in range(500):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        out, rest, mark = [], word, ""
        while rest:
            fits = [p for p in VOCABULARY if p.startswith(mark) and (mark or not p.startswith("##")) and p[len(mark) :] and rest.startswith(p[len(mark) :])]
            if not fits:
                out = ["[UNK]"]
                break
            out.append(max(fits, key=len))
            rest, mark = rest[len(out[-1]) - len(mark) :], "##"
        assert show(word) == out


def every_cut(word):
    for cuts in product([0, 1], repeat=len(word) - 1):
        out = [word[0]]
        for c, cut in zip(word[1:], cuts):
            if cut:
                out.append(c)
            else:
                out[-1] += c
        yield out


@pytest.mark.parametrize("inner", [False, True])
def test_unigram_against_all_segmentations(inner):
    r = random.Random(3)
    table = [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0)] + [(p, -r.random() * 5) for p in ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab", "aa", "c"]] + ([("b▁a", -0.5)] if inner else [])
    model = pieces.Unigram(table, 0, 1, 2)
    scores = dict(table)
    assert model.by_word != inner
    for _ in range(250):
        text = " ".join("".join(r.choice("abcx") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 2)))
        run = "".join("▁" + w for w in text.split())
        # a character is unknown only where no piece starts
        strange = lambda i: not any(run[i:].startswith(p) for p in scores if not p.startswith("<"))
        best = None
        for cut in every_cut(run):
            total, ids, at = 0.0, [], 0
            for p in cut:
                if p in scores:
                    total, k = total + scores[p], model.ids[p]
                elif len(p) == 1 and strange(at):
                    total, k = total + model.worst, 0
                else:
                    break
                ids.append(k)
                at += len(p)
            else:
                if best is None or total > best[0] + 1e-9:
                    best = (total, ids)
        merged = [k for i, k in enumerate(best[1]) if k or i == 0 or best[1][i - 1]]
        assert model.text(text) == merged


def test_encode(spark):
    rows = spark.createDataFrame([(1, "un ab ab ab"), (2, None), (3, "")], "id long, text string")
    table = spark.createDataFrame(list(enumerate(VOCABULARY)), "id int, piece string")
    got = {r.id: r.ids for r in pieces.encode(rows, "id", "text", pieces.wordpiece(table), most=5).collect()}
    assert got == {1: [2, 4, 12, 12, 3], 2: [2, 3], 3: [2, 3]}
    scored = spark.createDataFrame([(i, p, -1.0) for i, p in enumerate(["<unk>", "<s>", "</s>", "▁", "a", "▁ab"])], "id int, piece string, score double")
    got = {r.id: r.ids for r in pieces.encode(spark.createDataFrame([(1, "ab  ａzz​")], "id long, text string"), "id", "text", pieces.unigram(scored)).collect()}
    assert got == {1: [1, 5, 3, 4, 0, 2]}


@pytest.mark.parametrize("least", [0.3, 0.85])
def test_near_duplicates_against_all_pairs(spark, least):
    from lorespark.operators import bundle

    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(r.sample(words, r.randint(0, 8)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200, None), (201, "the of")]
    sets = {i: set((t or "").split()) for i, t in rows}
    got = {(x.a, x.b): x.jaccard for x in bundle.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", least).collect()}
    expected = {}
    for a, b in product(sets, sets):
        if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
            expected[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert got == pytest.approx(expected) and len(got) > 5


@pytest.mark.parametrize("scoped,block", [(False, 4096), (True, 4096), (True, 3)])
def test_vector_search_against_a_loop(spark, monkeypatch, scoped, block):
    from lorespark.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERIES", block)
    r = random.Random(6)
    some = lambda n=4: [r.choice([-1.0, -0.5, 0.25, 0.5]) for _ in range(n)]
    rows = [(f"c{i}", some(), i % 3) for i in range(120)] + [("n", None, 1), ("short", [1.0], 1), ("nan", [1.0, float("nan"), 0.0, 0.0], 1), ("empty", [], 0), ("unscoped", some(), None)]
    asked = [(q, some(), [[0], [1, 2], [], None, [7]][q % 5]) for q in range(10)] + [(50, [2.0], [1]), (51, None, [1])]
    got = retrieval.vector_topk(spark.createDataFrame(rows, "chunk_id string, embedding array<float>, scope int").repartition(3), spark.createDataFrame(asked, "query_id long, qe array<double>, scopes array<int>"), 7, scoped)
    expected = set()
    for q, e, scopes in asked:
        found = [(round(sum(a * b for a, b in zip(e, v)), 6), c) for c, v, s in rows if e and v and len(v) == len(e) and not any(x != x for x in v) and (not scoped or (s is not None and s in (scopes or [])))]
        for rank, (score, c) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:7], 1):
            expected.add((q, c, score, rank))
    assert {(x.query_id, x.chunk_id, x.score, x["rank"]) for x in got.collect()} == expected


@pytest.mark.parametrize("scoped,block,cells", [(False, 4096, 1 << 19), (True, 4096, 5), (True, 3, 40)])
def test_lexical_search_against_a_loop(spark, monkeypatch, scoped, block, cells):
    from math import log

    from lorespark.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERIES", block)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    monkeypatch.setattr(retrieval, "ROWS", 7)
    r = random.Random(8)
    words = ["refund", "order", "fee", "late", "straße", "x9", "rule"]
    chunks = [(f"c{i:02d}", r.choice(["en", "fr", None]), r.choice([None, "Order", "late fee"]), " ".join(r.choice(words) for _ in range(r.randint(0, 6)))) for i in range(70)] + [("n", "en", None, None)]
    chunks[:0] = [(f"a{i}", "en", None, "nothing") for i in range(30)]  # stretches without any term that is asked for
    asked = [(q, " ".join(r.choice([*words, "absent"]) for _ in range(r.randint(1, 4))), [["en"], ["en", "fr"], [], None][q % 4]) for q in range(9)] + [(50, "?!", ["en"]), (51, None, ["en"])]
    frames = spark.createDataFrame(chunks, "chunk_id string, scope string, heading string, content string").repartition(3), spark.createDataFrame(asked, "query_id long, query string, scopes array<string>")
    hits = retrieval.bm25(*frames, 5, scoped)
    expected, split = set(), {c: [*((w.lower(), 3.0) for w in (h or "").split()), *((w, 1.0) for w in (t or "").split())] for c, _, h, t in chunks}
    average = sum(map(len, split.values())) / len(split)
    for q, text, scopes in asked:
        terms, found = [w for w in (text or "").split() if w != "?!"], []
        for c, scope, _, _ in chunks:
            f = {w: sum(x for v, x in split[c] if v == w) for w in {*terms}}
            score = 0.0
            for w in terms:
                n = sum(any(v == w for v, _ in each) for each in split.values())
                idf = log((len(split) - n + 0.5) / (n + 0.5))
                score += (idf if idf > 0 else 1e-6) * f[w] * 2.2 / (f[w] + 1.2 * (0.25 + 0.75 * len(split[c]) / average)) if f[w] else 0
            if any(f.values()) and (not scoped or scope in (scopes or [])):
                found.append((not all(f.values()), -round(score, 6) + 0.0, c))
        expected |= {(q, c, -score, not some, rank) for rank, (some, score, c) in enumerate(sorted(found)[:5], 1)}
    assert {(x.query_id, x.chunk_id, x.score, x.all_terms, x["rank"]) for x in hits.collect()} == expected and len(expected) > 15
    # what a query scores is not shuffled or joined: only each task's best rows are
    assert "Join" not in hits._jdf.queryExecution().executedPlan().toString()


def test_the_best_rows_in_bounded_memory(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lorespark.operators import best

    monkeypatch.setattr(best, "WAITING", 50)
    r = np.random.default_rng(3)
    score, whole, inside = r.integers(0, 9, (500, 6)) / 4, r.random((500, 6)) < 0.2, r.random((500, 6)) < 0.7
    held, most = best.Best(6, 4), 0
    for a, z in best.stretches(np.arange(0, 5001, 10), 7, 55):
        assert 0 < z - a <= 5
        held.offer(pa.array(range(a, z)), score[a:z], whole[a:z], inside[a:z])
        most = max(most, held.size + (held.held.num_rows if held.held is not None else 0))
    got = [x for part in held.rows() for x in zip(*(c.to_pylist() for c in part))]
    expected = [(q, i, score[i, q], bool(whole[i, q])) for q in range(6) for i in sorted(np.flatnonzero(inside[:, q]).tolist(), key=lambda i: (not whole[i, q], -score[i, q], i))[:4]]
    assert got == expected and most < 120


def test_sections_of_bundles_are_not_shuffled(spark, monkeypatch):
    from lorespark.operators import compile

    seen, kept = [], compile.written
    monkeypatch.setattr(compile, "written", lambda df: seen.append(df) or kept(df))
    chunks = spark.createDataFrame([(i, "d", "d.md", "H", "en", i, f"late fees {i}", 3) for i in range(60)], "chunk_id long, doc_id string, doc_path string, heading string, scope string, position int, content string, tokens long")
    asked = spark.createDataFrame([("a", "late fees", ["en"]), ("b", "fees 7", ["en"]), ("c", "fees", ["fr"])], "query_id string, query string, scopes array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = compile.finder(chunks)(asked.withColumn("paths", asked["scopes"])).collect()
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in "ab" for k in range(1, 41)]
    assert all(r.content == f"late fees {r.chunk_id}" for r in got)
