"""Every operator against a brute-force version on rows with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorespark.llm import anchors, bm25_search, bpe, common, exact_dedup, graph, licenses, mixing, ngram_join, repeats, sharding, toxicity, url_filter

SPACE = re.compile(r"[\x20\x09-\x0D]")


def lists(df):
    return [tuple(r) for r in df.collect()]


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r[1] or "")].append(r)
    expected = Counter()
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is not None, r[0] or 0))[0]
        done = False
        for r in members:
            kept = r[0] == keep and not done
            done |= kept
            expected[(r[0], keep, len(members), kept, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert Counter(lists(exact_dedup.exact_dedup(docs))) == expected
    weak = exact_dedup.exact_dedup(docs, digest=lambda t: F.unhex(F.lit("00")))  # all texts collide
    assert Counter(lists(weak)) == expected
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert lists(exact_dedup.exact_dedup(empty)) == [] and lists(exact_dedup.deduplicate(empty)) == []


def test_sharding(docs, rows, empty):
    got = lists(sharding.shard(docs, 4))
    assert Counter((g[0], g[1], g[2]) for g in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = defaultdict(list)
    for g in got:
        by[g[4]].append(g)
    for members in by.values():
        assert sorted(g[5] for g in members) == list(range(len(members)))
    ids = [sorted(-1 if g[0] is None else g[0] for g in by[k]) for k in sorted(by)]
    assert all(a[-1] <= b[0] for a, b in zip(ids, ids[1:]))
    sizes = [sum(g[1] for g in m) for m in by.values()]
    assert max(sizes) - sum(sizes) / 4 <= max(g[1] for g in got)
    assert lists(sharding.shard(empty)) == []


def test_shards_by_brute_force(docs, rows):
    """A row is in the shard in which the middle of its bytes falls."""
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16)
    ordered = sorted(map(key, rows))
    total, at, expected, count = sum(k[3] for k in ordered), 0, Counter(), Counter()
    for k in ordered:
        shard = min(6, (2 * at + k[3]) * 7 // (2 * total))
        expected[(k[1] if k[0] else None, k[3], k[2], shard, count[shard])] += 1
        count[shard] += 1
        at += k[3]
    got = Counter((g.doc_id, g["size"], g.text_crc32, g.shard, g.slot) for g in sharding.shard(docs, 7).collect())
    assert got == expected


def water_fill(sizes, weights, most=3):
    """Reshares the excess by weight, round after round."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


def test_mixing(docs, rows, empty):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, water_fill([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    got = mixing.mix(docs).collect()
    assert Counter((g.doc_id, g.size, g.source) for g in got) == Counter((r[0], size(r[1]), r[3]) for r in rows)
    taken = Counter()
    for g in got:
        assert g.source_size == total[g.source] and g.target == pytest.approx(target[g.source])
        assert 0 <= g.taken <= 3 * g.size
        taken[g.source] += g.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    assert Counter(got) == Counter(mixing.mix(docs).collect())
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert lists(mixing.mix(empty)) == [] and lists(mixing.apply_mix(empty)) == []


def test_urls(spark, empty):
    urls = ["https://shop.example.com/en/7", "http://A.Example.NET/de/81?x", "https://x.example.net/de/7", "https://b.org/es/1", "https://cheap-pills.example.com/fr/2", None, "no scheme", "http://notcom/en/", "ftp://com#x", "https://www.library.example.org/fr/3?q=://y", ""]
    pages = spark.createDataFrame([(i, u, "x", None) for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert [got[i].rule for i in range(5)] == ["example.com/en/7", "example.net/de/8", "net/de/", "org/es/", None]
    assert [got[i].verdict for i in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert got[1].host == "a.example.net" and got[1].path == "/de/81" and (got[5].host, got[5].path, got[6].host) == ("", "", "")
    assert got[7].rule is None and (got[8].host, got[8].path) == ("com", "") and got[9].verdict == "allow" and got[9].path == "/fr/3"
    assert len(got) == 12 and url_filter.filter_urls(pages.limit(0)).count() == 0


def test_urls_by_brute_force(spark):
    """Longest rules, grams and scores against plain Python, on hosts and paths made of the rules' own parts and on a long URL."""
    import itertools
    import time

    hosts = ["com", "Example.com", "a.example.com", "net", "x.net", "example.net", "b.example.net", "org", "o.org", "xcom", "", "é.org"]
    paths = ["", "/", "/en/", "/en/7", "/en/71", "/de/", "/de/8", "/de/7/8", "/es/", "/es", "/en/7?q=/de/", "/ü/en/"]
    urls = [f"https://{h}{p}" for h, p in itertools.product(hosts, paths)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([(f"https://{h}{p}", float(i % 2)) for i, (h, p) in enumerate(itertools.product(hosts, paths))], "url string, label double")
    weights, intercept = url_filter.train(table, 512) if url_filter.DIMENSIONS == 512 else url_filter.train(table)
    grams_of = lambda s: [s[i : i + n] for n in url_filter.GRAMS for i in range(len(s) - n + 1)]
    each = {(m, g) for u in urls for m, part in zip("hp", _host_path(u)) for g in grams_of(f"^{part}$")}
    slot = {(r.m, r.g): r.s for r in spark.createDataFrame(list(each), "m string, g string").selectExpr("m", "g", f"cast(pmod(xxhash64(m, g), {url_filter.DIMENSIONS}) as int) s").collect()}
    for r in url_filter.filter_urls(pages, table=table).collect():
        host, path = _host_path(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        margin = intercept + sum(weights[i] for i in {slot[m, g] for m, part in zip("hp", (host, path)) for g in grams_of(f"^{part}$")})
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-9
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "block" if r.score >= 0.5 else "allow"))
    long = spark.createDataFrame([(1, "https://a.b/" + "é" * 400_000)], "page_id long, url string")
    began = time.time()
    assert url_filter.filter_urls(long, table=table).collect()[0].path == "/" + "é" * 400_000
    assert time.time() - began < 60


def _host_path(url):
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_url_model_on_other_hosts(spark):
    bad = ["https://pills-cheap.example.org/fr/1", "https://www.casino-night.example.net/de/3", "https://spam-farm2.example.com/es/4", "https://adult-x9.example.com/de/1"]
    good = ["https://www.theatre.example.org/fr/1", "https://blog.ththe.example.com/de/3", "https://news.example.net/about", "https://m.garden.example.org/es/9"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    got = [r.verdict for r in url_filter.filter_urls(pages, rules=()).orderBy("page_id").collect()]
    assert sum(g == w for g, w in zip(got, ["block"] * 4 + ["allow"] * 4)) >= 7


def test_licenses(docs, rows, empty):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    for r in rows:
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        places = sorted((i, x) for p, x in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        g = by[r[0]]
        assert (g.n_words, g.n_base) == (len(words), len(places))
        assert (g.first_word, g.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert g.base_labels == ",".join(sorted({x for _, x in places})) and set(g.base_labels.split(",")) <= set(g.labels.split(",")) | {""}
    assert licenses.scan_licenses(empty).collect() == []


def test_fuzzy_notices():
    scan = licenses.Scanner().scan
    assert scan("Permission is herby granted, free of charge to any person obtaning a copy")["labels"] == "mit"
    assert scan("under the mozila public licence")["labels"] == "mpl"
    assert scan("permission was not granted")["labels"] == ""
    assert scan("mit license mit license")["n_base"] == 2
    for notice in (n for _, n, e in licenses.NOTICES):
        assert "".join(p for _, p in licenses.pieces(notice, 3)) == notice


def test_notices_by_edit_distance():
    """Every span is within its notice's errors; a notice with few enough errors and no others near it is found in place."""
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    r, scanner = random.Random(4), licenses.Scanner()
    for _ in range(150):
        label, notice, errors = r.choice(licenses.NOTICES)
        damaged = list(notice)
        for _ in range(r.randint(0, errors)):
            at = r.randrange(len(damaged))
            kind = r.randrange(3)
            damaged[at : at + (kind != 1)] = [] if kind == 0 else [r.choice("qxz")]
        before, after = ["filler"] * r.randint(0, 9), ["other"] * r.randint(0, 9)
        words = [*before, *"".join(damaged).split(), *after]
        spans = scanner.scan(" ".join(words))["spans"]
        assert any(s["label"] == label for s in spans)
        for s in spans:
            found = " ".join(words[s["first_word"] : s["last_word"] + 1])
            assert any(x == s["label"] and distance(found, n) == s["errors"] <= e for x, n, e in licenses.NOTICES)


def test_many_phrases_take_linear_time():
    import time

    began = time.time()
    got = licenses.Scanner().scan("mit license " * 100_000)
    assert got["n_base"] == 100_000 and got["last_word"] == 199_998 and time.time() - began < 60


def test_inexact_notices_beside_better_ones():
    def spans(text):
        return [(s["first_word"], s["last_word"], s["label"], s["errors"]) for s in licenses.Scanner().scan(text)["spans"]]

    assert spans("mit licence mit license") == [(0, 1, "mit", 1), (2, 3, "mit", 0)]
    assert spans("mit licence foo mit license bar mit licens") == [(0, 1, "mit", 1), (3, 4, "mit", 0), (6, 7, "mit", 1)]
    many = ["mit licence", "mit licens"] * 40 + ["mit license"] + ["mit lisense"] * 40
    assert spans(" ".join(many)) == [(2 * i, 2 * i + 1, "mit", int(x != "mit license")) for i, x in enumerate(many)]
    free = "permission is herby granted free of charge to any person obtaning a copy"
    assert [s[2:] for s in spans(f"{free} {free.replace('herby', 'hereby')} {free}")] == [("mit", 2), ("mit", 1), ("mit", 2)]
    assert spans("mit licensees") == []


def brute_shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_components(sets):
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def test_ngram_join(docs, rows, empty):
    sets = {r[0]: brute_shingles(r[1]) for r in rows if r[0] is not None}
    comp = brute_components(sets)
    got = ngram_join.ngram_join(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is None:
            assert g.component_id is None
        else:
            assert (g.n_shingles, g.component_id) == (len(sets[g.doc_id]), comp[g.doc_id] if sets[g.doc_id] else g.doc_id)
    left = {r.doc_id for r in ngram_join.keep_one(docs).collect()}
    assert left == {d for d in comp if comp[d] == d or not sets[d]} | {None}
    assert ngram_join.ngram_join(empty).collect() == []


def test_ngram_join_of_chains_and_groups(spark):
    """Near copies with more and more edits: links only along a chain and across a large group."""
    import random

    r = random.Random(3)
    word = lambda: "w" + str(r.randint(0, 5000))
    texts, base = [], [word() for _ in range(120)]
    for i in range(60):
        t = list(base)
        for _ in range(r.randint(0, 7)):
            t[r.randrange(120)] = word()
        texts.append(" ".join(t))
    step = [word() for _ in range(100)]
    for i in range(15):
        step = step[2:] + [word() for _ in range(2)]
        texts.append(" ".join(step))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    comp = brute_components({i: brute_shingles(t) for i, t in enumerate(texts)})
    assert {g.doc_id: g.component_id for g in ngram_join.ngram_join(docs).collect()} == comp


def test_ngram_join_of_a_hot_text_and_a_longer_one(spark):
    """A text with many copies needs many matches, a longer one near the threshold needs one: the lesser need holds."""
    hot = [f"h{i}" for i in range(99)]
    longer = hot + [f"own{i}" for i in range(31)]
    far = hot[:60] + [f"far{i}" for i in range(50)]
    texts = [" ".join(longer), " ".join(far)] + [" ".join(hot)] * 1000
    sets = {i: brute_shingles(t) for i, t in enumerate(texts[:3])}
    comp = brute_components(sets)
    assert comp == {0: 0, 1: 1, 2: 0} and len(sets[0]) == 126 and len(sets[2]) == 95
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {g.doc_id: g.component_id for g in ngram_join.ngram_join(docs).collect()} == {i: comp[min(i, 2)] for i in range(len(texts))}


def _random_sets(rng, n_sets=60):
    """Sets of tokens, some linked, some with many tokens in common with others that are not."""
    common = np.unique(rng.integers(0, 1 << 63, 120, dtype=np.uint64) * np.uint64(2))
    out = []
    while len(out) < n_sets:
        n = int(rng.integers(1, 200))
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        if rng.random() < 0.5:
            own = np.unique(np.concatenate([own, rng.choice(common, int(rng.integers(1, 120)), replace=False)]))
        out.append(own)
        for _ in range(int(rng.integers(0, 3))):
            out.append(np.unique(np.concatenate([own[rng.random(len(own)) > 0.12], rng.integers(0, 1 << 62, max(1, n // 20), dtype=np.uint64)])))
    return [s for s in out if len(s)]


def _counted(sets, counter, batch=5):
    """What counting finds of sets that are each a component: {set: (tokens, counts)}."""
    found = defaultdict(list)

    def take(reps, tokens, counts):
        for i, t, c in zip(reps.tolist(), tokens.view(np.uint64).tolist(), counts.tolist()):
            found[i].append((t, c))

    for at in range(0, len(sets), batch):
        some = sets[at : at + batch]
        owner = np.concatenate([np.full(len(s), i, np.int64) for i, s in enumerate(some, at)])
        for part in counter.add(np.concatenate(some).tobytes(), owner.tobytes(), owner.tobytes()):
            take(*part)
    take(*counter.end())
    return {i: tuple(np.array(x, t) for x, t in zip(zip(*sorted(found[i])), (np.uint64, np.int64))) if i in found else (np.empty(0, np.uint64), np.empty(0, np.int64)) for i in range(len(sets))}


@pytest.mark.parametrize("held,cap", [(1 << 22, 1 << 16), (50, 6)])
def test_prefix_filter_is_safe(monkeypatch, held, cap):
    """Linked sets share at least min(L) prefix tokens, whatever each chooses and however tokens are counted."""
    monkeypatch.setattr(ngram_join, "HELD", held)
    monkeypatch.setattr(ngram_join, "CAP", cap)
    rng = np.random.default_rng(1)
    linked = 0
    for _ in range(6):
        sets = _random_sets(rng)
        counted = _counted(sets, ngram_join.Counter())
        holders = Counter(t for s in sets for t in s.tolist())
        for tokens, counts in counted.values():  # counts are the real lengths of the tokens' lists
            assert all(c == min(holders[t], cap) for t, c in zip(tokens.tolist(), counts.tolist()))
        chosen = [ngram_join.choose(len(s), *counted[i]) for i, s in enumerate(sets)]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    linked += 1
                    (la, pa, xa), (lb, pb, xb) = chosen[i], chosen[j]
                    assert len(np.intersect1d(pa, pb)) >= min(la, lb)
                    # the bound by position holds wherever the two prefixes meet
                    for t in np.intersect1d(pa, pb):
                        u, v = pa.tolist().index(t), pb.tolist().index(t)
                        assert min(u, v) + min(len(a) - xa[u], len(b) - xb[v]) >= both
    assert linked > 50


def test_prefixes_adapt_to_the_lists():
    """A step in the lists' lengths keeps prefixes short, even lists lengthen them; a set of its own tokens meets nobody."""
    tokens = np.arange(1, 41, dtype=np.uint64)
    mixed = ngram_join.choose(40, tokens, np.where(tokens <= 12, 30, 3000))
    even = ngram_join.choose(40, tokens, np.full(40, 5000))
    assert mixed[0] <= 2 < 10 < even[0] and len(mixed[1]) == 10 + mixed[0] and len(even[1]) == 10 + even[0]
    assert len(ngram_join.choose(40, tokens[:29], np.full(29, 2))[1]) == 0


def test_rows_split_by_keys(spark):
    docs = spark.createDataFrame([(i, f"t{i}", i, i) for i in range(-300, 300)] + [(None, "none", 0, 0)], "doc_id long, text string, row int, slot int")
    asked = spark.createDataFrame([(i,) for i in range(-300, 300, 7)], "id long")
    inside, outside = common.split_by_keys(docs, "doc_id", asked, "id")
    got, rest = {r.doc_id for r in inside.collect()}, {r.doc_id for r in outside.collect()}
    assert got >= set(range(-300, 300, 7)) and len(got) < 90 and got | rest == {*range(-300, 300), None} and not got & rest
    assert inside.columns == outside.columns == docs.columns
    inside, outside = common.split_by_keys(docs, "doc_id", asked.where("id is null").union(spark.createDataFrame([(None,)], "id long")), "id")
    assert None in {r.doc_id for r in inside.collect()} and outside.count() > 500
    assert common.split_by_keys(docs, "doc_id", asked.limit(0), "id")[0].collect() == []


def test_stages_keep_clashing_columns(spark):
    names = ["row", "of", "id", "same", "kept", "sha", "size", "taken", "copy", "mix_id", "gone_id", "slot", "part", "marks", "_sha", "_taken", "_copy", "digest", "norm"]
    r = lambda i, t, s: (i, t, s, *(f"{n}{i}" for n in names))
    rows = [r(1, "a b c d e f g", "x"), r(2, "a b c d e f g", "x"), r(3, None, None), r(4, "one two", "y"), r(4, "other words here", "y"), r(None, "null id", "z"), r(5, "a b c d e f g h", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for stage in (exact_dedup.deduplicate, ngram_join.keep_one, mixing.apply_mix):
        left = stage(docs)
        assert left.columns == docs.columns
        for g in left.collect():
            assert all(g[n] == f"{n}{g.doc_id}" for n in names)
    assert Counter(g.doc_id for g in exact_dedup.deduplicate(docs).collect()) == Counter({1: 1, 3: 1, 4: 2, None: 1, 5: 1})
    assert Counter(g.doc_id for g in ngram_join.keep_one(docs).collect()) == Counter({1: 1, 3: 1, 4: 2, None: 1})


def test_mixed_rows_have_exact_budgets(docs, rows):
    counted = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    left = Counter()
    for g in mixing.apply_mix(docs).collect():
        left[g.source] += len(re.findall(r"[^\x20\x09-\x0D]+", g.text))
    # rows 9 stand three times and share their words evenly
    assert all(0 <= g.n - left[g.source] < 3 for g in counted) and sum(left.values()) > 0


def test_ngram_join_of_repeated_ids(spark):
    """Rows under one doc_id are one document in links, whatever their texts."""
    word = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(5, word("a")), (5, word("b")), (3, word("b") + " more"), (9, word("a")), (7, word("c")), (5, word("a")), (4, word("d"))]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((g.doc_id, g.component_id) for g in got) == Counter({(5, 3): 3, (3, 3): 1, (9, 3): 1, (7, 7): 1, (4, 4): 1})


@pytest.mark.parametrize("members", [3, 1024])
def test_verification_of_a_hub(spark, monkeypatch, members):
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)] + [" ".join(base[: 100 - 3 * i]) for i in range(1, 21)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [brute_shingles(t) for t in texts]
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 21)], "a long, b long")
    expected = {(i, 0) for i in range(1, 21) if 100 * len(sets[i] & sets[0]) >= 75 * len(sets[i] | sets[0])}
    assert {tuple(r) for r in ngram_join.verified(docs, pairs, 5, 75).collect()} == expected and 0 < len(expected) < 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def brute_kept(texts, length=200):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [repeats.without(t, [(i, i + length) for i in range(len(t) - length + 1) if starts[t[i : i + length]] > 1]) for t in texts]


@pytest.mark.parametrize("bucket", [2, 1024])
def test_repeats(docs, rows, empty, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "LEAST_BUCKET", bucket)
    monkeypatch.setattr(repeats, "MOST_BUCKET", bucket)
    texts = [(r[1] or "").encode() for r in rows]
    expected = Counter((r[0], len(t), len(t) - len(k), n, k) for r, t, (k, n) in zip(rows, texts, brute_kept(texts)))
    got = Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, bytes(g.kept)) for g in repeats.dedup_repeats(docs).collect())
    assert got == expected
    assert repeats.dedup_repeats(empty).collect() == []


def test_maximal_repeats_hold_all_occurrences():
    left, core = [x + b"q" * 30 for x in (b"aX", b"bX", b"cY")], b"0123456789" * 18
    bucket = repeats.Bucket([(x, core + y) for x, y in zip(left, (b"kl", b"km", b"n"))], 200)
    found = {(a, b, tuple(sorted(m.tolist()))) for a, b, m in bucket.maximal()}
    assert found == {(30, 180, (0, 1, 2)), (31, 181, (0, 1))}


@pytest.mark.parametrize("bucket", [2, 1024])
def test_maximal_repeats_of_copies_and_hot_passages(spark, empty, monkeypatch, bucket):
    """Each group is a string with all its places; each maximal repeat gives a group for each anchor of its own."""
    import random

    monkeypatch.setattr(repeats, "LEAST_BUCKET", bucket)
    monkeypatch.setattr(repeats, "MOST_BUCKET", bucket)
    length, reach = 40, 40 - anchors.GRAM
    r = random.Random(8)
    word = lambda n, of="abcdefgh": "".join(r.choice(of) for _ in range(n))
    hot, copied, wide = word(42), word(90), word(60)
    texts = [word(r.randint(0, 12), "xy") + hot + word(r.randint(0, 12), "xy") for _ in range(14)] + [copied] * 3
    texts += [word(20) + wide + word(9) + wide[:50], "y" + wide, "q" + copied[10:70] + "q", "z" * 60, word(39), None, ""]
    rows = [*enumerate(texts), (3, texts[3])]
    places = defaultdict(list)
    for d, t in rows:
        for i in range(len(t or "")):
            for j in range(i + length, len(t) + 1):
                places[t[i:j]].append((d, i, t[i - 1] if i else None, t[j] if j < len(t) else None))
    unlike = lambda ends: len(set(ends)) > 1 or None in ends
    expected = set()
    for w, at in places.items():
        if len(at) > 1 and unlike([x[2] for x in at]) and unlike([x[3] for x in at]):
            expected |= {w[max(0, a - reach) : a + length] for a in anchors.anchors(w.encode(), length)[0].tolist()}
    groups = defaultdict(list)
    text_of = dict(enumerate(texts))
    for g in repeats.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect():
        groups[g.bucket, g.repeat, text_of[g.doc_id][g.start : g.start + g.length]].append((g.doc_id, g.start))
    assert len({k[:2] for k in groups}) == len(groups)
    for (_, _, w), at in groups.items():
        assert sorted(at) == sorted(x[:2] for x in places[w])
    assert {w for *_, w in groups} == expected and len(expected) > 10
    assert repeats.maximal_repeats(empty).collect() == []


def test_anchors_depend_on_content():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 123, 400, dtype=np.uint8).tobytes()
    a = rng.integers(97, 123, 777, dtype=np.uint8).tobytes() + shared
    b = shared + rng.integers(97, 123, 50, dtype=np.uint8).tobytes()
    pa_, pb = anchors.anchors(a, 200)[0] - 777, anchors.anchors(b, 200)[0]
    for s in range(201):
        inside = lambda p: {int(x) for x in p if s <= x <= s + 200 - anchors.GRAM}
        assert inside(pa_) & inside(pb)
    anchors_whole = anchors.anchors(a * 3, 200)
    assert len(anchors_whole[0]) == len(set(anchors_whole[0].tolist()))


def test_bpe(docs, rows, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    expected = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected[(r[0], tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((g.doc_id, tuple(g.ids), g.decoded) for g in bpe.bpe(docs, path).collect()) == expected
    digest = bpe.digests(bpe.bpe(docs, path)).where("doc_id = 4").first()
    ids = library.encode("two words", add_special_tokens=False).ids
    assert digest.n_tokens == len(ids) and digest.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.bpe(empty, path).collect() == []


def test_bpe_files_with_other_settings_are_refused():
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check_supported(spec)
    for part, key, value in ((spec, "normalizer", None), (spec, "decoder", {"type": "ByteLevel"}), (spec["model"], "byte_fallback", True), (spec["added_tokens"][0], "lstrip", True)):
        with pytest.raises(ValueError):
            was, part[key] = part[key], value
            try:
                bpe.check_supported(spec)
            finally:
                part[key] = was


def test_bpe_on_random_texts():
    import random

    P = pytest.importorskip("public_tokenizers")
    coder = bpe.model(P.path("word_bpe_49k.json"))
    r = random.Random(4)
    for _ in range(1500):
        text = "".join(r.choice("ab'sltre 01é́ 　\xa0<|>endoftxIİΣσ.,!\n\t\x1c\x1f\x00ßÀ😀") for _ in range(r.randint(0, 40)))
        ids = coder.library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids and coder.decode(ids) == coder.library.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_are_no_merges():
    P = pytest.importorskip("public_tokenizers")
    coder = bpe.model(P.path("word_bpe_49k.json"))
    fragments, last, word = coder.cuts("hello qzxjq")
    assert "".join(f + (" " if e else "") for f, e in zip(fragments, last)).strip() == "hello qzxjq" and len(fragments) > 2 and word[-1] == 1


def test_toxicity(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(40)] + [(None, 1, 1.0), (3, None, 1.0)], "doc_id long, toxic int, score double")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for g in got:
        assert 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) and g.toxic == (g.score >= g.threshold)
        assert g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 4 == 2)
    assert toxicity.score_toxicity(empty, labels).collect() == [] and toxicity.score_toxicity(docs, labels.limit(0)).count() == len(rows)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(g.doc_id for g in got if not g.toxic)


def test_toxicity_learns(spark):
    import random

    r = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(1500):
        text = [r.choice(words) for _ in range(r.randint(20, 120))]
        if i % 5 == 0:
            text[r.randrange(len(text))] = r.choice(["jerk,", "Fool", "lout"])
        rows.append((i, " ".join(text), "en"))
        marks.append((i, int(i % 5 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = [g for g in toxicity.score_toxicity(docs, labels).collect() if g.held_out]
    right = sum(g.predicted == (g.doc_id % 5 == 0) for g in got)
    assert right / len(got) > 0.97


def test_thresholds_go_both_ways():
    """Languages whose best cut is below and above the common threshold, and one with too few positives."""
    clean, toxic = np.linspace(0.01, 0.1, 60), np.linspace(0.16, 0.28, 30)
    score = np.concatenate([clean, toxic, clean + 0.4, toxic + 0.5, clean, toxic[:5]])
    label = np.concatenate([np.repeat([0.0, 1.0], [60, 30]), np.repeat([0.0, 1.0], [60, 30]), np.repeat([0.0, 1.0], [60, 5])])
    got = toxicity._calibrated(score, label, np.repeat(["low", "high", "few"], [90, 90, 65]))
    # the third language has too few positives of its own: all rows together give its cut
    assert set(got) == {"low", "high", None} and 0.1 < got["low"] < 0.16 and 0.5 < got["high"] < 0.66
    f1 = lambda cut, here: 2 * label[here][score[here] >= cut].sum() / ((score[here] >= cut).sum() + label[here].sum())
    assert all(f1(got[n], at) > f1(toxicity.THRESHOLD, at) for n, at in (("low", slice(0, 90)), ("high", slice(90, 180))))
    assert toxicity._calibrated(score[:60], label[:60], np.repeat(["few"], 60)) == {}
    model = toxicity.Classifier([toxicity.Network(2, np.random.default_rng(0))], np.zeros(toxicity.SPACE, np.int32), got)
    assert model.threshold("low") < toxicity.THRESHOLD and model.threshold("few") == model.threshold(None) == got[None]
    assert toxicity.Classifier(model.nets, model.rows, {}).threshold("low") == toxicity.THRESHOLD


def test_convolution_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network(30, rng)
    net.embed = net.embed.astype(np.float64)
    texts, y = [rng.integers(1, 30, n).astype(np.int32) for n in (0, 1, 5, 17)], np.array([0.0, 1, 1, 0])
    loss = lambda: -np.mean(y * np.log(s := net.forward(texts)) + (1 - y) * np.log(1 - s))
    grads = net.gradients(texts, y)
    for which, at in ((-2, 5), (1, (3, 2)), (0, (int(texts[2][1]), 2))):
        p = net.parameters()[which]
        old, step = p[at], 1e-3
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert grads[which][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_batches_are_small(spark):
    """What tasks and the JVM hand each other is bounded, whatever a bucket of tokens holds; no row is lost or moved."""
    common.ship_code(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 2 << 20
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 20_000))) for i in range(10)], "doc_id long, text string").coalesce(1)
    placed = spark.createDataFrame([(r.doc_id, r.n, r.set, r.doc_id) for r in ngram_join._signatures(docs, 5, 1.0).collect()], "rep long, n long, set binary, comp long")
    rows = ngram_join._shared(ngram_join._entries(docs, placed, 5, 1.0), tokens=True)
    assert rows.count() == 10 * 19_996 - 2 * 3  # the first and the last text have 3 shingles that no other has
    batch = pa.RecordBatch.from_pydict({"x": [bytes(300_000)] * 20 + [b""] * 3, "n": list(range(23))})
    parts = list(ngram_join._small(batch))
    assert len(parts) > 4 and [n for p in parts for n in p.column(1).to_pylist()] == list(range(23))
    assert list(ngram_join._small(batch.slice(0, 0))) == []


def test_slots_need_no_memo():
    """Words of their own cost neither a miss nor memory that stays; slots are those of the words without punctuation at their ends."""
    import tracemalloc

    texts = [" ".join(f"({i}w{j}!)" for j in range(400)).encode() for i in range(60)]
    toxicity.slots(texts[0])
    tracemalloc.start()
    for t in texts:
        toxicity.slots(t)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100_000
    bare = [re.sub(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", b"", w.lower()) for w in (b"A.B.", b"\"...\"", b"--\xc3\x89--", b"don't", b"_x_")]
    assert toxicity.slots(b'A.B.\x0b"..." --\xc3\x89--\tdon\'t _x_ ').tolist() == [zlib.crc32(w) % toxicity.SPACE if w else 0 for w in bare]
    assert toxicity.slots(b" \n").tolist() == []


def test_convolution_against_loops():
    """Scores by plain loops over texts, widths, filters and places; those kept for the gradient are the same."""
    rng = np.random.default_rng(3)
    net = toxicity.Network(40, rng)
    net.bias = [rng.normal(0, 0.1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    texts = [rng.integers(0, 40, n).astype(np.int32) for n in (0, 1, 2, 3, 9, 0, 25)]
    expected = []
    for t in texts:
        x = net.embed[np.append(t, np.zeros(2, np.int32))]
        pooled = []
        for w, k, b in zip(toxicity.WIDTHS, net.filters, net.bias):
            # as many starts as the text has words, and one more: that of padding alone
            padded = np.concatenate([x, np.zeros((3, toxicity.DIM))])
            pooled += [max(0.0, max(float(padded[s : s + w].ravel() @ k[:, f]) for s in range(len(t) + 1)) + b[f]) for f in range(toxicity.FILTERS)]
        expected.append(1 / (1 + np.exp(-(np.array(pooled) @ net.out + net.base[0]))))
    assert net.forward(texts) == pytest.approx(expected, abs=1e-5)
    assert net.forward(texts, keep=True)[0] == pytest.approx(expected, abs=1e-5)


def test_bm25_memory(spark, monkeypatch):
    """An index row holds a part of a shard; a query of very many terms looks up a bounded number of cells at once, with the same result."""
    import tracemalloc

    rng = np.random.default_rng(5)
    bags = bm25_search._bags(spark.createDataFrame([(i, " ".join(f"w{j}" for j in rng.integers(0, 900, 120))) for i in range(200)], "doc_id long, text string"))
    rows = bm25_search._index(bags).collect()
    assert len(rows) % bm25_search.PIECES == 0
    sizes = [len(r.terms) for r in rows]
    assert max(sizes) <= 8 * (sum(sizes) // 8 // bm25_search.PIECES + 1)

    n, vocabulary = 4000, 3000
    docs = np.tile(np.arange(0, n, 100, dtype=np.int32), vocabulary)  # too rare for the table
    terms = np.repeat(np.arange(vocabulary), n // 100)
    shard = bm25_search.Shard(np.arange(n), terms, docs, rng.integers(1, 9, len(docs)).astype(np.int32), rng.integers(50, 90, n), 70.0)
    at, idf, wanted = np.arange(vocabulary), rng.random(vocabulary), np.arange(0, n, 2)
    tracemalloc.start()
    found, read = shard._full(at, idf, wanted)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(bm25_search, "CELLS", 1 << 60)
    whole, n_whole = shard._full(at, idf, wanted)
    assert read == n_whole and found == pytest.approx(whole, abs=1e-9) and most < 30 << 20


def test_bm25_search(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(bm25_search, "BLOCK", 4)
    monkeypatch.setattr(bm25_search, "STEP", 2)
    monkeypatch.setattr(bm25_search, "POSTINGS", 200)
    monkeypatch.setattr(bm25_search, "TERMS", 300)
    bags = [(r[0], Counter((r[1] or "").encode().lower().split())) for r in rows]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    queries = docs.where("doc_id % 4 = 0").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("query_id"), "text", "score")
    expected = Counter()
    for q in queries.collect():
        asked = set((q.text or "").encode().lower().split())
        scored = []
        for d, b in bags:
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in asked if w in b)
            if s > 0:
                scored.append((-round(s, 6), d is not None, d))
        for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:10]):
            expected[(q.query_id, d, -s, i + 1)] += 1
    got = Counter((g.query_id, g.doc_id, g.score, g["rank"]) for g in bm25_search.search(docs, queries).collect())
    assert got == expected
    assert bm25_search.search(empty, queries).collect() == [] and bm25_search.search(docs, queries.limit(0)).collect() == []


def test_block_max_wand_is_exact_and_saves_work(monkeypatch):
    """On random shards in turn: the k best by brute force, ties by id, with fewer postings read; a running threshold saves more."""
    monkeypatch.setattr(bm25_search, "BLOCK", 8)
    monkeypatch.setattr(bm25_search, "FIRST", 2)
    monkeypatch.setattr(bm25_search, "STEP", 2)
    rng = np.random.default_rng(3)
    read, alone, all_postings = 0, 0, 0
    for _ in range(5):
        shards, bags = [], {}
        for number in range(4):
            n = 500
            sets = [np.sort(rng.choice(np.arange(i % 4 * 3000, i % 4 * 3000 + 3000), 30, replace=False)) for i in range(n)]
            ids = rng.permutation(n) + number * n
            sets = [sets[i] for i in np.argsort([i % 4 for i in range(n)], kind="stable")]
            bags |= {int(i): (set(t.tolist()), 1) for i, t in zip(ids, sets)}
            terms, docs = np.concatenate(sets), np.repeat(np.arange(n), 30)
            by = np.lexsort((docs, terms))
            shards.append(bm25_search.Shard(ids, terms[by], docs[by], np.ones(len(by), np.int32), np.full(n, 30.0), 30.0))
        query = np.sort(rng.choice(3000, 200, replace=False))
        idf = np.where(np.arange(200) % 8, np.round(rng.random(200) * 0.3, 1), 5.0)
        weight = dict(zip(query.tolist(), idf.tolist()))
        expected = sorted(((-round(sum(weight.get(t, 0) for t in b), 6), i) for i, (b, _) in bags.items()))[:5]
        best = None
        for shard in shards:
            *best, scored = shard.search(query, idf, 5, tuple(best) if best else None)
            read += scored
            alone += shard.search(query, idf, 5)[2]
            all_postings += sum(len(b & set(query.tolist())) for i, (b, _) in bags.items() if i in shard.ids)
        assert [(-s, i) for i, s in zip(best[0].tolist(), best[1].tolist())] == expected
    assert read < alone < all_postings
