"""The pipeline's stages in turn on awkward rows, and its result against what the stages' operators decide."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages(spark, docs, rows, folder):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, folder)
        assert after.columns == docs.columns
        whole = {r[1] for r in rows}
        # a mix may end in a document's first words
        heads = {" ".join(t.split()) for t in whole if t} if name == "mixing" else set()
        assert all(r.text in whole or any(h.startswith(r.text) for h in heads) for r in after.collect())
        now = after
    result = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert Counter(r.doc_id for r in result.collect()) == Counter(r.doc_id for r in now.collect())


def test_empty(spark, empty, folder):
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
    assert now.count() == 0


def test_run(spark, folder):
    import re

    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0
    assert all(re.fullmatch("[0-9a-f]{64}", r.ids_sha256) for r in got.collect())


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


# ---- decisions of the stages against plain Python ----
def texts():
    import random

    r = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(25, 60))) for _ in range(30)]
    out = list(base)
    for b in base[:12]:
        w = b.split()
        out += ["  ".join(w), " ".join([*w, "tail"]), " ".join([*w[:-1], "x"]), " ".join(w[: len(w) // 2])]
    out += [" ".join(r.choice(words) for _ in range(20)) + " vile insult" for _ in range(60)] + ["clean words " + b for b in base[:6]] + [None, "", " \n", "few words", "few words"]
    r.shuffle(out)
    return [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "ü"][i % 4] if i % 5 else "a") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("plain"))
    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int("insult" in (t or ""))) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def squeezed(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def kept_copies(rows):
    groups = {}
    for r in rows:
        groups.setdefault(squeezed(r[1]), []).append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]


def kept_near(rows):
    sets = {}
    for r in rows:
        w = (r[1] or "").lower().split()
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def mixed(rows):
    import hashlib

    count = lambda r: len((r[1] or "").split())
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(count(r) for r in rows if r[3] == s) for s in sources}
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(sources)}
    full, total = set(), sum(size.values())
    while True:
        free = [s for s in sources if s not in full]
        left = total - sum(3 * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        if not (over := {s for s in free if share[s] > 3 * size[s]}):
            break
        full |= over
    out = Counter()
    for s in sources:
        budget = int((3 * size[s] if s in full else share[s]) + 0.5)
        order = sorted((r for r in rows if r[3] == s and count(r)), key=lambda r: (hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest(), r[0]))
        while budget:
            for r in order:
                some = min(budget, count(r))
                if some:
                    out[(r[0], r[1] if some == count(r) else " ".join(r[1].split()[:some]))] += 1
                budget -= some
    return out


def test_decisions(spark, plain):
    from tokenizers import Tokenizer

    import public_tokenizers

    from lorespark.llm import toxicity
    from lorespark.llm.catalog import TOKENIZER
    from lorespark.llm.common import materialize, read

    stages = dict(corpus_pipeline.STAGES)
    docs = read(spark, plain, "documents")
    model = toxicity.train(docs, read(spark, plain, "labels"))
    rows = [tuple(r) for r in docs.collect()]
    left = {"toxicity": [r for r in rows if model.score([(r[1] or "").encode()])[0] < model.threshold(r[2])]}
    gone = {r[0] for r in rows} - {r[0] for r in left["toxicity"]}
    assert len(gone) > 30 and len(gone & {r[0] for r in rows if "insult" in (r[1] or "")}) > 0.8 * len(gone)
    left["exact dedup"] = kept_copies(left["toxicity"])
    left["n-gram Jaccard join"] = kept_near(left["exact dedup"])
    assert len(left["n-gram Jaccard join"]) < len(left["exact dedup"]) < len(left["toxicity"])
    now = docs
    for name, expected in left.items():
        now = materialize(stages[name](spark, now, plain))
        assert Counter(map(tuple, now.collect())) == Counter(expected), name
    now = materialize(stages["mixing"](spark, now, plain))
    expected = mixed(left["n-gram Jaccard join"])
    assert Counter((r.doc_id, r.text) for r in now.collect()) == expected
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    import hashlib

    digests = Counter()
    for (i, t), n in expected.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        digests[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += n
    assert Counter(map(tuple, stages["BPE"](spark, now, plain).collect())) == digests
    assert Counter(map(tuple, corpus_pipeline.run(spark, plain).collect())) == digests
