import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cutting import first_tokens
from lorespark.functions import stemming
from lorespark.functions import text as T


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, (list, tuple)) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


TOKENS = [("", 0), ("hello", 1), ("internationalization", 3), ("\n\n\n", 1), ("don't", 1), ("1234567", 3), ("größe", 2), ("!!!???!", 3), ("a  b", 2), ("١٢٣", 1), ("x\r\ny", 3)]


@pytest.mark.parametrize("text,count", TOKENS)
def test_tokens(spark, text, count):
    assert one(spark, T.token_count(F.col("t")), t=text) == count == T.count_tokens(text)


def test_token_count_of_random_texts(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abé 12\n'!İ-日_") for _ in range(r.randint(0, 60))) for _ in range(400)]
    got = [x.n for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.token_count(F.col("t")).alias("n")).collect()]
    assert got == [T.count_tokens(t) for t in texts]
    for t in texts:
        assert T.count_tokens(t[: len(t) // 2]) <= T.count_tokens(t)


def test_terms(spark):
    assert one(spark, T.terms(F.col("t")), t="How do we refund the Order, order?") == ["refund", "order", "order"]
    assert one(spark, T.terms(F.col("t")), t="What is THE") == ["what", "is", "the"]
    assert one(spark, T.terms(F.col("t")), t="İADE süresi kaç gün") == ["iade", "süresi", "gün"]
    assert one(spark, T.term_set(F.col("t")), t="b a b") == ["b"]


@pytest.mark.parametrize("glob,path,hit", [
    ("src/**", "src/a/b.go", True), ("src/*.go", "src/a.go", True), ("src/*.go", "src/a/b.go", False), ("**/x.go", "x.go", True), ("**/x.go", "a/b/x.go", True), ("src", "src/a.go", True), ("src/", "src/a/b", True),
    ("src", "srcs/a", False), ("a?.go", "ab.go", True), ("a?.go", "a/.go", False), ("./src/a.go", "src/a.go", True), ("/src/*", "src/x", True), ("", "a", False), ("a.b", "axb", False), ("svc/**/main.go", "svc/main.go", True),
])
def test_glob(spark, glob, path, hit):
    assert one(spark, F.rlike(F.col("p"), T.glob_regex(F.col("g"))), g=glob, p=path) is hit


def test_small_functions(spark):
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 1.0
    assert one(spark, T.body(F.col("t")), t="## Head\n\ntext\nmore\n") == "text\nmore"
    assert one(spark, T.one_line(F.col("t"), 10), t="a  b -- c\nlonger text") == "a b — c l…"
    assert one(spark, T.preview(F.col("t"), 5), t="# h\n\nbody text") == "body …"
    assert [one(spark, T.scope_of(F.col("p")), p=p) for p in ("domain/a.md", "projects/x/a.md", "projects/a.md", "other/a.md", "domain")] == ["domain", "projects/x", None, None, None]
    assert one(spark, T.normalized_list(F.col("s")), s=[" b", "a", "", "b "]) == ["a", "b"]
    assert one(spark, T.normalized_paths(F.col("s")), s=["./b\\c", "a"]) == ["a", "b/c"]
    assert one(spark, T.chunk_id(F.col("p"), F.col("h"), F.lit(0)), p="a.md", h="H") == hashlib.sha256(b"a.md\0H\0" + b"0").hexdigest()[:16]
    assert one(spark, T.budget(F.lit(2000)), x=1) == 1900 and one(spark, T.budget(F.lit(0)), x=1) == 1
    assert one(spark, T.route_name(F.col("r")), r="GET /api/docs/{path...}") == "api_docs_path" and one(spark, T.route_name(F.col("r")), r="GET /") == "root"
    assert one(spark, T.mention_names(F.col("p"), F.col("t")), p="domain/late-fees.md", t="Refunds: the rules") == ["refunds: the rules", "refunds", "late fees"]
    assert [one(spark, T.valid_doc_path(F.col("p")), p=p) for p in ("domain/a.md", "/domain/a.md", "domain/../a.md", "x/a.md", "projects/p/q/r.md", "domain/a.txt")] == [True, True, False, False, True, False]
    assert one(spark, T.cql(F.col("q"), F.col("s")), q='a "b"\n c', s=["X"]) == 'type = page AND siteSearch ~ "a \\"b\\" c" AND space IN ("X")'
    none = F.lit(None).cast("string")
    assert one(spark, T.jql(F.col("q"), F.col("p"), none, F.col("k"), F.lit("me"), F.lit(True)), q="a+b", p=["x"], k="Bug") == 'project IN ("X") AND text ~ "a b" AND issuetype = "Bug" AND assignee = currentUser() AND statusCategory != Done ORDER BY updated DESC'
    assert one(spark, T.jql(none, F.col("p"), none, none, none, F.lit(False)), p=[]) is None
    assert one(spark, T.allowed(F.col("a"), F.col("b")), a=["x"], b=["X", "Y"]) == ["X"] and one(spark, T.allowed(F.col("a"), F.col("b")), a=["z"], b=["X"]) is None
    assert one(spark, T.clean_excerpt(F.col("t")), t="@@@hl@@@a@@@endhl@@@ &amp;  b") == "a & b"


def test_section_header(spark):
    at = F.expr("timestamp'2024-03-04 10:00:00'")
    assert one(spark, T.section_header(F.lit("p"), F.lit("h"), F.lit(None).cast("timestamp"), F.lit(0), at), x=1) == "## p — h"
    assert one(spark, T.section_header(F.lit("p"), F.lit("h"), at, F.lit(1), at), x=1) == "## p — h (updated 2024-03-04; code changed since: 1 commit, last 2024-03-04)"


def test_fit(spark):
    got = one(spark, T.fit_lines(F.col("t"), F.lit(4)), t="a b\nc\nd e f\ng")
    assert (got.text, got.tokens) == ("a b\nc", 4)
    assert T.count_tokens(first_tokens("word " * 50, 7)) <= 7


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("hopeful", "hope"), ("goodness", "good"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("café", "cafe")])
def test_porter(word, stem):
    assert stemming.porter(word) == stem


def test_stop_words_are_plain():
    assert len(set(T.STOP_WORDS)) == len(T.STOP_WORDS) and all(re.fullmatch(r"\w+", w) for w in T.STOP_WORDS)
