"""URL verdicts: host and path rules first, else logistic regression on hashed character n-grams, all in JVM expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import session_of

#: (verdict, host, path prefix); at most MAX_RULES of them, as they become part of the plan.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MAX_RULES = 1000
#: Length of the hashed feature vector, and lengths of the n-grams.
DIMENSIONS = 4096
GRAMS = (3, 4, 5)

# The labelled URLs. Each host takes each path of its list.
BLOCK_HOSTS = ("cheap-pills.example.com", "www.cheap-pills.example.org", "spam-farm.example.net", "spam-farm.example.org", "casino-bonus.example.com", "best-casino.example.net", "adult-cams.example.org", "free-porn.example.com", "replica-watch.example.net", "payday-loans.example.org", "phish-login.example.com", "ads-tracker.example.net", "www.ads-track.example.com", "adult-x.example.org", "free-bets.example.net", "sports-bets.example.com", "casino-win.example.com", "malware-drop.example.net")
BLOCK_PATHS = ("/en/12", "/casino/win-bonus.html", "/buy-cheap-pills", "/xxx/video/3", "/login/verify-account.php", "/free-download-crack.exe", "/de/501/")
ALLOW_HOSTS = ("www.library.example.org", "news.daily.example.com", "blog.garden.example.net", "m.weather.example.com", "docs.project.example.org", "theron.example.net", "www.therin.example.com", "blog.tionble.example.org", "ththan.example.com", "university.example.net", "recipes.example.org", "museum.example.com", "m.ththan.example.net", "ththth.example.net", "www.thering.example.org", "thonth.example.org")
ALLOW_PATHS = ("/en/12", "/de/501/", "/fr/88.html", "/es/731", "/articles/history-of-maps.html", "/about", "/docs/install/guide")


def labelled(spark: SparkSession) -> DataFrame:
    rows = [{"url": f"https://{h}{p}", "label": y} for y, hosts, paths in ((1, BLOCK_HOSTS, BLOCK_PATHS), (0, ALLOW_HOSTS, ALLOW_PATHS)) for h in hosts for p in paths]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<url:string,label:double>>")
    return spark.range(1, numPartitions=1).select(F.inline(table))


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(whole, pattern, 1), upper, upper.lower()), F.regexp_extract(whole, pattern, 2)


def _slots(part: Column, mark: str) -> Column:
    """The hashed n-grams of one part, with its ends and its kind marked: characters are split once, and grams grow by shifted arrays."""
    letters = F.filter(F.split(F.concat(F.lit("^"), part, F.lit("$")), ""), lambda c: c != "")

    def longer(grams: Column, n: int) -> Column:
        """The grams of n characters from those of n - 1; null where the next character is missing."""
        shifted = F.slice(letters, n, F.greatest(F.size(letters) - n + 1, F.lit(0)))
        return F.zip_with(grams, shifted, lambda gram, c: F.concat(gram, c))

    found, grams = [], letters
    for n in range(2, max(GRAMS) + 1):
        grams = longer(grams, n)
        if n in GRAMS:
            found.append(F.filter(grams, lambda gram: gram.isNotNull()))
    return F.transform(F.concat(*found), lambda gram: F.pmod(F.xxhash64(F.lit(mark), gram), F.lit(DIMENSIONS)).cast("int"))


def slots(host: Column, path: Column) -> Column:
    return F.concat(_slots(host, "h"), _slots(path, "p"))


def train(table: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[float], float]:
    """Weights and intercept from a small labelled table (url, label): L-BFGS with an L2 penalty, in one partition."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    names = slots(*host_and_path(F.col("url"))).cast("array<string>")
    vectors = CountVectorizerModel.from_vocabulary(list(map(str, range(dimensions))), inputCol="slots", outputCol="features").setBinary(True)
    data = vectors.transform(table.select("label", names.alias("slots")).coalesce(1))
    model = LogisticRegression(maxIter=40, regParam=0.003, standardization=False).fit(data)
    return [round(w, 9) for w in model.coefficients.toArray().tolist()], round(model.intercept, 9)


def score(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    margin = F.aggregate(F.array_distinct(slots(host, path)), F.lit(float(intercept)), lambda total, i: total + F.element_at(table, i + 1))
    return 1 / (1 + F.exp(-margin))


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the plan takes at most {MAX_RULES}")
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        found, verdict = F.when(fits, F.lit(rule_host + prefix)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def filter_urls(pages: DataFrame, rules=RULES, table: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict (allow or block), score (0 to 1, higher: block).

    A null URL and one without :// have an empty host and path; no rule fits them and the score is that of empty parts.
    Of rules of one length the later in the list wins. Repeated rows are judged each alike; URLs of any length are judged
    whole. An empty table gives no rows. Other columns are ignored. The model is fitted on the small labelled table when
    the query is built; its weights, of fixed number, are part of the plan.
    """
    weights, intercept = train(labelled(session_of(pages)) if table is None else table)
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scored = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_by_rule"), score(F.col("host"), F.col("path"), weights, intercept).alias("score"))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", learned).alias("verdict"), "score")
