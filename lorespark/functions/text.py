"""Scalar text functions as JVM column expressions. A null argument gives null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that queries drop, in English and Turkish.
STOP_WORDS = (
    "a an the and or but if of to in on at by for with from as is are was were be been being "
    "do does did done have has had having can could should would will shall may might must "
    "i we you he she it they me us them my our your his her its their this that these those "
    "what which who whom whose when where why how there here then than so not no yes "
    "am up out about into over after before again still also just very too any some all each "
    "ve veya ile bir bu şu o için mi mı mu mü ne nedir nasıl neden niye kaç hangi ki de da "
    "ben biz sen siz onlar var yok gibi kadar sonra önce ama fakat"
).split()

# Names too general to count as a mention of a document.
GENERIC_NAMES = ("readme", "index", "overview", "notes", "glossary", "introduction")

# The shortest mention in bytes, the share of a budget that may be filled, room a cut text needs, its mark.
SHORTEST_MENTION, BUDGET_SHARE, LEAST_ROOM, CUT_MARK = 5, 0.95, 40, "\n[… truncated]"

TOKEN_RUNS = r"(\n[\n\r]*|\p{L}[\p{L}\x27]*|\p{Nd}+|[^\p{L}\p{Nd}\s\x{85}\p{Z}]+)"
WORDS = r"[\p{L}\p{Nd}]+"


def token_count(text: Column) -> Column:
    """Estimated tokens: a run of line ends is one, white space none, an ASCII word up to 8 letters one, longer ones and others by length."""
    size = F.char_length
    return F.aggregate(
        F.regexp_extract_all(text, F.lit(TOKEN_RUNS), F.lit(1)),
        F.lit(0).cast("long"),
        lambda total, run: total
        + F.when(F.ascii(run) == 10, 1)
        .when(run.rlike(r"^\p{L}") & run.rlike(r"^[\x00-\x7F]+$"), F.when(size(run) <= 8, 1).otherwise(F.ceil(size(run) / 7.0)))
        .otherwise(F.ceil(size(run) / 3.0))
        .cast("long"),
    )


def lower(text: Column) -> Column:
    """Lower case, with the dotted capital I as one plain letter."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower(text), F.lit(WORDS), F.lit(0))


def terms(text: Column) -> Column:
    """Query terms in order with repeats; if only function words are left, all words."""
    all_words = words(text)
    kept = F.filter(all_words, lambda w: ~w.isin(STOP_WORDS))
    return F.when(F.size(kept) == 0, all_words).otherwise(kept)


def term_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(terms(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def body(content: Column) -> Column:
    """Without the heading line it may start with."""
    trimmed = F.regexp_replace(content, r"^\s+|\s+$", "")
    return F.when(trimmed.startswith("#"), F.regexp_replace(F.regexp_replace(trimmed, r"^[^\n]*(\n|$)", ""), r"^\s+|\s+$", "")).otherwise(trimmed)


def one_line(text: Column, most: int = 120) -> Column:
    flat = F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("--"), F.lit("—"))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def preview(content: Column, most: int) -> Column:
    """The first line that is neither blank nor a heading, cut to most characters."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return F.when(F.char_length(first) > most, F.concat(F.substring(first, 1, most), F.lit("…"))).otherwise(first)


def glob_regex(glob: Column) -> Column:
    """* and ? stay in a path segment, ** spans segments, **/ may match nothing; without wildcards a path and all below it."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(glob), r"^\./", ""), "^/", "")
    quoted = F.regexp_replace(plain, r"([.+()\[\]{}^$|\\])", r"\\$1")
    wild = quoted
    # marks stand for parts until single wildcards are replaced
    for pattern, into in ((r"\*\*/", "\x01"), (r"\*\*", "\x02"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\x01", "(.*/)?"), ("\x02", ".*")):
        wild = F.regexp_replace(wild, pattern, into)
    prefix = F.concat(F.lit("^"), F.regexp_replace(quoted, "/$", ""), F.lit("(/.*)?$"))
    return F.when(plain == "", F.lit("^$")).when(plain.rlike(r"[*?]"), F.concat(F.lit("^"), wild, F.lit("$"))).otherwise(prefix)


def glob_prefix(glob: Column) -> Column:
    """The directories that a glob names before its first wildcard; empty if it starts with one."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(glob), r"^\./", ""), "^/", "")
    head = F.regexp_extract(plain, r"^([^*?]*)", 1)
    return F.when(plain.rlike(r"[*?]"), F.regexp_replace(F.regexp_extract(head, r"^(.*/)?", 1), "/$", "")).otherwise(F.regexp_replace(plain, "/$", ""))


def scope_of(path: Column) -> Column:
    """domain, conventions or projects/<name> by the path; null for what is not knowledge."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    first = F.get(parts, F.lit(0))
    return (
        F.when(first.isin("domain", "conventions") & (F.size(parts) >= 2), first)
        .when((first == "projects") & (F.size(parts) >= 3), F.concat(F.lit("projects/"), F.get(parts, F.lit(1))))
        .otherwise(F.lit(None))
    )


def normalized_list(items: Column) -> Column:
    """Trimmed, without blanks and repeats, sorted: scopes."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")))


def normalized_paths(items: Column) -> Column:
    clean = F.transform(items, lambda p: F.regexp_replace(F.translate(F.trim(p), "\\", "/"), r"^\./", ""))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != "")))


def sha(*parts: Column) -> Column:
    """SHA-256 in hex of the parts with NUL between them."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def chunk_id(path: Column, heading: Column, part: Column) -> Column:
    return F.substring(sha(path, heading, part.cast("string")), 1, 16)


def cache_key(task: Column, scopes: Column, most: Column, fingerprint: Column, model: Column, paths: Column) -> Column:
    return sha(F.lit("v2"), task, F.array_join(scopes, ","), most.cast("string"), fingerprint, model, F.array_join(paths, "\x01"))


def budget(most: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(most * BUDGET_SHARE)).cast("long")


def route_name(pattern: Column) -> Column:
    path = F.regexp_replace(pattern, r"^[^ ]* ", "")
    path = F.replace(F.replace(F.regexp_replace(path, "^/+|/+$", ""), F.lit("/"), F.lit("_")), F.lit("{path...}"), F.lit("path"))
    return F.when(path == "", "root").otherwise(path)


def mention_names(path: Column, title: Column) -> Column:
    """Phrases that refer to a document: its title, the title before : or (, its file name with dashes as spaces."""
    base = F.replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.md$", ""), F.lit("-"), F.lit(" "))
    names = F.transform(F.array(title, F.regexp_extract(title, r"^([^:(]+)[:(]", 1), base), lambda n: F.lower(F.trim(n)))
    return F.array_distinct(F.filter(names, lambda n: (F.octet_length(n) >= SHORTEST_MENTION) & ~n.isin(*GENERIC_NAMES)))


def section_header(path: Column, heading: Column, updated: Column, changes: Column, changed: Column) -> Column:
    day = lambda t: F.date_format(t, "yyyy-MM-dd")
    moved = F.concat(F.lit("; code changed since: "), changes.cast("string"), F.when(changes == 1, " commit").otherwise(" commits"), F.lit(", last "), day(changed))
    dated = F.concat(F.lit(" (updated "), day(updated), F.coalesce(F.when(changes > 0, moved), F.lit("")), F.lit(")"))
    return F.concat(F.lit("## "), path, F.lit(" — "), heading, F.coalesce(dated, F.lit("")))


def parse_time(text: Column) -> Column:
    """A timestamp written as RFC 3339, or with a zone without colon as issue trackers do; null for anything else."""
    zoned = F.regexp_replace(F.trim(text), r"([+-]\d\d)(\d\d)$", r"$1:$2")
    return F.when(zoned.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(zoned))


def valid_doc_path(path: Column) -> Column:
    p = F.regexp_replace(F.trim(path), "^/", "")
    return p.rlike(r"^(domain|conventions|projects/[A-Za-z0-9._-]+)/[A-Za-z0-9._/-]+\.md$") & ~p.contains("..") & ~p.contains("//") & ~p.rlike(r"(^|/)\.(/|$)")


def quote(text: Column) -> Column:
    """A query literal: white space collapsed, backslashes and double quotes escaped."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.concat(F.lit('"'), F.replace(F.replace(flat, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def cql(query: Column, spaces: Column) -> Column:
    some = F.concat(F.lit(" AND space IN ("), F.array_join(F.transform(spaces, quote), ", "), F.lit(")"))
    return F.concat(F.lit("type = page AND siteSearch ~ "), quote(query), F.when(F.size(spaces) > 0, some).otherwise(""))


def jql(text: Column, projects: Column, status: Column, kind: Column, assignee: Column, open_only: Column) -> Column:
    """A search over issues; null where no condition is given or the assignee is neither me nor unassigned."""
    bare = F.trim(F.regexp_replace(text, r'[+\-&|!(){}\[\]^~*?\\/:"]', " "))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    who = F.lower(F.trim(F.coalesce(assignee, F.lit(""))))
    parts = F.array_compact(
        F.array(
            F.when(F.size(projects) > 0, F.concat(F.lit("project IN ("), F.array_join(F.transform(projects, lambda p: quote(F.upper(p))), ", "), F.lit(")"))),
            F.when(F.nullif(bare, F.lit("")).isNotNull(), F.concat(F.lit("text ~ "), quote(bare))),
            F.concat(F.lit("status = "), quote(filled(status))),
            F.concat(F.lit("issuetype = "), quote(filled(kind))),
            F.when(who == "me", F.lit("assignee = currentUser()")).when(who == "unassigned", F.lit("assignee IS EMPTY")),
            F.when(open_only, F.lit("statusCategory != Done")),
        )
    )
    return F.when((F.size(parts) > 0) & who.isin("", "me", "unassigned"), F.concat(F.array_join(parts, " AND "), F.lit(" ORDER BY updated DESC")))


def allowed(requested: Column, allow: Column) -> Column:
    """A request can narrow an allow list, never widen it: empty lists mean all; null where nothing is left. Case does not count."""
    up = lambda items: F.transform(items, lambda x: F.upper(x))
    both = F.array_intersect(up(requested), up(allow))
    return F.when(F.size(allow) == 0, up(requested)).when(F.size(requested) == 0, up(allow)).when(F.size(both) > 0, both)


def clean_excerpt(text: Column) -> Column:
    out = F.regexp_replace(text, "@@@(hl|endhl)@@@", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def fit_lines(text: Column, most: Column) -> Column:
    """The longest run of leading lines within a token budget: struct(text, tokens, n lines). It stops at the first line that does not fit.

    A line end counts one token, but for one that goes on a run of line ends: so tokens are added line by line.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("tokens"), F.lit(False).alias("over"), F.lit(0).alias("n"), F.lit(False).alias("runs"))

    def step(state: Column, line: Column) -> Column:
        first = state["n"] == 0
        longer = F.when(first, line).otherwise(F.concat(state["text"], F.lit("\n"), line))
        tokens = state["tokens"] + F.when(first | state["runs"], 0).otherwise(1) + token_count(line)
        stop = state["over"] | (tokens > most)
        return F.struct(
            F.when(stop, state["text"]).otherwise(longer).alias("text"), F.when(stop, state["tokens"]).otherwise(tokens).alias("tokens"), stop.alias("over"),
            F.when(stop, state["n"]).otherwise(state["n"] + 1).alias("n"), (~first & line.rlike(r"^\r*$")).alias("runs"),
        )

    return F.aggregate(F.split(text, "\n"), start, step)


def first_tokens(text: Column, most: Column) -> Column:
    """The longest prefix within a token budget, by bisection over characters, without white space at its ends."""
    start = F.struct(F.lit(0).alias("low"), F.char_length(text).alias("high"))

    def step(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"] + 1) / 2).cast("int")
        fits = token_count(F.substring(text, F.lit(1), middle)) <= most
        done = state["low"] >= state["high"]
        return F.struct(F.when(done | ~fits, state["low"]).otherwise(middle).alias("low"), F.when(done | fits, state["high"]).otherwise(middle - 1).alias("high"))

    size = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, step, lambda s: s["low"])
    return F.regexp_replace(F.substring(text, F.lit(1), size), r"^\s+|\s+$", "")


def truncate(text: Column, most: Column) -> Column:
    """The text cut to a token budget: whole lines where one fits, else as many characters of the first line as do."""
    lines = fit_lines(text, most)
    by_lines = F.regexp_replace(lines["text"], r"\n+$", "")
    return F.when(token_count(text) <= most, text).when(lines["n"] > 0, by_lines).otherwise(first_tokens(text, most))


def fit(text: Column, most: Column) -> Column:
    """struct(text, truncated, ok): whole if it fits, else cut and marked; not ok, and empty, where too little room is left for that."""
    room = most - token_count(F.lit(CUT_MARK))
    whole, ok = token_count(text) <= most, room >= LEAST_ROOM
    cut = F.when(whole, text).when(ok, F.concat(truncate(text, room), F.lit(CUT_MARK))).otherwise(F.lit(""))
    return F.struct(cut.alias("text"), (~whole).alias("truncated"), (whole | ok).alias("ok"))


_RUN = re.compile(r"\n[\n\r]*|[^\W\d_](?:[^\W\d_]|')*|\d+|(?:[^\w\s]|_)+")


def count_tokens(text: str) -> int:
    """token_count for Python code that splits texts."""
    total = 0
    for run in _RUN.findall(text):
        if run[0] == "\n":
            total += 1
        elif run[0].isalpha() and run.isascii():
            total += 1 if len(run) <= 8 else -(-len(run) // 7)
        else:
            total += -(-len(run) // 3)
    return total
