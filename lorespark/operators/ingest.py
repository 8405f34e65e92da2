"""From files to documents, chunks, links and hashes; incremental reconciliation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T

# A chunk over MAX tokens is split into parts of at most TARGET; what joins breadcrumbs.
MAX_TOKENS, TARGET_TOKENS, SEPARATOR = 800, 500, " > "


def front_matter(text: Column) -> dict[str, Column]:
    """raw (trimmed block, null without one), body, title, tags, refs, broken (opened and never closed)."""
    opened = text.rlike(r"^---[ \r]*\n")
    block = r"(?s)^---[ \r]*\n(.*?)(?:^|\n)---[ \r]*(?:\n|$)"
    closed = opened & text.rlike(r"(?s)^---[ \r]*\n(?:.*?\n)?---[ \r]*(?:\n|$)")
    raw = F.when(closed, F.trim(F.regexp_extract(text, block, 1)))
    rest = F.when(closed, F.regexp_replace(text, r"(?s)^---[ \r]*\n(?:.*?\n)?---[ \r]*(?:\n|$)", "")).otherwise(text)
    bare = lambda c: F.regexp_replace(F.trim(c), r"^[\"']|[\"']$", "")

    def listed(key: str) -> Column:
        inline = F.regexp_extract(raw, rf"(?m)^{key}:[ \t]*\[([^\]\n]*)\]", 1)
        lines = F.regexp_extract(raw, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[^\n]*\n?)+)", 1)
        found = F.when(inline != "", F.split(inline, ",")).when(lines != "", F.transform(F.regexp_extract_all(lines, F.lit(r"(?m)^[ \t]*-[ \t]*([^\n]*)"), F.lit(1)), lambda x: x)).otherwise(F.array().cast("array<string>"))
        return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), bare), lambda x: x != "")

    title = F.nullif(bare(F.regexp_extract(raw, r"(?m)^title:[ \t]*([^\n]*)", 1)), F.lit(""))
    return {"raw": raw, "body": rest, "title": title, "tags": listed("tags"), "refs": listed("refs"), "broken": opened & ~closed}


def has_front_matter(text: Column) -> Column:
    return text.rlike(r"^---[ \r]*\n")


_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def headings(lines: list[str]) -> list[tuple[int, int, str, int]]:
    """(line, level, text, lines taken) of top-level headings: none inside fences, lists or quotes; ATX and underlined ones."""
    found, fence = [], ""
    for i, line in enumerate(lines):
        if m := _FENCE.match(line):
            mark = m[1]
            if not fence:
                fence = mark
            elif mark[0] == fence[0] and len(mark) >= len(fence) and not line.strip().strip(mark[0]):
                fence = ""
            continue
        if fence:
            continue
        if m := _ATX.match(line):
            if (m[2] or "").strip():
                found.append((i, len(m[1]), m[2].strip(), 1))
        elif i and re.match(r"^ {0,3}(=+|-+)[ \t]*$", line) and lines[i - 1].strip() and not re.match(r"^ {0,3}([-*+>]|\d+[.)])|^ {4}|^\t", lines[i - 1]) and not _ATX.match(lines[i - 1]):
            found.append((i - 1, 1 if line.strip()[0] == "=" else 2, lines[i - 1].strip(), 2))
    return found


def split_oversized(content: str) -> list[str]:
    """Paragraphs packed into parts of at most TARGET tokens; a unit over MAX goes by lines, then by characters."""
    if T.count_tokens(content) <= MAX_TOKENS:
        return [content]

    def units(text: str, separators: tuple[str, ...]) -> Iterator[tuple[str, str]]:
        for part in text.split(separators[0]):
            if T.count_tokens(part) <= MAX_TOKENS:
                yield separators[0], part
            elif len(separators) > 1:
                yield from units(part, separators[1:])
            else:
                while part:
                    n = len(part)
                    while n > 1 and T.count_tokens(part[:n]) > TARGET_TOKENS:
                        n = n * 3 // 4
                    yield separators[0], part[:n]
                    part = part[n:]

    parts, held = [], ""
    for separator, unit in units(content, ("\n\n", "\n")):
        longer = held + separator + unit if held else unit
        if held and T.count_tokens(longer) > TARGET_TOKENS:
            parts.append(held)
            longer = unit
        held = longer
    return [p for p in [*parts, held] if p.strip()]


def sections(path: str, title: str | None, body: str) -> tuple[str, list[tuple[str, str, int]]]:
    """The title (front matter, first H1 or path) and (breadcrumb, content, part) of each chunk, in order.

    H1 begins a new breadcrumb, H2 and H3 open sections, deeper ones stay inside; the first H1's line is no content; the
    nth section of one breadcrumb gets its number.
    """
    lines = body.replace("\r\n", "\n").split("\n")
    heads = headings(lines)
    first = next((h for h in heads if h[1] == 1), None)
    name = (title or "").strip() or (first[2] if first else path)
    dropped = set(range(first[0], first[0] + first[3])) if first else set()
    cuts = [(0, [name])]
    crumb = {1: name}
    for at, level, text, _ in heads:
        if level > 3:
            continue
        crumb = {k: v for k, v in crumb.items() if k < level} | {level: name if (at, level) == (first[0] if first else -1, 1) else text}
        if level == 1:
            crumb = {1: crumb[1]}
        elif 1 not in crumb:
            crumb[1] = name
        cuts.append((at, [crumb[k] for k in sorted(crumb)]))
    seen: dict[str, int] = {}
    found = []
    for (start, trail), stop in zip(cuts, [*[c[0] for c in cuts[1:]], len(lines)]):
        content = "\n".join(x for i, x in enumerate(lines[start:stop], start) if i not in dropped).strip()
        if not content:
            continue
        key = SEPARATOR.join(trail)
        seen[key] = seen.get(key, 0) + 1
        heading = key if seen[key] == 1 else f"{key} ({seen[key]})"
        found += [(heading, part, i) for i, part in enumerate(split_oversized(content))]
    return name, found


def chunk_documents(docs: DataFrame) -> DataFrame:
    """docs (path, title, body) to doc_path, title, scope, heading, content, position, part, chunk_id, tokens, content_hash.

    Python finds sections; ids, hashes and token counts are JVM expressions. A document is one row, so no chunk crosses rows.
    """

    kinds = [("doc_path", pa.string()), ("title", pa.string()), ("heading", pa.string()), ("content", pa.string()), ("position", pa.int32()), ("part", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, title, body in zip(*(c.to_pylist() for c in batch.columns)):
                name, parts = sections(path, title, body or "")
                out += [(path, name, heading, content, i, part) for i, (heading, content, part) in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*out)) or [()] * len(kinds), kinds)], [n for n, _ in kinds])

    found = docs.select("path", "title", "body").mapInArrow(run, "doc_path string, title string, heading string, content string, position int, part int")
    return found.select(
        "*", T.scope_of(F.col("doc_path")).alias("scope"), T.chunk_id(F.col("doc_path"), F.col("heading"), F.col("part")).alias("chunk_id"), T.token_count(F.col("content")).alias("tokens"), F.sha2("content", 256).alias("content_hash")
    )


FENCED, INLINE = r"(?s)```.*?```|~~~.*?~~~", r"`[^`\n]*`"
WIKI = r"(^|[^!])\[\[([^\[\]|#]+)(?:#[^\[\]|]*)?(?:\|[^\[\]]*)?\]\]"
MARKDOWN = r"(^|[^!])\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"


def links(body: Column) -> Column:
    """array<struct<target, kind>> in order of first appearance: wiki links, then links to .md files; code is skipped."""
    text = F.regexp_replace(F.regexp_replace(body, FENCED, ""), INLINE, "")
    wiki = F.transform(F.regexp_extract_all(text, F.lit(WIKI), F.lit(2)), lambda x: F.trim(x))
    plain = F.transform(F.regexp_extract_all(text, F.lit(MARKDOWN), F.lit(2)), lambda x: F.trim(F.substring_index(x, "#", 1)))
    plain = F.filter(plain, lambda x: x.rlike(r"(?i)\.md$") & ~x.contains("://") & ~x.startswith("mailto:") & ~x.startswith("/"))
    both = F.concat(F.transform(F.filter(wiki, lambda x: x != ""), lambda x: F.struct(x.alias("target"), F.lit("wikilink").alias("kind"))), F.transform(plain, lambda x: F.struct(x.alias("target"), F.lit("markdown").alias("kind"))))
    return F.array_distinct(both)


def extract_links(docs: DataFrame) -> DataFrame:
    """from_path, position, target, kind."""
    return docs.select(F.col("path").alias("from_path"), F.posexplode(links(F.col("body"))).alias("position", "l")).select("from_path", "position", "l.target", "l.kind")


def reconcile(snapshot: DataFrame, index: DataFrame) -> DataFrame:
    """path, status (new, changed, same, deleted) of path and content_hash in a scan against the index."""
    old = index.select("path", F.col("content_hash").alias("old"))
    both = snapshot.select("path", F.col("content_hash").alias("now")).join(old, "path", "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("old") == F.col("now"), "same").otherwise("changed")
    return both.select("path", status.alias("status"))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table without the keys of new, and new."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone, key, "left_anti")


def pending_vectors(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """chunk_id, text of chunks without a vector of this model and content: breadcrumb, line end, content."""
    have = vectors.where(F.col("model") == model).select("chunk_id", "content_hash")
    return chunks.join(have, ["chunk_id", "content_hash"], "left_anti").select("chunk_id", "doc_path", "position", F.concat_ws("\n", "heading", "content").alias("text"))


def prune_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks, "chunk_id", "left_semi")


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row: 16 hex digits over path NUL hash LF in path order.

    The digest is one SHA-256 over all lines, as stored fingerprints are, so one task holds a line of about 120 bytes per document:
    some ten million documents of a knowledge base, not a training corpus.
    """
    line = F.concat("path", F.lit("\x00"), "content_hash", F.lit("\n"))
    return docs.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("l")))), lambda x: x["l"]), ""), 256), 1, 16).alias("fingerprint"))


#: Parts of a tree fingerprint.
PARTS = 4096


def tree_fingerprint(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """One row: 16 hex digits over the digests of `parts` parts, each over path NUL hash LF of its documents in path order.

    A document's part is told by a hash of its path, so the digest does not depend on how rows are spread, and a task holds the lines
    of a part: for corpora that fingerprint() would hold in one task. The two digests of a corpus differ.
    """
    line = F.concat("path", F.lit("\x00"), "content_hash", F.lit("\n"))
    part = F.conv(F.substring(F.sha2("path", 256), 1, 8), 16, 10).cast("long") % parts
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("l")))), lambda x: x["l"]), "")
    each = docs.groupBy(part.alias("part")).agg(F.sha2(joined, 256).alias("digest"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: F.concat(x["part"].cast("string"), F.lit("\x00"), x["digest"], F.lit("\n"))), "")
    return each.agg(F.substring(F.sha2(top, 256), 1, 16).alias("fingerprint"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """doc_path, text: chunks in order with blank lines between."""
    return chunks.groupBy("doc_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x["content"]), "\n\n").alias("text"))


def ages(docs: DataFrame, commits: DataFrame) -> DataFrame:
    """path, updated_at: the last commit that touches it, else the file's own time."""
    last = commits.select("when", F.explode("paths").alias("path")).groupBy("path").agg(F.max("when").alias("committed"))
    return docs.join(last, "path", "left").select("path", F.coalesce("committed", "modified_at").alias("updated_at"))


def scope_stats(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """scope, documents, chunks, tokens; documents without chunks count."""
    return (
        docs.select("scope", "doc_id").join(chunks.select("doc_id", "chunk_id", "tokens"), "doc_id", "left").groupBy("scope")
        .agg(F.countDistinct("doc_id").alias("documents"), F.count("chunk_id").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    )
