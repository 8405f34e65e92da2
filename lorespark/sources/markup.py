"""HTML pages to Markdown, and issues (JSON documents) to text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROPPED = {"script", "style", "img", "svg", "button", "template", "noscript", "head"}
VOID = {"br", "img", "hr", "meta", "link", "input", "col", "wbr", "area", "base", "source"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "body", "html", "figure", "details", "summary", "aside"}


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    """A lenient element tree: an end tag closes up to its start tag, list items and cells close the one before."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        for closing, until in (("li", {"ul", "ol"}), ("tr", {"table"}), ("td", {"tr"}), ("th", {"tr"}), ("p", set())):
            if tag == closing or (closing in ("td", "th") and tag in ("td", "th")) or (closing == "p" and tag in BLOCKS | {"ul", "ol", "table", "pre"}):
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i].tag in until:
                        break
                    if self.stack[i].tag == closing:
                        del self.stack[i:]
                        break
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _inline(node) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    if node.tag in DROPPED:
        return ""
    inner = "".join(map(_inline, node.children))
    bare = inner.strip()
    wrap = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~"}.get(node.tag)
    if node.tag == "br":
        return "\n"
    if wrap:
        return inner.replace(bare, f"{wrap}{bare}{wrap}") if bare else inner
    if node.tag == "a" and bare:
        href = node.attrs.get("href", "")
        return f"[{bare}]({href})" if href else inner
    return inner


def _raw(node) -> str:
    return node if isinstance(node, str) else "\n" if node.tag == "br" else "".join(map(_raw, node.children))


def _rows(node) -> list:
    return [] if isinstance(node, str) else [node] if node.tag == "tr" else [r for c in node.children for r in _rows(c)]


def _table(node) -> str:
    rows = [[re.sub(r"\s+", " ", "".join(map(_inline, c.children))).strip().replace("|", r"\|") for c in r.children if not isinstance(c, str) and c.tag in ("td", "th")] for r in _rows(node)]
    rows = [r for r in rows if r]
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if lines else ""


def _list(node, depth: int) -> str:
    lines, n = [], 0
    for item in node.children:
        if isinstance(item, str) or item.tag != "li":
            continue
        n += 1
        nested = [c for c in item.children if not isinstance(c, str) and c.tag in ("ul", "ol")]
        text = re.sub(r"\s+", " ", "".join(_inline(c) for c in item.children if c not in nested)).strip()
        lines.append("  " * depth + (f"{n}. " if node.tag == "ol" else "- ") + text)
        lines += [_list(x, depth + 1) for x in nested]
    return "\n".join(x for x in lines if x.strip())


def _blocks(node) -> list[str]:
    out, run = [], ""

    def flush():
        nonlocal run
        text = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t]+", " ", run)).strip()
        if text:
            out.append(text)
        run = ""

    for c in node.children:
        if isinstance(c, str) or c.tag not in BLOCKS | DROPPED | {"ul", "ol", "table", "pre", "blockquote", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "tbody"}:
            run += _inline(c)
            continue
        flush()
        if c.tag in DROPPED:
            continue
        if re.fullmatch("h[1-6]", c.tag):
            text = re.sub(r"\s+", " ", "".join(map(_inline, c.children))).strip()
            out += [f"{'#' * int(c.tag[1])} {text}"] if text else []
        elif c.tag in ("ul", "ol"):
            out.append(_list(c, 0))
        elif c.tag == "table":
            out.append(_table(c))
        elif c.tag == "pre":
            inner = next((x for x in c.children if not isinstance(x, str) and x.tag == "code"), c)
            language = re.search(r"language-([\w+-]+)", inner.attrs.get("class", "") + " " + c.attrs.get("class", ""))
            out.append(f"```{language[1] if language else ''}\n{_raw(c).strip(chr(10))}\n```")
        elif c.tag == "blockquote":
            out.append("\n".join(f"> {x}".rstrip() for x in "\n\n".join(_blocks(c)).split("\n")))
        elif c.tag == "hr":
            out.append("---")
        else:
            out += _blocks(c)
    flush()
    return [x for x in out if x.strip()]


def to_markdown(html: str) -> str:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return "\n\n".join(_blocks(tree.root))


def html_to_markdown(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, markdown. A null page gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_markdown(h or "") for h in batch.column(1).to_pylist()], pa.string())], [key, "markdown"])

    return pages.select(key, "html").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, markdown string")


def adf_text(node) -> str:
    """Plain text of a document tree of type/content/text nodes; blocks end lines."""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return "".join(map(adf_text, node))
    if not isinstance(node, dict):
        return ""
    kind, inner = node.get("type"), adf_text(node.get("content", []))
    if kind == "text":
        return node.get("text", "")
    if kind == "hardBreak":
        return "\n"
    if kind in ("mention", "emoji", "status"):
        return str(node.get("attrs", {}).get("text", ""))
    if kind == "listItem":
        return "- " + inner.strip() + "\n"
    return inner + "\n" if kind in ("paragraph", "heading", "codeBlock", "blockquote", "tableRow") else inner


def plain_value(value) -> str:
    """A field's value as text: names of objects, lists joined by commas."""
    if value is None:
        return ""
    if isinstance(value, list):
        return ", ".join(x for x in map(plain_value, value) if x)
    if isinstance(value, dict):
        if value.get("type") == "doc":
            return adf_text(value).strip()
        return next((str(value[k]) for k in ("displayName", "name", "value", "key") if value.get(k)), "")
    return str(value)


def issue_text(raw: str) -> str:
    """An issue: key and summary, fields, description, comments, so that a cut at the end loses least."""
    issue = json.loads(raw)
    fields = issue.get("fields") or {}
    rendered = issue.get("renderedFields") or {}
    head = [f"{issue.get('key') or ''}: {fields.get('summary') or ''}"]
    head += [f"{n.capitalize()}: {plain_value(fields[n])}" for n in ("status", "issuetype", "priority", "assignee", "labels") if plain_value(fields.get(n))]
    body = to_markdown(rendered["description"]) if rendered.get("description") else plain_value(fields.get("description"))
    comments = [f"{plain_value(c.get('author'))}: {plain_value(c.get('body'))}" for c in (fields.get("comment") or {}).get("comments", [])]
    return "\n\n".join(x for x in ["\n".join(head), body, *comments] if x.strip())


def issues(rows: DataFrame) -> DataFrame:
    """key, text of raw JSON issues (raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([json.loads(r).get("key") for r in raw], pa.string()), pa.array([issue_text(r) for r in raw], pa.string())], ["key", "text"])

    return rows.select("raw").mapInArrow(run, "key string, text string")


def excerpt(text: str | None) -> str | None:
    """A search hit's excerpt without the marks of what was found, entities as characters, on one line."""
    return None if text is None else " ".join(unescape(re.sub("@@@(hl|endhl)@@@", "", text)).split())


def page_hits(pages: DataFrame) -> DataFrame:
    """page_id, title, excerpt of stored pages, standing in for a live search."""
    from lorespark.functions.text import clean_excerpt

    return pages.select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), clean_excerpt(F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style|head).*?</\\1>", " "), "<[^>]*>", " ")).alias("excerpt"))
