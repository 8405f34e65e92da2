"""The index of a knowledge base as tables that change together: documents, chunks, links, vectors and compiled bundles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators import graph, ingest
from lorespark.sources.snapshots import Snapshots

#: Rules of link extraction; documents whose links were found by older ones are parsed again.
LINK_RULES = 2

_LINKS = ["from_path", "position", "target", "kind"]


def changes(scan: DataFrame, documents: DataFrame | None, force: bool = False) -> DataFrame:
    """path, status (new, changed, stale, same, deleted) of a scan (path, content_hash) against the index.

    stale: unchanged, but its links were found by older rules, or its source text was never stored; with force every unchanged one is.
    """
    if documents is None:
        return scan.select("path", F.lit("new").alias("status"))
    old = F.coalesce(F.col("link_rules") < LINK_RULES, F.lit(True)) | F.col("body").isNull()
    again = documents.where(F.lit(True) if force else old).select("path", F.lit(True).alias("again"))
    found = ingest.reconcile(scan, documents).join(again, "path", "left")
    return found.select("path", F.when((F.col("status") == "same") & F.col("again"), "stale").otherwise(F.col("status")).alias("status"))


def _replaced(old: DataFrame | None, key: str, touched: DataFrame, new: DataFrame) -> DataFrame:
    """The old table without rows of touched documents, and the new rows."""
    if old is None:
        return new
    return old.join(touched.select(F.col("path").alias(key)), key, "left_anti").select(new.columns).unionByName(new)


def _resolved(links: DataFrame, documents: DataFrame) -> DataFrame:
    return graph.resolve_links(links.select(*_LINKS), documents.select("path"))


def upsert_documents(store: Snapshots, docs: DataFrame, commit: str = "") -> int:
    """Replaces documents (path, title, body, content_hash) with their chunks and links in one version; links of all documents are resolved anew."""
    was = store.latest()
    have = lambda name: store.table(name, was) if name in was["tables"] else None
    new = docs.select("path", "title", "body", "content_hash", F.lit(commit).alias("updated_commit"), F.lit(LINK_RULES).alias("link_rules"))
    documents = _replaced(have("documents"), "path", docs, new)
    chunks = _replaced(have("chunks"), "doc_path", docs, ingest.chunk_documents(docs))
    links = _replaced(have("links"), "from_path", docs, ingest.extract_links(docs))
    return store.commit({"documents": documents, "chunks": chunks, "links": _resolved(links, documents)}, on=was)


def delete_documents(store: Snapshots, gone: DataFrame) -> int:
    """Removes documents (path) with their chunks, vectors and links in one version; links of others to them are broken from then on.

    Paths that are not there are no error.
    """
    was = store.latest()
    rest = {name: ingest.delete(store.table(name, was), gone.select(F.col("path").alias(key)), key) for name, key in (("documents", "path"), ("chunks", "doc_path"), ("links", "from_path")) if name in was["tables"]}
    if "links" in rest:
        rest["links"] = _resolved(rest["links"], rest["documents"])
    if "vectors" in was["tables"]:
        rest["vectors"] = ingest.prune_vectors(store.table("vectors", was), rest["chunks"])
    return store.commit(rest, on=was)


def sync(store: Snapshots, scan: DataFrame, source: str = "", commit: str = "", at: str = "", force: bool = False, digest: Callable[[DataFrame], DataFrame] = ingest.fingerprint) -> dict[str, int | str]:
    """Brings the index to a scan (path, title, body, content_hash) in one version; how many documents were scanned, indexed, skipped, deleted, the chunks indexed and the fingerprint.

    Documents that changed, or whose links are of older rules, are parsed; those that are gone go with all that is theirs; bundles of an
    older fingerprint (see digest: fingerprint() or, for very many documents, tree_fingerprint()) and vectors of no chunk go. Source, commit and time are kept as the sync state. When nothing changes no
    table is written.
    """
    was = store.latest()
    have = lambda name: store.table(name, was) if name in was["tables"] else None
    status = changes(scan, have("documents"), force)
    count = {r.status: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
    stats: dict[str, int | str] = {
        "scanned": sum(n for s, n in count.items() if s != "deleted"), "indexed": sum(count.get(s, 0) for s in ("new", "changed", "stale")), "skipped": count.get("same", 0), "deleted": count.get("deleted", 0), "chunks": 0,
    }
    state = {"source": source, "commit": commit, "synced_at": at}
    if not stats["indexed"] and not stats["deleted"]:
        stats["fingerprint"] = was["state"].get("fingerprint", "")
        store.commit({}, state, on=was)
        return stats
    touched = status.where("status <> 'same'").select("path")
    docs = scan.join(status.where("status in ('new', 'changed', 'stale')").select("path"), "path", "left_semi")
    new = docs.select("path", "title", "body", "content_hash", F.lit(commit).alias("updated_commit"), F.lit(LINK_RULES).alias("link_rules"))
    parsed = ingest.chunk_documents(docs)
    documents = _replaced(have("documents"), "path", touched, new)
    chunks = _replaced(have("chunks"), "doc_path", touched, parsed)
    links = _resolved(_replaced(have("links"), "from_path", touched, ingest.extract_links(docs)), documents)
    tables = {"documents": documents, "chunks": chunks, "links": links}
    stats["fingerprint"] = digest(documents).first()[0]
    if (vectors := have("vectors")) is not None:
        tables["vectors"] = ingest.prune_vectors(vectors, chunks)
    for name in ("bundles", "recent"):
        if (bundles := have(name)) is not None:
            tables[name] = bundles.where(F.col("fingerprint") == stats["fingerprint"])
    store.commit(tables, state | {"fingerprint": stats["fingerprint"]}, on=was)
    stats["chunks"] = store.table("chunks").join(docs.select(F.col("path").alias("doc_path")), "doc_path", "left_semi").count()
    return stats


def sync_state(store: Snapshots) -> dict[str, str]:
    """What the last sync left: source, commit, synced_at, fingerprint."""
    return {k: v for k, v in store.latest()["state"].items() if k in ("source", "commit", "synced_at", "fingerprint")}
