"""Commands over a library folder: index, search, enrich, graph, stats, manifests and rename plans.

A library's tables are versioned folders below --index; each command reads the current version and writes a new one.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import norm_name
from .functions.vectors import HashEmbedder, embedded
from .operators import chunking, enrichment, graph, retrieval, tables
from .session import session
from .sources import files, lists

ROOTS = {"literature": "Literature", "transcripts": "Transcripts", "outbox": "Outbox", "inbox": "Inbox"}


#: The tables whose rows the graph's summary counts.
COUNTED = ("documents", "authors", "keywords", "topics", "companies", "doc_authors", "doc_topics", "doc_keywords", "doc_companies", "doc_similar")


class Library:
    def __init__(self, spark: SparkSession, index: str):
        self.spark, self.index = spark, index

    def read(self, name: str) -> DataFrame | None:
        path = f"{self.index}/{name}"
        return lists.read_versioned(self.spark, path) if lists.has_version(self.spark, path) else None

    def write(self, name: str, df: DataFrame) -> DataFrame:
        lists.write_versioned(df, f"{self.index}/{name}")
        return self.read(name)


def index(lib: Library, root: str, roots: list[str], embedder, internal: str, limit: int | None = None, reset: bool = False, cap: int = 0) -> DataFrame:
    """Brings documents and chunks up to date with the files; returns (outcome, n).  A document's chunks stop at `cap`
    characters (0: no cap)."""
    listing = files.list_files(lib.spark, root)
    inside = F.lit(False)
    for name in roots:
        inside = inside | F.contains("path", F.lit(f"/{ROOTS[name]}/"))
    listing = listing.filter(inside)
    listing = listing.orderBy("path").limit(limit) if limit else listing
    found = files.documents(listing, root, internal, cap)
    old = None if reset else lib.read("documents")
    fresh = found
    if old is not None:
        same = old.select("doc_id", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
        known = listing.select(F.sha2("content", 256).alias("doc_id"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "path")
        todo = tables.changed(known, same.withColumnsRenamed({"_s": "size", "_m": "mtime"}))
        fresh = found.join(todo.select("path"), "path", "left_semi")
    fresh = lib.write("staged", fresh)
    pieces = chunking.chunk_pages(fresh, cap=cap).withColumn("text_hash", F.sha2("text", 256))
    cache = lib.read("embedding_cache") if not reset else None
    if cache is None:
        cache = lib.spark.createDataFrame([], "model string, text_hash string, embedding array<double>")
    pieces, new = tables.embed_cached(pieces, cache, embedder)
    pieces = lib.write("staged_chunks", pieces)
    lib.write("embedding_cache", cache.unionByName(new))
    rows = fresh.join(pieces.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_chunks")), "doc_id", "left").drop("pages").withColumn("indexed_at", F.current_timestamp())
    all_docs, all_chunks, gone = rows, pieces, 0
    if old is not None:
        kept, kept_chunks = tables.prune(old, lib.read("chunks"), listing)
        gone = old.count() - kept.count()
        all_docs = tables.upsert(kept, rows, ["doc_id", "path"])
        all_chunks = kept_chunks.join(all_docs.select("doc_id"), "doc_id", "left_semi").join(rows.select("doc_id"), "doc_id", "left_anti").unionByName(pieces)
    lib.write("documents", tables.flag_internal(tables.first(all_docs, ["doc_id"], "path"), internal))
    lib.write("chunks", all_chunks.dropDuplicates(["chunk_id"]))  # equal files have equal chunks
    words = retrieval.Bm25Index.build(lib.read("chunks"))
    lib.write("postings", words.ordered())
    lib.write("postings_figures", lib.spark.createDataFrame([(words.n, words.mean)], "n long, mean double"))
    counts = [("indexed", rows.filter("n_chunks > 0").count()), ("empty", rows.filter("n_chunks is null").count()), ("pruned", gone), ("skipped", listing.count() - rows.count())]
    return lib.spark.createDataFrame(counts, "outcome string, n long")


SYSTEM = "You read the opening of a document and answer with one JSON object of the keys title, authors (a list of names), year, venue and keywords (a list). Leave out what the text doesn't say."
ENRICHMENT = "doc_id string, title string, authors array<string>, year int, venue string, keywords array<string>, method string, enriched_at timestamp"


def enrich(lib: Library, client: enrichment.ChatClient, only_review: bool = False, limit: int | None = None, redo: bool = False, system: str = SYSTEM) -> DataFrame:
    """Asks a model for the metadata of documents that have none yet, keeps its answers and brings the documents up to
    date with all that are kept; returns (outcome, n).  Replies are a table of their own before anything is made of them, so
    no document is asked about twice."""
    documents, known = lib.read("documents"), lib.read("doc_enrichment")
    known = known if known is not None else lib.spark.createDataFrame([], ENRICHMENT)
    todo = lib.write("targets", enrichment.targets(documents, known, only_review, limit, redo))
    openings = enrichment.opening_text(lib.read("chunks").join(todo, "doc_id", "left_semi"))
    rows = enrichment.enrichment_rows(lib.write("replies", enrichment.asked(openings, client, system)))
    rows = lib.write("new_enrichment", rows)
    known = lib.write("doc_enrichment", tables.upsert(known, rows, ["doc_id"]))
    lib.write("documents", tables.promote(documents, known))
    n, of = rows.count(), todo.count()
    return lib.spark.createDataFrame([("enriched", n), ("failed", of - n)], "outcome string, n long")


def manifest(lib: Library, root: str, keep: bool = False) -> DataFrame:
    """The manifest of all files below root, by top folder, with its `state` against the one that was kept last."""
    listing = lib.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    now, packed = lib.write("manifest_now", lists.manifest(listing, root)), lib.read("manifest")
    packed = packed if packed is not None else now.limit(0)
    out = lists.drift(now, packed).join(now, "part", "left").orderBy("part")
    if keep:
        lib.write("manifest", now)
    return out


def build_graph(lib: Library, k: int = graph.SIMILAR_K, approximate: bool = False) -> DataFrame:
    nearby = f"{lib.index}/vector_index" if approximate else None
    made = graph.build(lib.read("documents"), lib.read("chunks"), lib.read("doc_enrichment"), k, nearby=nearby)
    return graph.counts({name: lib.write(name, df) for name, df in made.items()})


def stats(lib: Library) -> tuple[DataFrame, DataFrame]:
    docs = lib.read("documents")
    total = docs.agg(F.count("*").alias("documents"), F.count_if("internal").alias("internal"), F.count_if("needs_review").alias("needs_review"), F.sum("n_chunks").alias("chunks"))
    return total, docs.groupBy("topic").count().orderBy(F.desc("count"), "topic").limit(15)


def find(lib: Library, query: str, embedder, k: int, expand: bool, internal: bool | None) -> DataFrame:
    tables_ = {n: lib.read(n) for n in ("doc_similar", "doc_authors", "doc_keywords")} if expand else {}
    words, figures = lib.read("postings"), lib.read("postings_figures")
    index = retrieval.Bm25Index(words, *figures.select("n", "mean").first()) if words is not None and figures is not None else None
    return retrieval.search(lib.read("chunks"), lib.read("documents"), query, embedder, k, internal=internal, graph={n: t for n, t in tables_.items() if t is not None}, index=index)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathomline")
    p.add_argument("--index", required=True, help="folder of the library's tables")
    p.add_argument("--internal", default="Internal", help="path of the internal collection")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("root")
    i.add_argument("--roots", nargs="+", choices=sorted(ROOTS), default=["literature", "transcripts", "outbox"])
    i.add_argument("--limit", type=int)
    i.add_argument("--reset", action="store_true")
    i.add_argument("--max-chars", type=int, default=0, help="characters of a document that are indexed, about (0: all)")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--expand", action="store_true")
    only = s.add_mutually_exclusive_group()
    only.add_argument("--internal-only", action="store_true")
    only.add_argument("--external-only", action="store_true")
    g = sub.add_parser("graph")
    g.add_argument("--build", action="store_true")
    g.add_argument("--similar-k", type=int, default=graph.SIMILAR_K)
    g.add_argument("--approximate", action="store_true", help="search similar documents by an index, for large libraries")
    g.add_argument("--author")
    g.add_argument("--company", nargs="?", const="")
    e = sub.add_parser("enrich")
    e.add_argument("--client", required=True, help="module:name of a chat client, or of a function that makes one")
    e.add_argument("--only-review", action="store_true")
    e.add_argument("--limit", type=int)
    e.add_argument("--redo", action="store_true")
    m = sub.add_parser("manifest")
    m.add_argument("root")
    m.add_argument("--keep", action="store_true", help="keep this manifest for later comparisons")
    sub.add_parser("stats")
    r = sub.add_parser("rename-plan")
    r.add_argument("root")
    r.add_argument("--all", action="store_true")
    return p


def chat_client(name: str) -> enrichment.ChatClient:
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found if hasattr(found, "complete") and not isinstance(found, type) else found()


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session(a.master)
    lib, embedder = Library(spark, a.index), HashEmbedder()
    normal = lambda name: spark.range(1).select(norm_name(F.lit(name)).alias("n")).first()["n"]
    if a.command == "index":
        out = [index(lib, a.root, a.roots, embedder, a.internal, a.limit, a.reset, a.max_chars)]
    elif a.command == "search":
        out = [find(lib, a.query, embedder, a.k, a.expand, True if a.internal_only else False if a.external_only else None)]
    elif a.command == "enrich":
        out = [enrich(lib, chat_client(a.client), a.only_review, a.limit, a.redo)]
    elif a.command == "manifest":
        out = [manifest(lib, a.root, a.keep)]
    elif a.command == "stats":
        out = list(stats(lib))
    elif a.command == "rename-plan":
        none = spark.createDataFrame([], "folder string, name string")
        out = [tables.rename_plan(lib.read("documents"), a.root, none, a.all)]
    elif a.build:
        out = [build_graph(lib, a.similar_k, a.approximate)]
    elif a.author:
        docs, edges, nodes = lib.read("documents"), lib.read("doc_authors"), lib.read("authors")
        out = [graph.papers_by_author(docs, edges, nodes, normal(a.author)), graph.coauthors(edges, nodes, normal(a.author))]
    elif a.company is not None:
        nodes, edges = lib.read("companies"), lib.read("doc_companies")
        out = [graph.docs_by_company(lib.read("documents"), edges, nodes, normal(a.company)) if a.company else graph.company_counts(edges, nodes)]
    else:
        out = [graph.counts({n: t for n in COUNTED if (t := lib.read(n)) is not None})]
    for df in out:
        df.show(100, truncate=120)


__all__ = ["Library", "build_graph", "embedded", "enrich", "find", "index", "main", "manifest", "stats"]

if __name__ == "__main__":
    main()
