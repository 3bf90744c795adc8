"""Hybrid retrieval: exact vector top-k, BM25, rank fusion, filtering after ranking and expansion along a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..scratch import written

RRF = 60
K1, B = 1.2, 0.75
TOKEN = "[a-z]+"
SEEDS, AUTHOR_WEIGHT, KEYWORD_WEIGHT = 5, 0.6, 0.4


def pool_size(k: int, pool: int | None = None, filtered: bool = False) -> int:
    """Candidates per list: five times k and 50 at least, twenty times k with a filter on the fused list."""
    pool = pool or max(5 * k, 50)
    return max(pool, 20 * k) if filtered else pool


def vector_hits(chunks: DataFrame, query: list[float], pool: int, digits: int | None = None) -> DataFrame:
    """(chunk_id, doc_id, distance, rank): the nearest by cosine distance, exact; ties by chunk_id.  Zero vectors don't count.
    With `digits`, distances that are equal when rounded are ties, as between the many equal ones of hashed vectors.

    A distributed top-k: each task keeps `pool` rows, and only those are merged."""
    distance = V.cosine_distance("embedding", V.literal(query))
    near = chunks.select("chunk_id", "doc_id", (distance if digits is None else F.round(distance, digits)).alias("distance"))
    top = near.filter("distance is not null").orderBy("distance", "chunk_id").limit(pool)
    return _ranked(top, F.asc("distance"))


def _ranked(top: DataFrame, order: Column) -> DataFrame:
    """Adds `rank` from 1 to a list that a limit bounds."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(order, "chunk_id")))


def tokens(text: Column | str, pattern: str = TOKEN) -> Column:
    """Runs of small ASCII letters; r"\\p{L}+" takes all scripts."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


class Bm25Index:
    """Postings (term, chunk_id, doc_id, tf, length) and the corpus figures that scoring needs.

    Scores are those of Robertson and Zaragoza (2009) with ln((N - df + 0.5) / (df + 0.5) + 1) and any-term matching.
    """

    def __init__(self, postings: DataFrame, n_chunks: int, mean_length: float):
        self.postings, self.n, self.mean = postings, n_chunks, mean_length

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None, pattern: str = TOKEN) -> Bm25Index:
        """With a path, the ordered postings are written there and read from there."""
        words = chunks.select("chunk_id", "doc_id", tokens("text", pattern).alias("words"))
        lengths = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
        each = words.withColumn("length", F.size("words")).withColumn("term", F.explode("words"))
        made = cls(each.groupBy("term", "chunk_id", "doc_id", "length").agg(F.count("*").alias("tf")), lengths["n"], lengths["mean"] or 0.0)
        if path:
            made.ordered().write.mode("overwrite").parquet(path)
            made.postings = chunks.sparkSession.read.parquet(path)
        return made

    def ordered(self) -> DataFrame:
        """The postings in order of term and chunk: written so, a query reads few row groups, and a common word's postings are
        many tasks' and files'."""
        return self.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")

    def search(self, query: str, pool: int) -> DataFrame:
        """(chunk_id, doc_id, score, rank) of the best chunks that hold a word of the query."""
        words = sorted(set(_words(query)))
        hit = self.postings.filter(F.col("term").isin(words)) if words else self.postings.limit(0)
        df = F.broadcast(hit.groupBy("term").agg(F.count("*").alias("df")))  # a row for each word of the query
        idf = F.log((F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(self.mean or 1.0)))
        scored = hit.join(df, "term").groupBy("chunk_id", "doc_id").agg(F.sum(part).alias("score"))
        # Rounded, as a sum's last bits follow the order of the shuffle and would decide ties.
        return _ranked(scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "chunk_id").limit(pool), F.desc("score"))


def _words(query: str) -> list[str]:
    import re

    return re.findall(TOKEN, query.lower())


def bm25_hits(chunks: DataFrame, query: str, pool: int) -> DataFrame:
    """BM25 without an index: chunks are tokenized once, and only occurrences of the query's words leave their task."""
    words = sorted(set(_words(query)))
    wanted = F.filter("words", lambda x: x.isin(words)) if words else F.array().cast("array<string>")
    told = chunks.select("chunk_id", "doc_id", tokens("text").alias("words")).select("chunk_id", "doc_id", F.size("words").alias("length"), wanted.alias("wanted"))
    told = written(told, "words")  # without texts; read for the figures, the words' and the chunks' counts
    figures = told.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    hits = told.select("chunk_id", "doc_id", "length", F.explode("wanted").alias("term"))
    postings = hits.groupBy("term", "chunk_id", "doc_id", "length").agg(F.count("*").alias("tf"))
    return Bm25Index(postings, figures["n"], figures["mean"] or 0.0).search(query, pool)


def fuse(vector: DataFrame, lexical: DataFrame, constant: int = RRF) -> DataFrame:
    """(chunk_id, doc_id, score, v, b): reciprocal ranks of both lists added up; a list that lacks a chunk gives 0."""
    one = vector.select("chunk_id", "doc_id", F.col("rank").alias("v"), F.lit(None).cast("int").alias("b"))
    two = lexical.select("chunk_id", "doc_id", F.lit(None).cast("int").alias("v"), F.col("rank").alias("b"))
    merged = one.unionByName(two).groupBy("chunk_id", "doc_id").agg(F.max("v").alias("v"), F.max("b").alias("b"))
    part = lambda r: F.coalesce(1 / (constant + F.col(r)), F.lit(0.0))
    return merged.withColumn("score", part("v") + part("b"))


def best(fused: DataFrame, k: int) -> DataFrame:
    """The k best; equal scores in the order in which the lists bring them, the vector list first."""
    return fused.orderBy(F.desc("score"), F.asc_nulls_last("v"), F.asc_nulls_last("b")).limit(k)


def allowed(fused: DataFrame, documents: DataFrame, internal: bool) -> DataFrame:
    """Filtering after ranking: scores are those of the unfiltered lists, and fewer than k rows may be left."""
    return fused.join(documents.filter(F.col("internal") == internal).select("doc_id"), "doc_id", "left_semi")


def materialise(top: DataFrame, chunks: DataFrame, documents: DataFrame, via: str = "hybrid") -> DataFrame:
    """Result rows of the few chunks that are left; chunks without a document vanish."""
    rows = chunks.select("chunk_id", "page", "text").join(F.broadcast(top), "chunk_id")
    known = documents.select("doc_id", "title", "rel_path", "topic", "internal").join(F.broadcast(top.select("doc_id").distinct()), "doc_id")
    return rows.join(F.broadcast(known), "doc_id").select(
        "chunk_id", "doc_id", T.or_default("title", "(untitled)").alias("title"), "rel_path", T.or_default("topic", "").alias("topic"),
        F.coalesce("page", F.lit(0)).alias("page"), F.round("score", 6).alias("score"), T.snippet("text").alias("snippet"), F.lit(via).alias("via"), "internal",
    )


def neighbours(seeds: DataFrame, similar: DataFrame, doc_authors: DataFrame, doc_keywords: DataFrame, limit: int) -> DataFrame:
    """(doc_id, score): documents next to the seeds (doc_id, w) by likeness, shared authors and shared keywords; the 3 * limit best."""
    seeds = F.broadcast(seeds.select("doc_id", "w"))  # SEEDS rows at most
    like = seeds.join(similar, "doc_id").select(F.col("other_id").alias("doc"), (F.col("score") * F.col("w")).alias("s"))

    def shared(edges: DataFrame, key: str, weight: float) -> DataFrame:
        own = seeds.join(edges, "doc_id").select(key, "w")
        return own.join(edges, key).select(F.col("doc_id").alias("doc"), (F.col("w") * weight).alias("s"))

    both = like.unionByName(shared(doc_authors, "author_id", AUTHOR_WEIGHT)).unionByName(shared(doc_keywords, "keyword_id", KEYWORD_WEIGHT))
    scored = both.groupBy(F.col("doc").alias("doc_id")).agg(F.sum("s").alias("score")).join(seeds, "doc_id", "left_anti")
    return scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(3 * limit)


def expand(found: DataFrame, chunks: DataFrame, documents: DataFrame, query: list[float], limit: int) -> DataFrame:
    """Each neighbour by its chunk nearest to the query, the `limit` best; neighbours without chunks or document vanish."""
    near = chunks.join(F.broadcast(found), "doc_id").withColumn("d", V.cosine_distance("embedding", V.literal(query)))
    first = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("d"), "chunk_id")
    one = near.withColumn("n", F.row_number().over(first)).filter("n = 1").select("chunk_id", "doc_id", "score")
    one = one.join(documents.select("doc_id"), "doc_id", "left_semi")
    return materialise(one.orderBy(F.desc("score"), "doc_id").limit(limit), chunks, documents, "graph")


def query_vector(query: str, embedder) -> list[float]:
    """By embed_query, if the embedder has it."""
    embed = getattr(embedder, "embed_query", None)
    return embed(query) if callable(embed) else embedder.embed([query])[0]


def search(
    chunks: DataFrame, documents: DataFrame, query: str, embedder, k: int = 10, pool: int | None = None, internal: bool | None = None,
    graph: dict[str, DataFrame | Callable[[DataFrame], DataFrame]] | None = None, index: Bm25Index | None = None, digits: int | None = None,
) -> DataFrame:
    """Result rows, hybrid ones first.  Without a graph (or with one that lacks a table) nothing is expanded.  Its doc_similar may be
    a function that finds the rows of the seeds (doc_id), where no table of all pairs is stored."""
    n = pool_size(k, pool, internal is not None)
    vector = query_vector(query, embedder)
    fused = fuse(vector_hits(chunks, vector, n, digits), index.search(query, n) if index else bm25_hits(chunks, query, n))
    if internal is not None:
        fused = allowed(fused, documents, internal)
    # k rows: taken once, as hits, seeds and exclusions all follow from them.
    spark, best_k = chunks.sparkSession, best(fused, k).select("chunk_id", "doc_id", "score")
    rows = best_k.collect()
    out = materialise(spark.createDataFrame(rows, best_k.schema), chunks, documents)
    if not rows or not graph or not {"doc_similar", "doc_authors", "doc_keywords"} <= set(graph):
        return out
    weights: dict = {}
    known = {r["doc_id"] for r in documents.filter(F.col("doc_id").isin([r["doc_id"] for r in rows])).select("doc_id").collect()}
    for r in rows:
        if r["doc_id"] in known:
            weights[r["doc_id"]] = weights.get(r["doc_id"], 0.0) + round(r["score"], 6)
    seeds = sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:SEEDS]
    if not seeds:
        return out
    limit = max(3, k // 2)
    seeds = spark.createDataFrame(seeds, f"doc_id {best_k.schema['doc_id'].dataType.simpleString()}, w double")
    similar = graph["doc_similar"](seeds) if callable(graph["doc_similar"]) else graph["doc_similar"]
    found = neighbours(seeds, similar, graph["doc_authors"], graph["doc_keywords"], limit)
    return out.unionByName(expand(found.filter(~F.col("doc_id").isin(list(weights))), chunks, documents, vector, limit))
