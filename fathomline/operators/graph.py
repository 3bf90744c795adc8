"""Entities, edges and patterns of the library graph, as tables.  A fixed pattern is a join; there is no graph object."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..scratch import written
from .neighbours import similar_nearby

SIMILAR_K, LEAST_SCORE = 8, 0.5
#: Vectors of a block of the exact neighbour search.
BLOCK = 4096


def exploded(docs: DataFrame, array: str, name: str) -> DataFrame:
    """(doc_id, <name>, position), positions from 1."""
    return docs.filter(F.col(array).isNotNull()).select("doc_id", F.posexplode(array).alias("_p", name)).select("doc_id", name, (F.col("_p") + 1).alias("position"))


def nodes(values: DataFrame, value: str, norm: Column, order: Column, prefix: str, name: str = "name", least: int = 1) -> DataFrame:
    """(<prefix>_id, <name>, <name>_norm): a node for each normalised value, spelled as the smallest by (order, spelling).

    Ids number the nodes by their normalised value.
    """
    known = values.select(F.col(value).alias("v"), norm.alias("n"), order.alias("o")).filter(F.col("v").isNotNull() & (F.length("n") >= least))
    spelled = known.groupBy("n").agg(F.min(F.struct("o", "v")).alias("m"))
    return numbered(spelled, "n", f"{prefix}_id").select(f"{prefix}_id", F.col("m.v").alias(name), F.col("n").alias(f"{name}_norm"))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with `name`: 1, 2, 3 ... in the order of the key, whose values differ.  Ranges of the key are counted one by one, and
    begin where those before them end, so no task sees more than a range."""
    low = 33  # monotonically_increasing_id() has the place in the partition in its low bits
    placed = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed, "numbered").withColumn("_part", F.shiftright("_place", low)).withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << low) - 1)))
    before, starts = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("_part").count().collect())):  # a row for each range
        starts.append((part, before))
        before += n
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _before long"))
    return placed.join(first, "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def authors(docs: DataFrame) -> DataFrame:
    each = exploded(docs, "authors", "a")
    return nodes(each, "a", T.norm_name("a"), F.col("position"), "author")


def doc_authors(docs: DataFrame, authors: DataFrame) -> DataFrame:
    """A bag: two spellings of one author in a document are two edges."""
    each = exploded(docs, "authors", "a").withColumn("name_norm", T.norm_name("a"))
    return each.join(authors, "name_norm").select("doc_id", "author_id", "position")


def topics(docs: DataFrame) -> DataFrame:
    named = docs.filter("topic is not null and topic <> ''").select("topic").distinct()
    return numbered(named, "topic", "topic_id").select("topic_id", F.col("topic").alias("name"))


def doc_topics(docs: DataFrame, topics: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("topic").alias("name")).filter("name <> ''").join(topics, "name").select("doc_id", "topic_id")


def companies(docs: DataFrame) -> DataFrame:
    named = docs.filter("rel_path is not null").select(T.company("rel_path").alias("c")).filter("c <> ''")
    return nodes(named, "c", T.norm_name("c"), F.col("c"), "company")


def doc_companies(docs: DataFrame, companies: DataFrame) -> DataFrame:
    named = docs.filter("rel_path is not null").select("doc_id", T.company("rel_path").alias("c")).filter("c <> ''")
    return named.withColumn("name_norm", T.norm_name("c")).join(companies, "name_norm").select("doc_id", "company_id")


def keywords(enrichment: DataFrame) -> DataFrame:
    """Terms of three characters or more."""
    each = exploded(enrichment, "keywords", "k")
    return nodes(each, "k", T.norm_term("k"), F.col("k"), "keyword", "term", 3)


def doc_keywords(enrichment: DataFrame, keywords: DataFrame) -> DataFrame:
    """Edges may dangle: documents that are gone keep their enrichment."""
    each = exploded(enrichment, "keywords", "k").withColumn("term_norm", T.norm_term("k"))
    return each.join(keywords, "term_norm").select("doc_id", "keyword_id", F.lit(1.0).alias("score"))


def document_vectors(chunks: DataFrame) -> DataFrame:
    """(doc_id, vector): the mean of a document's chunk vectors over its length; null vectors don't count.  Arrow batches are
    summed before the shuffle, and sums that follow each other after it, so no row or task holds a document's vectors at once."""
    kind = chunks.schema["doc_id"].dataType.simpleString()
    ids = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    schema = pa.schema([("doc_id", ids), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def summed(batches):
        for batch in batches:
            names, vectors = batch.column("doc_id").to_pylist(), batch.column("embedding")
            if not names:
                continue
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            codes = {name: i for i, name in enumerate(dict.fromkeys(names))}
            places = np.array([codes[x] for x in names])
            total = np.zeros((len(codes), len(flat) // len(names)))
            np.add.at(total, places, flat.reshape(len(names), -1))
            counts = np.bincount(places, minlength=len(codes))
            yield table_of(list(zip(codes, counts.tolist(), total.tolist(), strict=True)))

    def merged(batches):
        held = None
        for batch in batches:
            out = []
            for name, n, total in zip(*(batch.column(c).to_pylist() for c in schema.names), strict=True):
                if held and held[0] == name:
                    held = (name, held[1] + n, held[2] + np.array(total))
                else:
                    out += [held] if held else []
                    held = (name, n, np.array(total))
            if out:
                yield table_of(out)
        if held:
            yield table_of([held])

    fields = f"doc_id {kind}, n bigint, total array<double>"
    sums = chunks.filter("embedding is not null").select("doc_id", "embedding").mapInArrow(summed, fields)
    whole = sums.repartition("doc_id").sortWithinPartitions("doc_id", "n", "total").mapInArrow(merged, fields)
    return whole.select("doc_id", V.unit(F.transform("total", lambda x: x / F.col("n"))).alias("vector"))


def similar(vectors: DataFrame, k: int = SIMILAR_K, least: float = LEAST_SCORE, block: int = BLOCK) -> DataFrame:
    """(doc_id, other_id, score): each document's k nearest others of cosine `least` or more, exact and directed.

    Vectors are dealt into blocks of about `block`; every two blocks meet in one task, which keeps k rows for each of its
    documents, and a window keeps k of those.  The search is exact, so its work is the square of the documents' number;
    blocks bound what a task holds.
    """
    kind = vectors.schema["doc_id"].dataType
    vectors = written(vectors, "vectors")  # counted, and read from both sides
    n = vectors.count()
    blocks = max(1, -(-n // block))
    dealt = vectors.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.select("doc_id", "vector", F.col("b").alias("i"), other.alias("j"))
    # Names of its own: a cogroup of two frames with one lineage would mix up equal ones.
    right = dealt.select(F.col("doc_id").alias("other_id"), F.col("vector").alias("other_vector"), F.col("b").alias("right_j"), other.alias("right_i"))
    fields = "doc_id {0}, other_id {0}, score double".format(kind.simpleString())

    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"doc_id": pa.array([], id_type), "other_id": pa.array([], id_type), "score": pa.array([], pa.float64())})
        ids_a, ids_b = a.column("doc_id").to_pylist(), b.column("other_id").to_pylist()
        x, y = (np.array(t.column(c).to_pylist(), dtype=np.float64).reshape(t.num_rows, -1) for t, c in ((a, "vector"), (b, "other_vector")))
        out: tuple[list, list, list] = ([], [], [])
        names = np.array(ids_b, dtype=object)
        for at in range(0, len(x), 512):
            scores = np.round(x[at : at + 512] @ y.T, 9)
            # The least of the k + 1 best (one may be the document itself) bounds what has to be sorted.
            bound = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)] if len(y) > k + 1 else np.full(len(scores), -np.inf)
            for r, row in enumerate(scores):
                found = [(-row[c], names[c]) for c in np.flatnonzero(row >= max(least, bound[r])) if names[c] != ids_a[at + r]]
                for s, name in sorted(found)[:k]:
                    out[0].append(ids_a[at + r])
                    out[1].append(name)
                    out[2].append(float(-s))
        kinds = [id_type, id_type, pa.float64()]
        return pa.table([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["doc_id", "other_id", "score"])

    pairs = left.groupBy("i", "j").cogroup(right.groupBy("right_i", "right_j")).applyInArrow(meet, fields)
    if blocks == 1:
        return pairs
    nearest = Window.partitionBy("doc_id").orderBy(F.desc("score"), "other_id")
    return pairs.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k).drop("n")


def similar_to(seeds: DataFrame, vectors: DataFrame, k: int = SIMILAR_K, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `similar` for the documents of seeds (doc_id) alone, of which there are few: their vectors go to every task and
    meet all others there, so work and disk grow with the documents and not with their pairs."""
    kind = vectors.schema["doc_id"].dataType
    vectors = written(vectors, "vectors")  # read for the seeds, and as a whole
    asked = vectors.join(F.broadcast(seeds.select("doc_id").distinct()), "doc_id").select("doc_id", "vector").collect()
    shared = vectors.sparkSession.sparkContext.broadcast(([r["doc_id"] for r in asked], [r["vector"] for r in asked]))
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())

    def meet(batches):
        own, x = shared.value[0], [np.array(v, dtype=np.float64) for v in shared.value[1]]
        best: list[list[tuple]] = [[] for _ in own]
        for batch in batches:
            if not batch.num_rows or not own:
                continue
            names = batch.column("doc_id").to_pylist()
            y = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1)
            for r, name in enumerate(own):
                scores = np.round(y @ x[r], 9)
                bound = np.partition(scores, -(k + 1))[-(k + 1)] if len(scores) > k + 1 else -np.inf  # one may be the document itself
                found = [(-float(scores[c]), names[c]) for c in np.flatnonzero(scores >= max(least, bound)) if names[c] != name]
                best[r] = sorted(best[r] + found)[:k]
        rows = [(name, other, -s) for name, found in zip(own, best, strict=True) for s, other in found]
        kinds = {"doc_id": id_type, "other_id": id_type, "score": pa.float64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    near = vectors.select("doc_id", "vector").mapInArrow(meet, "doc_id {0}, other_id {0}, score double".format(kind.simpleString()))
    nearest = Window.partitionBy("doc_id").orderBy(F.desc("score"), "other_id")
    return near.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k).drop("n")


def build(documents: DataFrame, chunks: DataFrame, enrichment: DataFrame | None = None, k: int = SIMILAR_K, least: float = LEAST_SCORE, nearby: str | None = None) -> dict[str, DataFrame]:
    """All node and edge tables by name.  With a path for an index in `nearby`, similar documents are searched with it: some may
    be missed, but the work isn't quadratic."""
    out = {"authors": authors(documents), "topics": topics(documents), "companies": companies(documents)}
    out |= {"doc_authors": doc_authors(documents, out["authors"]), "doc_topics": doc_topics(documents, out["topics"]), "doc_companies": doc_companies(documents, out["companies"])}
    if enrichment is not None:
        out["keywords"] = keywords(enrichment)
        out["doc_keywords"] = doc_keywords(enrichment, out["keywords"])
    vectors = document_vectors(chunks)
    out["doc_similar"] = similar_nearby(vectors, nearby, k, least) if nearby else similar(vectors, k, least)
    return out


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- patterns ----------------------------------------------------------------------------------------------------------


def papers_by_author(documents: DataFrame, edges: DataFrame, authors: DataFrame, name_norm: str, limit: int = 25) -> DataFrame:
    one = F.broadcast(authors.filter(F.col("name_norm") == name_norm).select("author_id"))
    found = edges.join(one, "author_id").join(documents, "doc_id").select("title", "rel_path", "year").distinct()
    return found.orderBy(F.desc_nulls_last("year"), "title", "rel_path").limit(limit)


def coauthors(edges: DataFrame, authors: DataFrame, name_norm: str, limit: int = 25) -> DataFrame:
    """(coauthor, shared_papers), counted by paths: an author that a document has twice counts twice."""
    one = F.broadcast(authors.filter(F.col("name_norm") == name_norm).select("author_id"))
    mine = edges.join(one, "author_id").select("doc_id")
    others = edges.join(mine, "doc_id").join(authors.filter(F.col("name_norm") != name_norm), "author_id")
    return others.groupBy(F.col("name").alias("coauthor")).agg(F.count("*").alias("shared_papers")).orderBy(F.desc("shared_papers"), "coauthor").limit(limit)


def company_counts(edges: DataFrame, companies: DataFrame, limit: int = 100) -> DataFrame:
    found = edges.groupBy("company_id").agg(F.count("*").alias("docs")).join(companies, "company_id")
    return found.groupBy("name").agg(F.sum("docs").alias("docs")).orderBy(F.desc("docs"), "name").limit(limit)


def docs_by_company(documents: DataFrame, edges: DataFrame, companies: DataFrame, name_norm: str, limit: int = 40) -> DataFrame:
    one = F.broadcast(companies.filter(F.col("name_norm") == name_norm).select("company_id"))
    return edges.join(one, "company_id").join(documents, "doc_id").select("title", "topic", "rel_path").distinct().orderBy("topic", "title", "rel_path").limit(limit)


def related_by_keyword(documents: DataFrame, edges: DataFrame, doc_id, limit: int = 15) -> DataFrame:
    own = edges.filter(F.col("doc_id") == doc_id).select("keyword_id")
    others = edges.filter(F.col("doc_id") != doc_id).join(own, "keyword_id").join(documents, "doc_id")
    return others.groupBy("title", "rel_path").agg(F.count("*").alias("shared_keywords")).orderBy(F.desc("shared_keywords"), "title", "rel_path").limit(limit)
