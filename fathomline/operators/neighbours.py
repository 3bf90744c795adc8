"""An inverted file of vectors: nearest neighbours by cosine from the cells next to a query, where a full scan or all pairs
would be too much work.

Centres are fitted on a bounded sample (SAMPLE vectors, those with the least hash of their id); every vector is put into the cell
of its nearest centre.  A query looks into its `probes` nearest cells.  Probes are the fewest with which sampled queries find RECALL of
their true neighbours in the sample; as neighbours in the whole table are nearer than those in the sample, they are found at
least as often.  Vectors without structure need many probes, up to all cells, and then nothing is gained.

Distances within the cells are exact, ties go by chunk_id.  Zero and null vectors are kept in the cell NOWHERE and never found.
Repeated rows are rows of their own; an empty table gives an index that finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..scratch import written
from .retrieval import vector_hits

SAMPLE, TRIED, RECALL, ROUNDS = 16_384, 512, 0.95, 10
MOST_CELLS, NOWHERE = 4096, -1
#: Vectors, and queries, that meet in one task.
BLOCK = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal width; null ones are zero."""
    width = next((len(v) for v in column if v.is_valid), 0)
    return np.array([v.as_py() if v.is_valid else [0.0] * width for v in column], dtype=np.float64).reshape(len(column), width)


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of spherical k-means, begun with the first vectors; a centre that loses all of its own stays where it is."""
    centres = sample[:cells].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        held = np.linalg.norm(sums, axis=1) > 0
        centres[held] = _unit(sums[held])
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells in which the first TRIED vectors of the sample find `recall` of their k nearest others."""
    k, tried = min(k, len(sample) - 1), sample[:TRIED]
    if k < 1:
        return len(centres)
    cell = np.argmax(sample @ centres.T, axis=1)
    scores = tried @ sample.T
    scores[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    turn = np.argsort(np.argsort(-(tried @ centres.T), axis=1, kind="stable"), axis=1)  # a cell's place in a query's order
    needed = np.sort(np.take_along_axis(turn, cell[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


class VectorIndex:
    """The index of vectors (chunk_id, doc_id, embedding), a table at `path` in order of cells."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, probes: int):
        self.spark, self.path, self.centres, self.probes = spark, path, centres, probes

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, k: int = 10, recall: float = RECALL) -> VectorIndex:
        spark = vectors.sparkSession
        known = vectors.filter(F.coalesce(V.norm("embedding"), F.lit(0.0)) > 0)
        picked = known.select(F.xxhash64("chunk_id").alias("h"), "chunk_id", "embedding").orderBy("h", "chunk_id").limit(SAMPLE).collect()
        sample = _unit(np.array([r["embedding"] for r in picked], dtype=np.float64)) if picked else np.zeros((0, 0))
        cells = min(cells or max(1, round(known.count() ** 0.5)), MOST_CELLS, max(1, len(sample) // 4))
        centres = fit(sample, cells) if len(sample) else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast(centres)  # MOST_CELLS rows at most

        def dealt(batches):
            for batch in batches:
                x = _matrix(batch.column("embedding"))
                cell = np.full(len(batch), NOWHERE, dtype=np.int32)
                found = np.linalg.norm(x, axis=1) > 0
                if found.any():
                    cell[found] = np.argmax(_unit(x[found]) @ shared.value.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        rows = vectors.select("chunk_id", "doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
        placed = rows.mapInArrow(dealt, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell int")
        placed.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id").write.mode("overwrite").parquet(path)
        return cls(spark, path, centres, probes_for(sample, centres, k, recall) if len(sample) else 0)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, query: list[float], pool: int) -> DataFrame:
        """(chunk_id, doc_id, distance, rank): the nearest in the query's cells, which are all that is read."""
        cells = np.argsort(-(self.centres @ _unit(np.array([query], dtype=np.float64))[0]), kind="stable")[: self.probes] if len(self.centres) else []
        return vector_hits(self.rows().filter(F.col("cell").isin([int(c) for c in cells])), query, pool)

    def search_all(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, distance, rank) of queries (query_id, vector), each with the k nearest in its cells.

        Queries and vectors meet by cell, in blocks of some BLOCK of either, so a cell that holds a third of all rows is many
        tasks' work; each task keeps k rows a query, and a window keeps k of those.  query_id names one query."""
        centres, probes = self.spark.sparkContext.broadcast(self.centres), self.probes

        def probed(batches):
            for batch in batches:
                x = _matrix(batch.column("vector"))
                some = np.flatnonzero(np.linalg.norm(x, axis=1) > 0) if len(centres.value) else np.zeros(0, dtype=np.int64)
                order = np.argsort(-(_unit(x[some]) @ centres.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32) if len(some) else np.zeros((0, 0), dtype=np.int32)
                kept = batch.take(pa.array(some, pa.int64()))
                cells = pa.array(order.tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept.columns, cells], names=[*kept.schema.names, "cells"])

        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        name = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", asked), ("chunk_id", self.rows()))}
        asked = asked.mapInArrow(probed, f"query_id {name['query_id']}, vector array<double>, cells array<int>")
        asked = written(asked, "queries").select("query_id", "vector", F.explode("cells").alias("cell"))  # read for sizes, too
        blocks = lambda df, out: df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(out))
        held = self.rows().filter(F.col("cell") != NOWHERE)
        sizes = F.broadcast(blocks(held, "of_rows").join(blocks(asked, "of_queries"), "cell"))  # MOST_CELLS rows at most
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
        left = asked.join(sizes, "cell").select("query_id", "vector", "cell", own("query_id", "of_queries").alias("i"), every("of_rows").alias("j"))
        right = held.join(sizes, "cell").select("chunk_id", "embedding", F.col("cell").alias("cell_"), own("chunk_id", "of_rows").alias("j_"), every("of_queries").alias("i_"))
        kinds = [pa.int64() if name[c] == "bigint" else pa.int32() if name[c] == "int" else pa.string() for c in ("query_id", "chunk_id")] + [pa.float64()]

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            out: tuple[list, list, list] = ([], [], [])
            if a.num_rows and b.num_rows:
                x, y = _unit(_matrix(a.column("vector").combine_chunks())), _unit(_matrix(b.column("embedding").combine_chunks()))
                asks, ids = a.column("query_id").to_pylist(), np.array(b.column("chunk_id").to_pylist(), dtype=object)
                for at in range(0, len(x), 512):
                    far = np.round(1 - x[at : at + 512] @ y.T, 9)
                    bound = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(far), np.inf)
                    for r, row in enumerate(far):
                        for d, c in sorted((row[c], ids[c]) for c in np.flatnonzero(row <= bound[r]))[:k]:
                            out[0].append(asks[at + r])
                            out[1].append(c)
                            out[2].append(float(d))
            return pa.table([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["query_id", "chunk_id", "distance"])

        pairs = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell_", "i_", "j_")).applyInArrow(meet, f"query_id {name['query_id']}, chunk_id {name['chunk_id']}, distance double")
        nearest = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
        return pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def similar_nearby(vectors: DataFrame, path: str, k: int, least: float) -> DataFrame:
    """(doc_id, other_id, score): as graph.similar, by an index at `path`: work grows with documents times the cells' share that
    is probed, and some neighbours may be missed."""
    rows = vectors.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("vector").alias("embedding"))
    index = VectorIndex.build(rows, path, k=k)
    found = index.search_all(index.rows().select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector")), k + 1)
    near = found.filter(F.col("query_id") != F.col("chunk_id")).select(F.col("query_id").alias("doc_id"), F.col("chunk_id").alias("other_id"), F.round(1 - F.col("distance"), 9).alias("score"))
    nearest = Window.partitionBy("doc_id").orderBy(F.desc("score"), "other_id")
    return near.filter(F.col("score") >= least).withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k).drop("n")
