"""Concatenate and cut: documents packed into sequences of a fixed length with padding in the last one only.

Two passes.  The first encodes each document once and writes its ids with its partition and the ids before it in that
partition.  The partitions' totals (one number each) are summed up on the driver into global offsets.  The second pass
knows every document's global place, cuts it at multiples of the length, and needs no shuffle.  Pieces whose sequence
holds ids of more than one partition are marked: these boundary records are what a writer of whole partitions must
exchange.

A null or empty text is one id, END.  Rows that repeat are packed each; a null doc_id is kept.  Other columns are ignored.
An empty table has no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import documents, id_text, stage

LENGTH = 2048
_ENCODED = "doc_id long, part int, local_start long, n_tokens long, width int, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The first pass, staged: each document's ids and its place in its partition."""
    path = path or tokens.default_path()

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        try:
            yield from rows_of(batches, part, before)
        finally:
            tokens.WordCoder.release()

    def rows_of(batches, part, before):
        for batch in batches:
            names = batch.column("doc_id")
            for row, ids, border in tokens.encoded(path, batch):
                rows = len(border) - 1
                raw = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((border * ids.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                full = lambda v, t: pa.array(np.full(rows, v), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [names.slice(row, rows), full(part, pa.int32()), pa.array(border[:-1] + before), pa.array(np.diff(border)), full(ids.itemsize, pa.int32()), raw],
                    ["doc_id", "part", "local_start", "n_tokens", "width", "ids"],
                )
                before += len(ids)

    return stage(id_text(docs).mapInArrow(run, _ENCODED), "encoded", compression="zstd")


def offsets(encoded: DataFrame) -> dict[int, int]:
    """The ids before each partition; a number for each partition of the input, however many rows it has."""
    totals = encoded.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n")).collect()
    out, before = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        out[r["part"]] = before
        before += r["n"]
    return out


def _cut(batches, first, length, with_ids):
    borders = np.array(sorted(first.values()), dtype=np.int64)
    for batch in batches:
        if not len(batch):
            continue
        part, local, n = (batch.column(c).to_numpy() for c in ("part", "local_start", "n_tokens"))
        begin = np.array([first[int(p)] for p in part], dtype=np.int64) + local
        low = begin // length
        count = (begin + n - 1) // length - low + 1
        row = np.repeat(np.arange(len(n)), count)
        sequence = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(row))
        a = np.maximum(sequence * length, begin[row])
        b = np.minimum((sequence + 1) * length, begin[row] + n[row])
        crosses = np.searchsorted(borders, sequence * length, "right") < np.searchsorted(borders, (sequence + 1) * length, "left")
        widths, blobs = batch.column("width").to_numpy(), batch.column("ids")
        crc, pieces, last, ids = np.empty(len(row), dtype=np.int64), [], -1, b""
        for i, r in enumerate(row):
            if r != last:
                ids, last = memoryview(np.frombuffer(blobs[r].as_buffer(), dtype=f"<u{widths[r]}").astype("<u4")).cast("B"), r
            piece = ids[4 * (a[i] - begin[r]) : 4 * (b[i] - begin[r])]
            crc[i] = zlib.crc32(piece)
            if with_ids:
                pieces.append(bytes(piece))
        columns = [batch.column("doc_id").take(pa.array(row)), *(pa.array(x) for x in (a - begin[row], b - a, crc, n[row], sequence, a - sequence * length)), pa.array(crosses)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"]
        yield pa.RecordBatch.from_arrays(columns + ([pa.array(pieces, pa.binary())] if with_ids else []), names + (["ids"] if with_ids else []))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with_ids adds its ids as little-endian unsigned 32-bit integers."""
    done = encode(docs, path)
    first = docs.sparkSession.sparkContext.broadcast(offsets(done))
    return done.mapInArrow(lambda batches: _cut(batches, first.value, length, with_ids), _PIECES + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): whole sequences of pieces with ids, padded unless their size is a power of two."""
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))), lambda x: x["h"]), "")
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), raw.alias("h"))
    whole = (F.col("n_tokens") > 0) & (F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0)
    return out.select("sequence_id", "n_tokens", F.unhex(F.when(whole, F.col("h")).otherwise(F.rpad("h", 8 * length, pad.to_bytes(4, "little").hex()))).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
