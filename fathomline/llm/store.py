"""A content-addressed store of token ids.

A rolling hash over the last WINDOW ids cuts each document's id stream into chunks, so equal passages give equal chunks
wherever they stand.  A chunk's address is a 128-bit BLAKE2 digest of its ids.  A chunk that several documents hold is
written once, to `kind=chunk`; one that a single document holds is written once with that document's recipe, to
`kind=document`, whose files are in ascending doc_id order.  A recipe lists the addresses and sizes; its Merkle root is
stored with it.  The manifest, `kind=manifest`, is written with them from the roots as encoded: for each file range (part)
its documents, ids and a Merkle root over its documents, and a row with part HEAD for all parts.

Reading back first holds the documents found against the manifest, and fails on a file or row that is lost, added or out of
place.  It joins shared chunks to the recipes that name them (recipes with the same root are put together once),
checks every chunk against its address and every document against its root, and fails on a difference.

Ids are little-endian unsigned integers of 16 bits, or 32 for larger vocabularies, in zstandard blocks.  A null or empty
text is one id, END.  Rows that repeat a doc_id are documents of their own, next to each other; null doc_ids come first.
Other columns are ignored.  An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels, tokens
from .common import documents, id_text, scratch_root, stage

WINDOW = 16
MEAN, LEAST, MOST = 256, 64, 2048
_ENCODED = "doc_id long, n_tokens long, width int, sizes array<int>, addresses array<binary>, root binary, ids binary"
_RECORD = (
    "kind string, doc_id long, part int, local_start long, n_tokens long, width int, sizes array<int>, addresses array<binary>, "
    "shared array<int>, root binary, address binary, ids binary, n_docs long"
)
#: The part of the manifest's row for the whole store.
HEAD = -1


_DOCUMENT = ("doc_id", "n_tokens", "width", "sizes", "addresses", "root")


def _squeeze(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a binary tree of digests; an odd one goes up as it is."""
    if not leaves:
        return address(b"")
    while len(leaves) > 1:
        leaves = [address(b"\1" + b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def cuts(ids: np.ndarray, border: np.ndarray) -> list[list[int]]:
    """For each row, where its chunks end.  A chunk ends after an id at which the rolling hash of the last WINDOW ids is
    0 modulo MEAN, at least LEAST and at most MOST ids from its start, or with the row."""
    n = len(ids)
    power, unpower = kernels._powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(kernels.mix(ids.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    low = np.maximum(np.arange(1, n + 1) - WINDOW, 0)
    rolling = kernels.mix((total[1:] - total[low]) * unpower[low])
    marks = np.flatnonzero(rolling % np.uint64(MEAN) == 0) + 1
    out = []
    for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        ends, at = [], a
        if b - a > LEAST:
            for m in marks[np.searchsorted(marks, a + WINDOW) : np.searchsorted(marks, b)].tolist():
                while m - at > MOST:
                    at += MOST
                    ends.append(at - a)
                if m - at >= LEAST:
                    at = m
                    ends.append(at - a)
            while b - at > MOST:
                at += MOST
                ends.append(at - a)
        out.append([*ends, b - a])
    return out


def _encode(path: str):
    def run(batches):
        try:
            yield from rows_of(batches)
        finally:
            tokens.WordCoder.release()

    def rows_of(batches):
        for batch in batches:
            names = batch.column("doc_id")
            for row, ids, border in tokens.encoded(path, batch):
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                width = ids.itemsize
                sizes, addresses, roots, blobs = [], [], [], []
                for a, b, ends in zip(border[:-1].tolist(), border[1:].tolist(), cuts(ids, border), strict=True):
                    starts = [0, *ends[:-1]]
                    own = [address(raw[width * (a + s) : width * (a + e)]) for s, e in zip(starts, ends, strict=True)]
                    sizes.append([e - s for s, e in zip(starts, ends, strict=True)])
                    addresses.append(own)
                    roots.append(merkle_root(own))
                    blobs.append(_squeeze(raw[width * a : width * b]))
                rows = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(row, rows),
                        pa.array(np.diff(border)),
                        pa.array(np.full(rows, width), pa.int32()),
                        pa.array(sizes, pa.list_(pa.int32())),
                        pa.array(addresses, pa.list_(pa.binary())),
                        pa.array(roots, pa.binary()),
                        pa.array(blobs, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "width", "sizes", "addresses", "root", "ids"],
                )

    return run


_SCHEMA = pa.schema(
    [
        ("kind", pa.string()), ("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()),
        ("sizes", pa.list_(pa.int32())), ("addresses", pa.list_(pa.binary())), ("shared", pa.list_(pa.int32())), ("root", pa.binary()), ("address", pa.binary()), ("ids", pa.binary()), ("n_docs", pa.int64()),
    ]
)


def _records(batches):
    """Rows come in doc_id order, a document's list of shared addresses before the document: what is written of them, and
    the part's row of the manifest.

    Documents that share nothing and repeat no chunk, which are most, go through as they are."""
    part, before, held, shared, owed = TaskContext.get().partitionId(), 0, None, set(), set()
    first, roots = None, []
    for batch in batches:
        order = batch.column("order").to_numpy()
        ids, named = batch.column("doc_id").to_pylist(), batch.column("addresses")
        n = batch.column("n_tokens").fill_null(0).to_numpy()
        starts = before + np.cumsum(n) - n
        before += int(n.sum())
        coming = batch.filter(pa.array(order == 1))
        roots += coming.column("root").to_pylist()
        if first is None:
            first = next((i for i in coming.column("doc_id").to_pylist() if i is not None), None)
        plain, out = [], []
        for i in range(len(batch)):
            if order[i] == 0:
                held, shared, owed = ids[i], set(batch.column("held")[i].as_py()), set(batch.column("owned")[i].as_py())
                continue
            if held != ids[i]:
                held, shared, owed = ids[i], set(), set()
            size = len(named[i].values)
            if not shared and (size == 1 or len(set(named[i].as_py())) == size):
                plain.append(i)
                continue
            r = {c: batch.column(c)[i].as_py() for c in _DOCUMENT}
            raw, at, own, places, width = _unsqueeze(batch.column("ids")[i].as_py()), 0, {}, [], r["width"]
            for k, (size, name) in enumerate(zip(r["sizes"], r["addresses"], strict=True)):
                piece = raw[width * at : width * (at + size)]
                at += size
                if name not in shared:
                    own.setdefault(name, piece)
                    continue
                places.append(k)
                if name in owed:  # once, by the smallest document that holds it
                    out.append({"kind": "chunk", "width": width, "address": name, "ids": _squeeze(piece)})
                    owed.discard(name)
            out.append({"kind": "document", "part": part, "local_start": int(starts[i]), "shared": places, "ids": _squeeze(b"".join(own.values()))} | r)
        if plain:
            at = pa.array(plain)
            rows = len(plain)
            known = {c: batch.column(c).take(at) for c in [*_DOCUMENT, "ids"]} | {
                "kind": pa.array(["document"] * rows), "part": pa.array(np.full(rows, part), pa.int32()), "local_start": pa.array(starts[plain]), "shared": pa.array([[]] * rows, pa.list_(pa.int32())), "address": pa.nulls(rows, pa.binary()), "n_docs": pa.nulls(rows, pa.int64())
            }
            yield pa.RecordBatch.from_arrays([known[f.name].cast(f.type) for f in _SCHEMA], schema=_SCHEMA)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
    if roots:
        told = {"kind": "manifest", "doc_id": first, "part": part, "n_docs": len(roots), "n_tokens": before, "root": merkle_root(roots)}
        yield pa.RecordBatch.from_pylist([told], schema=_SCHEMA)


class Store:
    """A store at a path that any Spark filesystem can hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(_RECORD).parquet(self.path).filter(F.col("kind") == kind)

    @classmethod
    def write(cls, docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> Store:
        spark = docs.sparkSession
        path = path or f"{scratch_root(spark)}/store-{uuid.uuid4().hex}"
        done = stage(id_text(docs).mapInArrow(_encode(tokenizer or tokens.default_path()), _ENCODED), "store-encoded", compression="none")
        held = done.filter("doc_id is not null").select("doc_id", F.explode("addresses").alias("address")).distinct()
        counted = held.groupBy("address").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        shared = stage(counted.filter("first_doc < last_doc").select("address", "first_doc"), "store-shared")
        mine = F.when(F.col("doc_id") == F.col("first_doc"), F.col("address"))
        lists = held.join(shared, "address").groupBy("doc_id").agg(F.collect_list("address").alias("held"), F.collect_list(mine).alias("owned"))
        both = lists.withColumn("order", F.lit(0)).unionByName(done.withColumn("order", F.lit(1)), allowMissingColumns=True)
        n_docs, n_tokens, size = done.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(F.col("n_tokens") * F.col("width")), F.lit(0))).first()
        dealt = both.repartitionByRange(_ranges(spark, size), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "order", "root")
        dealt.mapInArrow(_records, _RECORD).write.partitionBy("kind").option("compression", "none").parquet(path)
        made = cls(spark, path)
        parts = made.manifest().orderBy("part").collect()
        if (sum(r["n_docs"] for r in parts), sum(r["n_tokens"] for r in parts)) != (n_docs, n_tokens):
            raise ValueError("the store does not hold the documents that were encoded")
        head = [("manifest", HEAD, n_docs, n_tokens, merkle_root([r["root"] for r in parts]))]
        columns = "kind string, part int, n_docs long, n_tokens long, root binary"
        spark.createDataFrame(head, columns).coalesce(1).write.mode("append").partitionBy("kind").option("compression", "none").parquet(path)
        return made

    def manifest(self) -> DataFrame:
        """(part, first_doc, n_docs, n_tokens, root): a Merkle root for each range of documents, as written."""
        return self.read("manifest").filter(F.col("part") != HEAD).select("part", F.col("doc_id").alias("first_doc"), "n_docs", "n_tokens", "root")

    def found(self) -> DataFrame:
        """(part, n_docs, n_tokens, root) of the documents that are there; no root if a part's documents don't follow each other."""
        leaves = self.read("document").select("part", "local_start", "n_tokens", "root")
        dealt = leaves.repartitionByRange("part").sortWithinPartitions("part", "local_start")
        return dealt.mapInArrow(_parts, "part int, n_docs long, n_tokens long, root binary")

    def starts(self) -> dict[int, int]:
        """The ids before each range of documents, by the manifest: a number for each partition.  Fails if the manifest or the
        documents found are not as written."""
        wrong = "the store is not what its root says: "
        told = self.read("manifest").select("part", "n_docs", "n_tokens", "root").orderBy("part").collect()
        heads, parts = [r for r in told if r["part"] == HEAD], [r for r in told if r["part"] != HEAD]
        whole = (sum(r["n_docs"] for r in parts), sum(r["n_tokens"] for r in parts), merkle_root([r["root"] for r in parts]))
        if [tuple(r)[1:] for r in heads] != [whole]:
            raise ValueError(wrong + "its manifest is lost or damaged")
        expected, found = {r["part"]: tuple(r)[1:] for r in parts}, {r["part"]: tuple(r)[1:] for r in self.found().collect()}
        for part in sorted(expected.keys() | found.keys()):
            if expected.get(part) != found.get(part):
                n = [x[:2] if x else (0, 0) for x in (expected.get(part), found.get(part))]
                raise ValueError(wrong + f"part {part} was written with {n[0][0]} documents of {n[0][1]} ids, found are {n[1][0]} of {n[1][1]}, or others")
        out, before = {}, 0
        for r in parts:
            out[r["part"]], before = before, before + r["n_tokens"]
        return out

    def read_documents(self, with_ids: bool = False) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids as bytes: every document, put together and checked."""
        documents = self.read("document")
        first = self.spark.sparkContext.broadcast(self.starts())
        wanted = documents.filter(F.size("shared") > 0)
        names = wanted.select("root", "n_tokens", F.explode(F.array_distinct(F.transform("shared", lambda i: F.get("addresses", i)))).alias("address")).distinct()
        chunks = self.read("chunk").select("address", F.col("ids").alias("chunk"))
        # Recipes that are equal are fetched once, and a recipe's chunks are no more than its document.
        fetched = names.join(chunks, "address").groupBy("root", "n_tokens").agg(F.collect_list(F.struct("address", "chunk")).alias("fetched"))
        fetched = stage(fetched, "store-fetched", compression="none")
        alone = documents.filter(F.size("shared") == 0).withColumn("fetched", F.lit(None).cast("array<struct<address:binary,chunk:binary>>"))
        rows = wanted.join(fetched, ["root", "n_tokens"], "left").select(alone.columns).unionByName(alone)
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
        return rows.mapInArrow(lambda batches: _rebuilt(batches, first.value, with_ids), schema)


def _parts(batches):
    """The documents of each part, which follow each other in their order, in sum."""
    schema = pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])
    key, total, whole, roots = None, 0, True, []

    def told():
        row = {"part": key, "n_docs": len(roots), "n_tokens": total, "root": merkle_root(roots) if whole else None}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        for part, start, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "n_tokens", "root")), strict=True):
            if part != key:
                if roots:
                    yield told()
                key, total, whole, roots = part, 0, True, []
            whole = whole and start == total
            total += n
            roots.append(root)
    if roots:
        yield told()


def _rebuilt(batches, first, with_ids):
    import zlib

    for batch in batches:
        out = []
        for r in batch.select(["doc_id", "part", "local_start", "width", "sizes", "addresses", "root", "ids", "fetched"]).to_pylist():
            own, at, width, parts = _unsqueeze(r["ids"]), 0, r["width"], []
            chunks = {x["address"]: _unsqueeze(x["chunk"]) for x in r["fetched"] or []}
            for i, (n, name) in enumerate(zip(r["sizes"], r["addresses"], strict=True)):
                if name not in chunks:
                    chunks[name], at = own[at : at + width * n], at + width * n
                piece = chunks[name]
                if address(piece) != name:
                    raise ValueError(f"document {r['doc_id']}: chunk {i} is not what its address says")
                parts.append(piece)
            if merkle_root(list(r["addresses"])) != r["root"]:
                raise ValueError(f"document {r['doc_id']}: its recipe is not what its root says")
            ids = np.frombuffer(b"".join(parts), dtype=f"<u{width}").astype("<u4").tobytes()
            row = {"doc_id": r["doc_id"], "start": first[r["part"]] + r["local_start"], "n_tokens": len(ids) // 4, "ids_crc32": zlib.crc32(ids)}
            out.append(row | ({"ids": ids} if with_ids else {}))
        if out:
            fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))


def _ranges(spark: SparkSession, size: int) -> int:
    """As many ranges as the session's shuffles have partitions, or as ids of so many bytes need to be of at most 128 MB."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (128 << 20)))


def op4_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store.write(documents(spark, sf_dir)).read_documents()
