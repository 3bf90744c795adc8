"""Near-duplicate documents: a multi-index Hamming join of MinHash signatures, then exact shingle sets.

A signature has K symbols of BITS bits, one for each hash function, so two documents' signatures differ in about
(1 - similarity) * K of them.  All pairs that differ in at most DISTANCE symbols are found: the signature is split into
CHUNKS chunks, and by the pigeonhole principle such a pair differs in at most DISTANCE // CHUNKS = 1 symbol in one of
them.  Every document therefore goes into one bucket for each chunk and each symbol of it that is left out, the allowed
error; the pair meets in one of these buckets.  At a similarity of exactly 0.85, DISTANCE is four standard deviations
above the mean, and the odds of missing a pair fall steeply above that.

Equal sets are one class throughout.  Buckets are worked off in two steps, without ever listing all pairs of one:

1. Each member is held against the smallest of its bucket, and confirmed links join classes into components.
2. What is left are buckets whose members are in several components.  Members of different components are compared,
   signatures first, then exact sets, until they are in one component or nothing is left.  A bucket whose sets are too
   large for a task is cut into blocks, and each two blocks meet in a task.

A link is only ever one that 100 * |intersection| >= THRESHOLD * |union| confirms on full sets of 64-bit hashes.

Null and empty texts have an empty set and link with nothing.  Rows that repeat a doc_id are one document, whose text is
the smallest of theirs.  Rows without a doc_id take no part and are not returned.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from .common import documents, id_text, repeats, sent_if_small, stage
from .components import components

THRESHOLD = 85
CHUNKS, WIDTH = 12, 6
K = CHUNKS * WIDTH
DISTANCE = 2 * CHUNKS - 1
BITS = 16
#: Shingles of a block of members that one task holds (8 bytes each, twice).
BLOCK_SHINGLES = 2_000_000
BLOCK_MEMBERS = 20_000
_SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, signature binary"


@kernels.releasing
def _sketch(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for row, data, offsets in kernels.slices(batch.column("text")):
            hashes, borders = kernels.shingles(data, offsets)
            one, two = kernels.digests(hashes, borders)
            signs = kernels.signatures(hashes, borders, K)
            rows = len(borders) - 1
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, rows), pa.array(np.diff(borders).astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _binary(signs)],
                ["doc_id", "n_shingles", "d1", "d2", "signature"],
            )


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), dtype=np.uint16).reshape(len(signatures), K)


@kernels.releasing
def _sets(batches):
    for batch in batches:
        ids = batch.column("id")
        for row, data, offsets in kernels.slices(batch.column("text")):
            hashes, borders = kernels.shingles(data, offsets)
            shingle_bytes = pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer((borders * 8).astype(np.int32)), pa.py_buffer(hashes)])
            yield pa.RecordBatch.from_arrays([ids.slice(row, len(borders) - 1), shingle_bytes], ["id", "hashes"])


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """rows x (CHUNKS * WIDTH): a key for each chunk and each symbol of it that is left out.  Its place, chunk * WIDTH +
    symbol, is the key's last seven bits."""
    out = np.empty((len(signatures), K), dtype=np.uint64)
    wide = signatures.astype(np.uint64)
    for c in range(CHUNKS):
        for gap in range(WIDTH):
            key = np.full(len(signatures), c * WIDTH + gap + 1, dtype=np.uint64)
            for i in range(WIDTH):
                if i != gap:
                    key = kernels.mix(key * np.uint64(31) + wide[:, c * WIDTH + i])
            out[:, c * WIDTH + gap] = (key << np.uint64(7)) | np.uint64(c * WIDTH + gap)
    return out


@kernels.releasing
def _keys(batches):
    for batch in batches:
        keys = bucket_keys(_matrix(batch.column("signature")))
        ids = batch.column("id").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, K))], ["key", "id"])


@kernels.releasing
def _close(batches):
    """Pairs whose signatures are near enough."""
    for batch in batches:
        if len(batch):
            near = (_matrix(batch.column("sa")) != _matrix(batch.column("sb"))).sum(axis=1) <= DISTANCE
            yield batch.select(["a", "b"]).filter(pa.array(near))


def _linked(x: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
    """Which of the sorted sets ys link with the sorted set x."""
    sizes = np.array([len(y) for y in ys], dtype=np.int64)
    flat = np.concatenate(ys)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    shared = np.add.reduceat((x[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * shared >= THRESHOLD * (sizes + len(x) - shared)


@kernels.releasing
def _confirm(batches):
    """Pairs that link on their full sets."""
    for batch in batches:
        a, b = batch.column("ha"), batch.column("hb")
        view = lambda column, i: np.frombuffer(column[i].as_buffer(), np.uint64)
        hit = [bool(_linked(view(a, i), [view(b, i)])[0]) for i in range(len(batch))]
        yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))


def _first_bucket(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The place of the first key that row i of x (or x, if it is one row) shares with row i of y; K if none."""
    differ = (y != x).reshape(len(y), CHUNKS, WIDTH)
    errors = differ.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    rows = np.arange(len(y))
    gap = np.where(errors[rows, chunk] == 0, 0, differ[rows, chunk].argmax(axis=1))
    return np.where(errors[rows, chunk] <= 1, chunk * WIDTH + gap, K)


#: Groups up to this size are compared for many groups at once.
SMALL = 16
_GROUP = ["key", "block_a", "block_b"]


def _whole_groups(batches):
    """Tables that hold whole groups, from batches in which a group's rows follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        last = [batch.column(c)[len(batch) - 1].as_py() for c in _GROUP]
        same = np.ones(len(batch), dtype=bool)
        for c, v in zip(_GROUP, last, strict=True):
            same &= batch.column(c).to_numpy() == v
        cut = len(batch) - int(same[::-1].argmin() if not same.all() else len(batch))
        before = bool(held) and [held[-1].column(c)[len(held[-1]) - 1].as_py() for c in _GROUP] != last
        if cut or before:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


@kernels.releasing
def _alive(batches):
    """The rows that have a near one of another component in their group, in the first bucket that both share."""
    for table in _whole_groups(batches):
        key, left, right, label, block = (table.column(c).to_numpy() for c in [*_GROUP, "label", "block"])
        signs = _matrix(table.column("signature").combine_chunks())
        n = len(key)
        new = np.ones(n, dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        alive = np.zeros(n, dtype=bool)
        meets = lambda i, j: (label[i] != label[j]) & ((left[i] == right[i]) | (block[i] != block[j]))  # noqa: B023, E731
        place = key & 127

        def near(i, j):
            some = np.flatnonzero((signs[i] != signs[j]).sum(axis=1) <= DISTANCE)  # noqa: B023
            i, j = i[some], j[some]
            return (i, j) if not len(i) else tuple(v[_first_bucket(signs[i], signs[j]) == place[i]] for v in (i, j))  # noqa: B023

        for step in range(1, min(SMALL, size.max() if n else 0)):
            i = np.flatnonzero((group[:-step] == group[step:]) & (size[group[:-step]] <= SMALL))
            i = i[meets(i, i + step)]
            for part in np.array_split(i, len(i) // 100_000 + 1):
                for v in near(part, part + step):
                    alive[v] = True
        for g in np.flatnonzero(size > SMALL):
            first = int(np.searchsorted(group, g))
            rows = np.arange(first, first + size[g])
            values, times = np.unique(label[rows], return_counts=True)
            large = values[times.argmax()]
            for i in rows[label[rows] != large]:
                others = rows[meets(np.full(len(rows), i), rows)]
                for v in near(np.full(len(others), i), others):
                    alive[v] = True
        if alive.any():
            yield from table.filter(pa.array(alive)).select([*_GROUP, "id", "label", "block"]).to_batches()


def _join_bucket(table: pa.Table) -> pa.Table:
    """Links that join components within one bucket, or between two blocks of one.  Each pair is compared in the first
    bucket it shares, and only while its ends are in different components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
    here, left, right = table.column("key")[0].as_py(), table.column("block_a")[0].as_py(), table.column("block_b")[0].as_py()
    order = np.argsort(ids, kind="stable")
    table = table.take(pa.array(order))
    ids, labels, blocks = ids[order], labels[order], table.column("block").to_numpy()
    signs = _matrix(table.column("signature").combine_chunks())
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
    root = {int(x): int(x) for x in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    number = here & 127
    found = []
    sizes = np.unique(labels, return_counts=True)
    large = sizes[0][sizes[1].argmax()]
    for i in range(len(ids)):
        if labels[i] == large:
            continue  # the others are compared with it
        later = np.arange(len(ids)) > i
        others = np.flatnonzero((later | (labels == large)) & (labels != labels[i]))
        if left != right:
            others = others[blocks[others] != blocks[i]]
        if not len(others):
            continue
        distance = (signs[others] != signs[i]).sum(axis=1)
        near = distance <= DISTANCE
        others, distance = others[near], distance[near]
        mine = _first_bucket(signs[i], signs[others]) == number
        others = others[mine][np.argsort(distance[mine], kind="stable")]
        at, step = 0, 8
        while at < len(others):
            some = [j for j in others[at : at + step] if find(int(labels[j])) != find(int(labels[i]))]
            at, step = at + step, step * 2
            if some:
                for j, hit in zip(some, _linked(sets[i], [sets[j] for j in some]), strict=True):
                    if hit and find(int(labels[j])) != find(int(labels[i])):
                        root[find(int(labels[j]))] = find(int(labels[i]))
                        found.append((int(ids[i]), int(ids[j])))
    return pa.table([[a for a, _ in found], [b for _, b in found]], schema=schema)


def sketches(docs: DataFrame) -> DataFrame:
    """One row for each row of (doc_id, text): the size of its shingle set, 128 bits that tell sets apart, its signature."""
    return docs.mapInArrow(_sketch, _SKETCH)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document."""
    docs = id_text(docs).filter("doc_id is not null")
    if repeats(docs):
        docs = stage(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "documents-once")
    sketched = stage(sketches(docs), "sketches")
    digest = ["n_shingles", "d1", "d2"]
    full = sketched.filter("n_shingles > 0")
    classes = stage(full.groupBy(*digest).agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "classes")
    keys = classes.select("id", "signature").mapInArrow(_keys, "key long, id long")
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last").select("key", "hub")
    members = stage(keys.join(hubs, "key"), "members")

    # The sets of all that share a bucket, made once.
    wanted = stage(members.select("id").distinct(), "wanted")
    texts = docs.withColumnRenamed("doc_id", "id").join(sent_if_small(wanted), "id")
    sets = stage(texts.mapInArrow(_sets, "id long, hashes binary"), "sets", compression="none")
    held = classes.select("id", "signature", "n_shingles")

    pairs = members.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    side = lambda c, s: held.select(F.col("id").alias(c), F.col("signature").alias(s))
    near = stage(pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").mapInArrow(_close, "a long, b long"), "pairs")
    links = stage(_confirmed(near, sets), "star-links")
    labels = components(links)

    labelled = members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    sized = labelled.join(held.select("id", "n_shingles"), "id")
    mixed = sized.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n_shingles").alias("total"), F.count("*").alias("n")).filter("low < high")
    n_blocks = F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("n") / BLOCK_MEMBERS)).cast("int")
    mixed = stage(mixed.select("key", n_blocks.alias("n_blocks")), "mixed")
    rest = labelled.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    # A member meets each block of its bucket once, its own included.
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda o: F.struct(F.least("block", o).alias("block_a"), F.greatest("block", o).alias("block_b"))))
    rest = rest.select("key", "id", "label", "block", meet.alias("m")).select("key", "id", "label", "block", "m.block_a", "m.block_b")
    rest = rest.join(held.select("id", "signature"), "id").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    rest = stage(rest.mapInArrow(_alive, "key long, block_a int, block_b int, id long, label long, block int"), "alive")
    rest = rest.join(held.select("id", "signature"), "id").join(sets, "id")
    more = rest.groupBy("key", "block_a", "block_b").applyInArrow(_join_bucket, "a long, b long")
    labels = components(links.unionByName(stage(more, "bucket-links")))

    rows = sketched.select("doc_id", *digest)
    whole = classes.select(*digest, "id").join(labels, "id", "left").select(*digest, F.coalesce("label", "id").alias("component_id"))
    out = rows.join(stage(whole, "class-labels"), digest, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda c, h: sets.select(F.col("id").alias(c), F.col("hashes").alias(h))
    return pairs.join(side("a", "ha"), "a").join(side("b", "hb"), "b").mapInArrow(_confirm, "a long, b long")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, one for each group of near copies, all columns as they were.

    What goes is mostly far less than what stays, so the ids that go are joined, and sent if they are few."""
    gone = stage(near_duplicates(docs).filter(~F.col("kept")).select("doc_id"), "near-copies")
    kept = docs.filter("doc_id is not null").join(sent_if_small(gone), "doc_id", "left_anti").select(docs.columns)
    if repeats(docs.filter("doc_id is not null")):
        first = Window.partitionBy("doc_id").orderBy(F.coalesce("text", F.lit("")))
        kept = kept.withColumn("__fathomline_nth", F.row_number().over(first)).filter("__fathomline_nth = 1").drop("__fathomline_nth")
    return kept


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
