"""Sharding by vector bin packing.

Documents with equal texts form a group, and a group's load is a vector: bytes, tokens and rows.  Groups go to shards
largest first (by their largest dimension, then by bytes), each to the shard whose residual capacity has the greatest dot product with the load, both as fractions of a
shard's fair share; a shard that a group would take over its share in bytes is passed over while others have room.

The driver places a bounded number of load vectors, whatever the input.  Groups that hold more than 1 / HEAVY of a shard's
share in some dimension are placed one by one (fewer than 3 * HEAVY * shards can exist).  All others are in classes of nearly
equal vectors, 8 to an octave of bytes and 4 to one of tokens and of rows, of which some thousands can exist: a class's groups
go out a handful at a time, each handful by the dot product of its own vector, and the groups take these places by their rank
in the class.  The lightest classes, about 1 / TAIL of all bytes, are held back until the others' real sums are known, and
even them out.  A group larger than a shard's share can't be in one shard with sizes near equal, so it is cut by doc_id into
parts of at most 1 / CUT of a share; it is the only kind of group that several shards hold.

The law is `bytes`: shards' sizes are near equal.  A null text has size 1 and no tokens and is a group apart from the
empty text's.  Repeated rows are rows like any other and each get a slot; a null doc_id is ordered first; ties are settled by
the texts' hashes.  Other columns are ignored.  An empty table has no rows.  A long text is only measured and hashed, in its
own row; Spark's limit of 2 GB a value bounds it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, stage

SHARDS = 16
HEAVY = 256
CUT = 64
TAIL = 32
#: A class goes out in at most about this many handfuls for each shard.
HANDFULS = 8
DIMENSIONS = ("size", "n_tokens", "n_rows")
#: Ranks and slots are counted within this many lanes of each class and shard, so no task sorts a whole one.
LANES = 64


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    known = F.coalesce(text, F.lit(""))
    # Two hashes of the text, and whether there is one, name its group.
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(known) + 1).cast("long").alias("size"),
        F.crc32(F.encode(known, "UTF-8")).alias("text_crc32"),
        F.regexp_count(known, F.lit(f"[^{SPACE[1:]}+")).cast("long").alias("n_tokens"),
        F.xxhash64(text.isNull(), known).alias("g1"),
        F.conv(F.substring(F.md5(F.concat(known, text.isNull().cast("string"))), 1, 15), 16, 10).cast("long").alias("g2"),
    )


def _class() -> Column:
    """A number for each class of nearly equal loads."""
    step = lambda c, n: F.floor(n * F.log2(F.col(c) + 1)).cast("long")
    return step("size", 8) * 1_000_000 + step("n_tokens", 4) * 1000 + step("n_rows", 4)


class Bins:
    """The shards' residual capacities; loads are fractions of a shard's fair share, bytes first."""

    def __init__(self, shards: int):
        self.residual = np.ones((shards, len(DIMENSIONS)))

    def put(self, load: np.ndarray, n: int = 1) -> list[tuple[int, int]]:
        """(shard, how many) for n items of one load, in the order in which they go out."""
        out: list[tuple[int, int]] = []
        handful = max(1, -(-n // (HANDFULS * len(self.residual))))
        while n:
            room = self.residual[:, 0]
            fits = room + 1e-12 >= load[0]
            score = np.where(fits, self.residual @ load if load.any() else self.residual.sum(axis=1), -np.inf) if fits.any() else room
            best = int(score.argmax())
            k = min(n, handful)
            if fits.any() and load[0] > 0:
                k = max(1, min(k, int(room[best] / load[0])))
            self.residual[best] -= k * load
            out.append((best, k))
            n -= k
        return out


def _rank_of(load: np.ndarray) -> tuple[float, float]:
    """Largest first: by the largest dimension, then by bytes."""
    return -float(load.max()), -float(load[0])


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item.  loads: items x dimensions, as fractions of a shard's fair share."""
    bins = Bins(shards)
    out = np.zeros(len(loads), dtype=np.int64)
    for i in sorted(range(len(loads)), key=lambda i: (*_rank_of(loads[i]), i)):
        out[i] = bins.put(loads[i])[0][0]
    return out


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), parts).cast("int")


def _items(rows: DataFrame, marked: DataFrame) -> tuple[list, list]:
    """Names (g1, g2, n_parts, part) and loads of heavy groups, or of their parts if they are beyond a share."""
    heavy = marked.filter(F.col("most") > 1 / HEAVY).collect()
    names = [(r["g1"], r["g2"], 1, 0) for r in heavy if r["most"] <= 1]
    loads = [[r[c] for c in DIMENSIONS] for r in heavy if r["most"] <= 1]
    cut = [(r["g1"], r["g2"], int(np.ceil(r["most"] * CUT))) for r in heavy if r["most"] > 1]
    if cut:
        # At most CUT parts for each share, so CUT * shards in each dimension.
        named = F.broadcast(rows.sparkSession.createDataFrame(cut, "g1 long, g2 long, n_parts int"))
        parts = rows.join(named, ["g1", "g2"]).groupBy("g1", "g2", "n_parts", _part(F.col("n_parts")).alias("part"))
        for r in parts.agg(*(F.sum(c).alias(c) for c in DIMENSIONS[:2]), F.count("*").alias("n_rows")).collect():
            names.append((r["g1"], r["g2"], r["n_parts"], r["part"]))
            loads.append([r[c] for c in DIMENSIONS])
    return names, loads


def _ranked(light: DataFrame) -> DataFrame:
    """Adds `rank`, from 0 in each class."""
    laned = light.withColumn("lane", F.pmod("g2", F.lit(LANES)).cast("int"))
    before, first = {}, []
    for r in sorted(laned.groupBy("class", "lane").count().collect()):
        first.append((r["class"], r["lane"], before.get(r["class"], 0)))
        before[r["class"]] = before.get(r["class"], 0) + r["count"]
    starts = F.broadcast(light.sparkSession.createDataFrame(first, "class long, lane int, before long"))  # classes * LANES rows
    order = Window.partitionBy("class", "lane").orderBy("g1", "g2")
    ranked = laned.withColumn("n", F.row_number().over(order)).join(starts, ["class", "lane"])
    return ranked.withColumn("rank", F.col("n") - 1 + F.col("before")).drop("n", "before", "lane")


def _assigned(ranked: DataFrame, runs: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """ranked groups of the classes in runs, with their shard."""
    told = []
    for name, given in runs.items():
        ends = np.cumsum([n for _, n in given]).tolist()
        told.append((name, ends, [s for s, _ in given]))
    spread = F.broadcast(ranked.sparkSession.createDataFrame(told, "class long, ends array<long>, shards array<int>"))  # a row for each class
    place_of = F.get("shards", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    return ranked.join(spread, "class").select("g1", "g2", *DIMENSIONS, place_of.alias("shard"))


def shard_groups(rows: DataFrame, groups: DataFrame, shards: int) -> tuple[list, DataFrame]:
    """(g1, g2, n_parts, part, shard) of heavy groups, and a table (g1, g2, shard) of all others."""
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMENSIONS)).first()
    share = np.array([max(total[c] / shards, 1e-9) for c in DIMENSIONS])
    most = F.greatest(*(F.col(c) / F.lit(float(x)) for c, x in zip(DIMENSIONS, share, strict=True)))
    marked = groups.withColumn("most", most)
    names, loads = _items(rows, marked)
    light = marked.filter(F.col("most") <= 1 / HEAVY).withColumn("class", _class())
    ranked = stage(_ranked(light), "shard-ranked")
    classes = ranked.groupBy("class").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in DIMENSIONS)).collect()
    classes = sorted(((r["class"], r["n"], np.array([r[c] for c in DIMENSIONS]) / share) for r in classes), key=lambda c: (*_rank_of(c[2] / c[1]), c[0]))
    tail, held = len(classes), 0.0
    while tail and held < sum(c[2][0] for c in classes) / TAIL:
        tail -= 1
        held += classes[tail][2][0]
    bins = Bins(shards)
    # Heavy groups and the first classes, the largest first.
    todo = [(_rank_of(load), 0, i) for i, load in enumerate(np.array(loads).reshape(-1, len(DIMENSIONS)) / share)]
    todo += [(_rank_of(load / n), 1, i) for i, (_, n, load) in enumerate(classes[:tail])]
    heavy, runs = [], {}
    for _, kind, i in sorted(todo, key=lambda t: (t[0], t[1], (names[t[2]] if t[1] == 0 else (classes[t[2]][0],)))):
        if kind == 0:
            heavy.append((*names[i], bins.put(np.array(loads[i]) / share)[0][0]))
        else:
            name, n, load = classes[i]
            runs[name] = bins.put(load / n, n)
    first = stage(_assigned(ranked, runs), "shard-places")
    # The real sums in place of those of equal groups in each class.
    bins = Bins(shards)
    for (*_, shard), name in zip(heavy, [h[:4] for h in heavy], strict=True):
        bins.residual[shard] -= np.array(loads[names.index(name)]) / share
    for r in first.groupBy("shard").agg(*(F.sum(c).alias(c) for c in DIMENSIONS)).collect():
        bins.residual[r["shard"]] -= np.array([r[c] for c in DIMENSIONS]) / share
    last = {name: bins.put(load / n, n) for name, n, load in classes[tail:]}
    return heavy, first.unionByName(_assigned(ranked, last)).select("g1", "g2", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, n_tokens, law, shard, slot and grown_shard, one row for each row of docs."""
    spark = docs.sparkSession
    rows = stage(_measured(docs, id_col, text_col), "shard-rows")
    groups = stage(rows.groupBy("g1", "g2").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")), "shard-groups")
    made, places = shard_groups(rows, groups, shards)
    # At most 3 * HEAVY * shards groups, or 3 * CUT * (shards + 1) parts beyond that: a bounded table, so it is sent.
    heavy = spark.createDataFrame(made, "g1 long, g2 long, n_parts int, part int, shard int")
    whole = heavy.select("g1", "g2", "n_parts").distinct()
    marked = rows.join(F.broadcast(whole), ["g1", "g2"], "left")
    parts = marked.filter("n_parts is not null").withColumn("part", _part(F.col("n_parts"))).drop("n_parts")
    placed = parts.join(F.broadcast(heavy.drop("n_parts")), ["g1", "g2", "part"]).drop("part")
    # What is left has no group of more than 1 / HEAVY of a share.
    light = marked.filter("n_parts is null").drop("n_parts").join(places, ["g1", "g2"])
    return number_slots(placed.unionByName(light)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens"
    )


def number_slots(rows: DataFrame) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard: lanes in order, and doc_ids in order within a lane."""
    spark = rows.sparkSession
    laned = rows.withColumn("lane", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(LANES)).cast("int"))
    laned = stage(laned, "shard-lanes")
    counts = laned.groupBy("shard", "lane").count().collect()
    before, first = {}, []
    for r in sorted(counts, key=lambda r: (r["shard"], r["lane"])):
        first.append((r["shard"], r["lane"], before.get(r["shard"], 0)))
        before[r["shard"]] = before.get(r["shard"], 0) + r["count"]
    starts = F.broadcast(spark.createDataFrame(first, "shard int, lane int, before long"))  # shards * LANES rows
    order = Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32")
    return laned.withColumn("n", F.row_number().over(order)).join(starts, ["shard", "lane"]).withColumn("slot", (F.col("n") - 1 + F.col("before")).cast("long"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
