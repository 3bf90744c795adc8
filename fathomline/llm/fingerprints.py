"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every hash of a five-word shingle that is below a fixed fraction 1 / SCALE of the hash range, at every size.
Two sketches, whatever the sizes of their documents, are random samples of the same fraction, so they merge by union and
estimate likeness (Jaccard) and containment.  It also names the smallest hash of all.  Where two documents are so short that
neither keeps any hash, likeness is whether their smallest are equal, which is as likely as they are alike.

A document's fingerprint is the sketch as text: the smallest hash and those kept, in order, in hexadecimal.  Equal texts have
equal fingerprints.  A text of one to four words is one shingle; one without words has none, the fingerprint "-", and
likeness 1 to another such text and 0 to any other.

All of it is DataFrame expressions.  The next document comes from a window over ranges of doc_id: each range also gets
a copy of the first row of the range after it, so no task sees more than a range.  One sort of the texts is the only
shuffle of them, and sketches are made behind it, once for each row.  A null text is an empty one.  Repeated doc_ids follow
each other in the order of their texts, which also settles ties; null doc_ids come first.  Other columns are ignored.  An
empty table has no fingerprints.  A text is sketched in its own task, in memory in proportion to its words; Spark's limit of
2 GB a value bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, id_text

SHINGLE = 5
SCALE = 2
#: Hashes are 60 bits.
RANGE = 1 << 60
LIMIT = RANGE // SCALE
#: Rows of a range of doc_ids, and how many ranges there are at most: their first ids are literals of the plan.
RANGE_ROWS, MOST_RANGES = 2_000, 10_000


def sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: struct(least, hashes) of the text column."""
    words, made = f"_{out}_words", f"_{out}_hashes"
    df = df.withColumn(words, F.filter(F.split(F.lower(F.col(text)), f"{SPACE}+"), lambda w: w != ""))
    n = F.size(words)
    get = lambda i, k: F.get(F.col(words), i + k)
    many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.shiftrightunsigned(F.xxhash64(*(get(i, k) for k in range(SHINGLE))), 4))
    few = F.array(F.shiftrightunsigned(F.xxhash64(F.col(words)), 4))
    df = df.withColumn(made, F.when(n >= SHINGLE, many).when(n > 0, few).otherwise(F.array().cast("array<long>")))
    kept = F.sort_array(F.array_distinct(F.filter(made, lambda h: h < LIMIT)))
    return df.withColumn(out, F.struct(F.array_min(made).alias("least"), kept.alias("hashes"))).drop(words, made)


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of the shingle sets of two sketches."""
    union = F.size(F.array_union(a["hashes"], b["hashes"]))
    return F.when(union == 0, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(F.size(F.array_intersect(a["hashes"], b["hashes"])) / union)


def containment(a: Column, b: Column) -> Column:
    """The estimated part of a's shingles that b has too, for documents of any two sizes; 1 if a has none."""
    none = (a["least"].isNull() | a["least"].eqNullSafe(b["least"])).cast("double")
    return F.when(F.size(a["hashes"]) == 0, none).otherwise(F.size(F.array_intersect(a["hashes"], b["hashes"])) / F.size(a["hashes"]))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents' shingles together."""
    return F.struct(F.least(a["least"], b["least"]).alias("least"), F.sort_array(F.array_union(a["hashes"], b["hashes"])).alias("hashes"))


def as_text(s: Column) -> Column:
    spelled = lambda h: F.lpad(F.lower(F.hex(h)), 15, "0")
    return F.when(s["least"].isNull(), F.lit("-")).otherwise(F.concat(spelled(s["least"]), F.lit(":"), F.array_join(F.transform(s["hashes"], spelled), "")))


def _order() -> tuple[Column, ...]:
    """Of the rows of a range; its ghost comes last."""
    return F.col("_ghost"), F.col("doc_id").asc_nulls_first(), F.col("text")


def ranged(df: DataFrame) -> DataFrame:
    """df (doc_id, text) dealt by ranges of doc_id and sorted within them, each with the first row of the next one as its
    ghost (the last range: the first row of all)."""
    size = df.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    ranges = min(MOST_RANGES, max(1, size["n"] // RANGE_ROWS), max(1, size["known"]))
    cuts: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(df.agg(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0]))
    marked = df.withColumn("_range", _bucket(F.col("doc_id"), cuts).cast("int"))
    both = marked.withColumn("_ghost", F.lit(False)).unionByName(_heads(marked))
    return both.repartition("_range").sortWithinPartitions("_range", *_order())


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as ranged() gives them, without the ghosts, with next_<column>: the column in the row after it."""
    window = Window.partitionBy("_range").orderBy(*_order())
    led = rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns})
    return led.filter("not _ghost").drop("_ghost", "_range")


def _bucket(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the value, by a balanced tree of comparisons; 0 for null."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(cuts[middle]).cast("long"), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(cuts))


def _heads(df: DataFrame) -> DataFrame:
    """The first row of each range, marked as a ghost in the range before it that has rows (before the first: the last).

    They are found by doc_id alone, and only their texts are then fetched: a row for each range."""
    first = df.groupBy("_range").agg(F.min("doc_id").alias("id"), F.count_if(F.col("doc_id").isNull()).alias("n")).collect()
    present = sorted(r["_range"] for r in first)
    rows = [(None if r["n"] else r["id"], present[i - 1]) for i, r in enumerate(sorted(first, key=lambda r: r["_range"]))]
    wanted = F.broadcast(df.sparkSession.createDataFrame(rows, "_first long, _before int"))
    heads = df.join(wanted, F.col("doc_id").eqNullSafe(F.col("_first")))
    # Of rows that share the first doc_id, the one with the smallest text comes first.
    one = heads.groupBy("doc_id", "_before").agg(F.min("text").alias("text"))
    return one.select("doc_id", "text", F.col("_before").alias("_range"), F.lit(True).alias("_ghost")).select(*df.columns, "_ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, with the sketches of its text, of the edited text and of the next text as structs."""
    df = with_next(sketch(ranged(id_text(docs)), "text", "own"), ["text", "own"]).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    return sketch(df.withColumn("edited", edited), "edited", "changed").withColumnRenamed("next_own", "following")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fingerprints(documents(spark, sf_dir))
    own, changed, following = F.col("own"), F.col("changed"), F.col("following")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        containment(own, changed).alias("held_by_edited"),
    )
