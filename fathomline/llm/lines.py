r"""Line deduplication that can be undone.

A line's key is the line without white space at both ends, A-Z lower-cased; keys under ten code points never count.  The
exact side is two tables: postings (key, doc_id), and for each key its reference count, the documents that hold it, with the
smallest of them.  A key of two documents or more loses its lines in all but the smallest doc_id.

A sharded cuckoo filter holds the shared keys, those with a count of two or more.  Before postings are joined to the exact
counts, each is dealt to its key's shard, where the shard's filter, which one task at a time loads, drops what is certainly
not shared.  It is the same at every size: a filter holds about SHARD_KEYS keys, and LANES tasks share a shard, so a key that
a third of all documents hold isn't one task's.  A false positive costs a lookup, never a line.

Documents are inserted and deleted by their keys alone: counts of keys that they hold go up or down, keys that come to be
shared are inserted into their shard's filter and keys that are no longer shared deleted from it, and counts and filters of
all other keys stay as they are.  The next `apply` brings back lines whose other holders are gone.

Keys are 128-bit hashes.  Null or empty texts are one empty line.  Rows of one doc_id that repeat are one document for
the counts, and each row gets its own output.  Rows without a doc_id keep all lines.  Other columns are left alone.  An
empty table has no postings and no output.  A long text is read in slices of whole rows, so it takes memory in proportion to
itself; Arrow's offsets bound a batch at 2 GB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import documents, id_text, repeats, stage
from .cuckoo import CuckooFilter

LEAST_POINTS = 10
#: Keys of a shard, about, and how many tasks may share the postings of one.
SHARD_KEYS, LANES = 1 << 16, 16
KEY = ["k1", "k2"]
_POSTINGS = "k1 long, k2 long, doc_id long"


@kernels.releasing
def _postings(batches):
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for row, data, offsets in kernels.slices(batch.column("text")):
            _, _, starts, ends, counts = kernels.lines(data, offsets)
            one, two, points = kernels.line_keys(data, starts, ends)
            owner = np.repeat(np.arange(len(counts)), counts)
            keep = np.flatnonzero(points >= LEAST_POINTS)
            order = keep[np.lexsort((two[keep], one[keep], owner[keep]))]
            one, two, owner = one[order], two[order], owner[order]
            new = np.ones(len(one), dtype=bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64)), pa.array(ids[row + owner[new]])], KEY + ["doc_id"])


def postings(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id): each key that counts, once for each row that has it."""
    return id_text(docs).filter("doc_id is not null").mapInArrow(_postings, _POSTINGS)


def _once(docs: DataFrame) -> DataFrame:
    """The postings of docs, once for each document: only rows that share their doc_id can repeat one."""
    out = postings(docs)
    return out.distinct() if repeats(docs.filter("doc_id is not null")) else out


def counts(postings: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, first_doc): the reference count of each key and its smallest document."""
    return postings.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def _shards(n_keys: int) -> int:
    n = 1
    while n * SHARD_KEYS < n_keys:
        n *= 2
    return n


def _shard(n_shards: int) -> Column:
    return F.pmod("k1", F.lit(n_shards)).cast("int")


_FILTERS = "shard int, filter binary"


def changed_filters(filters: DataFrame, changes: DataFrame, shared: DataFrame, n_shards: int) -> DataFrame:
    """filters after changes (k1, gain): keys that come to be shared (gain 1) or no longer are (-1), by insertion and
    deletion.  A filter that is full, or not there yet, is made of all its shard's keys in shared."""
    dealt = changes.select(_shard(n_shards).alias("shard"), "k1", "gain")

    def update(old: pa.Table, new: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int32()), ("filter", pa.binary())])
        if not old.num_rows or not new.num_rows:
            return old.cast(schema) if old.num_rows else pa.table({"shard": [new.column("shard")[0].as_py()], "filter": pa.array([None], pa.binary())}, schema=schema)
        held = CuckooFilter.from_bytes(old.column("filter")[0].as_py())
        keys, gain = new.column("k1").to_numpy().view(np.uint64), new.column("gain").to_numpy()
        held.delete(keys[gain < 0])
        full = not held.insert(keys[gain > 0])
        return pa.table({"shard": [old.column("shard")[0].as_py()], "filter": pa.array([None if full else held.to_bytes()], pa.binary())}, schema=schema)

    done = stage(filters.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(update, _FILTERS), "line-filters")
    full = done.filter("filter is null").select("shard")
    anew = built_filters(shared.withColumn("shard", _shard(n_shards)).join(full, "shard"))
    return stage(done.filter("filter is not null").unionByName(anew), "line-filters")


def built_filters(keys: DataFrame) -> DataFrame:
    """(shard, filter): a cuckoo filter of the k1 of each shard's keys (shard, k1), about SHARD_KEYS of them."""

    def of(table: pa.Table) -> pa.Table:
        keys = table.column("k1").to_numpy().view(np.uint64)
        return pa.table({"shard": [table.column("shard")[0].as_py()], "filter": pa.array([CuckooFilter.of(keys).to_bytes()], pa.binary())}, schema=pa.schema([("shard", pa.int32()), ("filter", pa.binary())]))

    return keys.select("shard", "k1").groupBy("shard").applyInArrow(of, _FILTERS)


def _probe(batches):
    """Rows in order of shard and lane, the filter of a shard before its postings: the postings that it may hold."""
    held = None
    for batch in batches:
        shards, lanes = batch.column("shard").to_numpy(), batch.column("lane").to_numpy()
        new = np.ones(len(batch), dtype=bool)
        new[1:] = (shards[1:] != shards[:-1]) | (lanes[1:] != lanes[:-1])
        starts = np.flatnonzero(new).tolist()
        hit = np.zeros(len(batch), dtype=bool)
        filters = batch.column("filter")
        valid = filters.is_valid().to_numpy(zero_copy_only=False)
        keys = batch.column("k1").fill_null(0).to_numpy().view(np.uint64)
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            if held is None or held[:2] != (shards[a], lanes[a]):
                held = (shards[a], lanes[a], None)
            if valid[a]:
                held = (shards[a], lanes[a], CuckooFilter.from_bytes(filters[a].as_py()))
                a += 1
            if held[2] is not None and a < b:
                hit[a:b] = held[2].contains(keys[a:b])
        yield batch.select([*KEY, "doc_id"]).filter(pa.array(hit))


def probe(postings: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """Postings whose key their shard's filter may hold.  A task streams them past one filter at a time."""
    lane = F.pmod(F.xxhash64("doc_id"), F.lit(LANES)).cast("int")
    none = F.lit(None).cast("binary")
    rows = postings.select(_shard(n_shards).alias("shard"), lane.alias("lane"), none.alias("filter"), *KEY, "doc_id")
    each = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"), "filter")
    both = rows.unionByName(each, allowMissingColumns=True).repartition("shard", "lane").sortWithinPartitions("shard", "lane", F.col("k1").asc_nulls_first())
    return both.mapInArrow(_probe, _POSTINGS)


_LINES, _WORDS = ("n_lines", "n_dropped"), ("n_words", "n_left")


def _rewritten(batches, words: bool):
    """Adds the kept text, how many lines there are and how many go, and, if asked, how many words there are and are left.  A
    line goes if both halves of its key are among the document's."""
    for batch in batches:
        texts, one_of, two_of = batch.column("text"), batch.column("one"), batch.column("two")
        n_lines, n_dropped, n_words, n_left, kept = [], [], [], [], []
        for row, data, offsets in kernels.slices(texts):
            rows = len(offsets) - 1
            starts, ends, inner, outer, counts = kernels.lines(data, offsets)
            border = np.concatenate([[0], np.cumsum(counts)])
            hit = np.zeros(len(starts), dtype=bool)
            if one_of.slice(row, rows).null_count < rows:
                one, two, points = kernels.line_keys(data, inner, outer)
                for i in range(rows):
                    if one_of[row + i].is_valid:
                        at = slice(border[i], border[i + 1])
                        hit[at] = (points[at] >= LEAST_POINTS) & np.isin(one[at].view(np.int64), one_of[row + i].values.to_numpy()) & np.isin(two[at].view(np.int64), two_of[row + i].values.to_numpy())
            raw = data.tobytes()
            for i in range(rows):
                a, b = border[i], border[i + 1]
                gone = int(hit[a:b].sum())
                n_lines.append(int(b - a))
                n_dropped.append(gone)
                whole = raw[offsets[i] : offsets[i + 1]]
                kept.append(b"\n".join(raw[starts[j] : ends[j]] for j in range(a, b) if not hit[j]) if gone else whole)
            if words:
                begun = kernels.words(data, offsets)[0]
                each = np.searchsorted(begun, ends) - np.searchsorted(begun, starts)
                owner = np.repeat(np.arange(rows), counts)
                n_words.extend(np.bincount(owner, each, rows).astype(np.int64).tolist())
                n_left.extend(np.bincount(owner, each * ~hit, rows).astype(np.int64).tolist())
        rest = [c for c in batch.schema.names if c not in ("one", "two", "text")]
        counted = [pa.array(c, pa.int64()) for c in (n_lines, n_dropped, n_words, n_left)[: 4 if words else 2]]
        names = [*rest, "text", *_LINES, *(_WORDS if words else ())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(kept, pa.binary()).cast(pa.string()), *counted], names)


@kernels.releasing
def _kept(batches):
    return _rewritten(batches, False)


@kernels.releasing
def _kept_and_words(batches):
    """With words counted here: matches of all of them would be an array in the JVM's heap."""
    return _rewritten(batches, True)


class LineIndex:
    """Postings, counts and filters, as tables.  Each change gives a new index; the old one stays as it was."""

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame, n_shards: int):
        self.postings, self.counts, self.filters, self.n_shards = postings, counts, filters, n_shards

    @classmethod
    def build(cls, docs: DataFrame) -> LineIndex:
        held = stage(_once(docs), "line-postings")
        counted = stage(counts(held), "line-counts")
        shared = counted.filter("n_docs > 1")
        n_shards = _shards(shared.count())
        filters = stage(built_filters(shared.withColumn("shard", _shard(n_shards))), "line-filters")
        return cls(held, counted, filters, n_shards)

    def _with(self, postings: DataFrame, old: DataFrame, new: DataFrame) -> LineIndex:
        """With the counts of the touched keys as in new in place of old, and only their shards' filters changed."""
        rest = self.counts.join(old.select(*KEY), KEY, "left_anti")
        counted = stage(rest.unionByName(new.filter("n_docs > 0")), "line-counts")
        was, now = F.coalesce(F.col("was") > 1, F.lit(False)), F.col("n_docs") > 1
        both = new.join(old.select(*KEY, F.col("n_docs").alias("was")), KEY, "left")
        changes = both.filter(was != now).select("k1", F.when(now, 1).otherwise(-1).alias("gain"))
        return LineIndex(postings, counted, changed_filters(self.filters, changes, counted.filter("n_docs > 1"), self.n_shards), self.n_shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Also counts the lines of docs, whose doc_ids are new."""
        more = stage(_once(docs), "line-postings")
        gained = stage(counts(more), "line-touched")
        old = stage(self.counts.join(gained.select(*KEY), KEY, "left_semi"), "line-old")
        known = old.select(*KEY, F.col("n_docs").alias("was"), F.col("first_doc").alias("first"))
        total = (F.col("n_docs") + F.coalesce("was", F.lit(0))).alias("n_docs")
        new = gained.join(known, KEY, "left").select(*KEY, total, F.least("first_doc", "first").alias("first_doc"))
        return self._with(self.postings.unionByName(more), old, stage(new, "line-new"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents named in the column doc_id."""
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        gone = stage(self.postings.join(ids, "doc_id").select(*KEY, "doc_id"), "line-touched")
        held = stage(self.postings.join(ids, "doc_id", "left_anti").select(*KEY, "doc_id"), "line-postings")
        lost = gone.groupBy(*KEY).agg(F.count("*").alias("lost"), F.min("doc_id").alias("least"))
        old = stage(self.counts.join(lost, KEY), "line-old")
        # A key whose smallest document goes finds the next among its own postings.
        left = old.filter("n_docs > lost and first_doc = least").select(*KEY)
        after = held.join(left, KEY, "left_semi").groupBy(*KEY).agg(F.min("doc_id").alias("after"))
        new = old.join(after, KEY, "left").select(*KEY, (F.col("n_docs") - F.col("lost")).alias("n_docs"), F.coalesce("after", "first_doc").alias("first_doc"))
        return self._with(held, old, stage(new, "line-new"))

    def drops(self) -> DataFrame:
        """(doc_id, one, two): what each document loses, the halves of its keys."""
        shared = self.counts.filter("n_docs > 1").select(*KEY, "first_doc")
        lost = probe(self.postings, self.filters, self.n_shards).join(shared, KEY).filter("doc_id <> first_doc")
        return lost.groupBy("doc_id").agg(F.collect_set("k1").alias("one"), F.collect_set("k2").alias("two"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """doc_id, the kept text, n_lines before and n_dropped, a row for each row of docs, which the index holds."""
        df = id_text(docs).join(self.drops(), "doc_id", "left")
        return df.mapInArrow(_kept, "doc_id long, text string, n_lines long, n_dropped long")

    def replace_text(self, docs: DataFrame, least_words: int = 0, least_share: float = 0.0) -> DataFrame:
        """docs, all columns in their order, with the kept lines as text, and n_chars (if it is there) as its code points.

        Documents that lose lines go altogether if fewer than least_words words, or than least_share of all their words, are
        left: what is left of a copy is no document."""
        lost = self.drops().select(F.col("doc_id").alias("_doc"), "one", "two")
        rest = [c for c in docs.columns if c != "text"]
        marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
        marked = marked.join(lost, F.col("_id") == F.col("_doc"), "left").select("_row", "text", "one", "two")
        schema = marked.select("_row", "text").schema
        for c in _LINES + _WORDS:
            schema = schema.add(c, "long")
        out = marked.mapInArrow(_kept_and_words, schema)
        if least_words or least_share:
            out = out.filter((F.col("n_dropped") == 0) | (F.col("n_left") >= F.greatest(F.lit(float(least_words)), F.lit(least_share) * F.col("n_words"))))
        columns = {c: F.col("_row").getField(c) for c in rest} | {"text": F.col("text")}
        if "n_chars" in columns:
            columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
        return out.select(*(columns[c].alias(c) for c in docs.columns))


def dedup_documents(docs: DataFrame, least_words: int = 0, least_share: float = 0.0) -> DataFrame:
    """docs with the same columns and shorter texts, without what is left of copies, as replace_text() says."""
    return LineIndex.build(docs).replace_text(docs, least_words, least_share)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return LineIndex.build(docs).apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), k AS (
  SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT l.doc_id, i, line, coalesce(k.first_doc <> l.doc_id, FALSE) AS dropped FROM l LEFT JOIN k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN dropped THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
