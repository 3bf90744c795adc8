"""Cutting texts into overlapping chunks, and snippets into paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, let
from ..functions.text import clean, clock, strip

SIZE, OVERLAP = 1200, 150


def chunk_array(text: Column | str, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks of a text.

    Paragraphs, parted by blank lines, are packed up to `size`; longer ones are sliced at steps of size - overlap.  Every
    chunk but the first begins with the last `overlap` characters of the one before it, as that was without its own.
    """
    step = max(1, size - overlap)
    paragraphs = F.filter(F.transform(F.split(strip(F.coalesce(col(text), F.lit(""))), r"(?U)\n\s*\n"), strip), lambda p: p != "")
    flushed = lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"])))
    slices = lambda p: F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(step)), lambda i: F.substr(p, i + 1, F.lit(size)))
    state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))

    def add(s: Column, p: Column) -> Column:
        joined = F.length(s["cur"]) + F.length(p) + 2 <= size
        return (
            F.when(F.length(p) > size, state(F.concat(flushed(s), slices(p)), F.lit("")))
            .when((s["cur"] != "") & joined, state(s["done"], F.concat(s["cur"], F.lit("\n\n"), p)))
            .otherwise(state(flushed(s), p))
        )

    chunks = F.aggregate(paragraphs, state(F.array().cast("array<string>"), F.lit("")), add, flushed)
    if overlap <= 0:
        return chunks
    tail = lambda c: F.substr(c, F.greatest(F.length(c) - overlap + 1, F.lit(1)), F.lit(overlap))
    return let(chunks, lambda out: F.transform(out, lambda c, i: F.when(i == 0, c).otherwise(F.concat(tail(F.get(out, i - 1)), F.lit(" "), c))))


def chunk_pages(docs: DataFrame, pages: str = "pages", size: int = SIZE, overlap: int = OVERLAP, cap: int = 0) -> DataFrame:
    """chunk_id, doc_id, ordinal, page, text of documents with an array of struct(page, text).

    Ordinals run on across pages and overlaps don't.  A chunk is kept while those before it in the document have fewer
    than `cap` characters together (0: no cap).
    """
    each = docs.select("doc_id", F.posexplode(pages).alias("_p", "_page"))
    each = each.select("doc_id", "_p", F.col("_page.page").alias("page"), F.posexplode(chunk_array("_page.text", size, overlap)).alias("_i", "text"))
    by_doc = Window.partitionBy("doc_id").orderBy("_p", "_i")
    each = each.withColumn("ordinal", F.row_number().over(by_doc) - 1)
    if cap:
        before = F.sum(F.length("text")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
        each = each.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < cap)
    return each.select(F.concat_ws(":", "doc_id", "ordinal").alias("chunk_id"), "doc_id", "ordinal", "page", "text")


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of documents with one text each; no shuffle, as ordinals are places in the document's own array."""
    each = docs.select("doc_id", F.posexplode(chunk_array("text", size, overlap)).alias("ordinal", "text"))
    return each.select(F.concat_ws(":", "doc_id", "ordinal").alias("chunk_id"), "doc_id", "ordinal", F.lit(1).alias("page"), "text")


PARAGRAPH = 320


def transcript_paragraphs(snippets: Column | str, least: int = PARAGRAPH) -> Column:
    """`[time] text` paragraphs of an ordered array of struct(start, text): one ends when its texts reach `least`."""
    told = F.filter(F.transform(col(snippets), lambda s: F.struct(s["start"].cast("double").alias("start"), clean(s["text"]).alias("text"))), lambda s: s["text"] != "")
    state = lambda lines, buf, start, n: F.struct(lines.alias("lines"), buf.alias("buf"), start.alias("start"), n.alias("n"))
    line = lambda s: F.concat(F.lit("["), clock(s["start"]), F.lit("] "), F.array_join(s["buf"], " "))
    none = F.array().cast("array<string>")

    def add(s: Column, x: Column) -> Column:
        grown = state(s["lines"], F.concat(s["buf"], F.array(x["text"])), F.when(F.size(s["buf"]) == 0, x["start"]).otherwise(s["start"]), s["n"] + F.length(x["text"]))
        return let(grown, lambda g: F.when(g["n"] >= least, state(F.concat(g["lines"], F.array(line(g))), none, F.lit(0.0), F.lit(0))).otherwise(g))

    return F.aggregate(told, state(none, none, F.lit(0.0), F.lit(0)), add, lambda s: F.when(F.size(s["buf"]) == 0, s["lines"]).otherwise(F.concat(s["lines"], F.array(line(s)))))


def transcript_body(snippets: Column | str) -> Column:
    return F.array_join(transcript_paragraphs(snippets), "\n\n")
