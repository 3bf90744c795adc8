"""Queries over files, readers and the clients of models: documents as office files and books, lists, embedders, chat."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cli import Library
from ..functions import embedders
from ..functions.vectors import embedded
from ..operators import enrichment
from ..operators.retrieval import query_vector
from ..scratch import root
from ..sources import files, lists
from .base import query, table

# -- files made of documents -------------------------------------------------------------------------------------------

DOCX = ("word/document.xml", "<w:document xmlns:w='w'><w:body>{0}</w:body></w:document>", "<w:p><w:r><w:t>{0}</w:t></w:r></w:p>")
CORE = "<c:p xmlns:c='c' xmlns:d='d'><d:title>Document {0}</d:title><d:creator>Author {0}</d:creator></c:p>"
SLIDE = "<p:sld xmlns:p='p' xmlns:a='a'><p:txBody>{0}</p:txBody></p:sld>"
EPUB = "<package><dc:title>Document {0}</dc:title><dc:creator>Author {0}</dc:creator></package>"


def archive(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def docx(doc_id: int, lines: list[str]) -> bytes:
    name, whole, paragraph = DOCX
    return archive({name: whole.format("".join(paragraph.format(escape(x)) for x in lines)), "docProps/core.xml": CORE.format(doc_id)})


def pptx(doc_id: int, lines: list[str]) -> bytes:
    """A slide for each line."""
    return archive({f"ppt/slides/slide{n}.xml": SLIDE.format(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>") for n, x in enumerate(lines, 1)})


def epub(doc_id: int, lines: list[str]) -> bytes:
    return archive({"c.opf": EPUB.format(doc_id), "c.xhtml": "".join(f"<p>{x.replace('<', '(')}</p>" for x in lines)})


MAKERS = {".docx": docx, ".pptx": pptx, ".epub": epub}


def office_files(spark, sf_dir: str, suffix: str) -> DataFrame:
    """(doc_id, path, content): every document as a file of that kind, a line a paragraph, slide or element."""

    @F.pandas_udf("binary")
    def made(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([MAKERS[suffix](i, (x or "").split("\n")) for i, x in zip(ids, texts, strict=True)], dtype=object)

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("/lib/d"), "doc_id", F.lit(suffix)).alias("path"), made("doc_id", "text").alias("content"))


LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n FROM documents), f AS (SELECT * FROM l WHERE regexp_matches(line, '\\S'))"


@query(
    "s05_docx_reader",
    f"WITH {LINES_SQL} SELECT d.doc_id, 'Document ' || d.doc_id AS title, 'Author ' || d.doc_id AS author, sha256(string_agg(line, chr(10) || chr(10) ORDER BY n)) AS text FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id",
)
def s05(spark, sf_dir):
    read = office_files(spark, sf_dir, ".docx").withColumn("x", files.extracted("path", "content"))
    return read.select("doc_id", "x.title", F.get("x.authors", F.lit(0)).alias("author"), F.sha2(F.get("x.pages", F.lit(0))["text"], 256).alias("text"))


@query("s06_pptx_reader", f"WITH {LINES_SQL} SELECT d.doc_id, count(line) AS n_pages, min(n) AS first_page, sha256(string_agg(line, chr(10) ORDER BY n)) AS text FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id")
def s06(spark, sf_dir):
    read = office_files(spark, sf_dir, ".pptx").withColumn("x", files.extracted("path", "content"))
    pages = F.col("x.pages")
    text = F.when(F.size(pages) > 0, F.sha2(F.array_join(F.transform(pages, lambda p: p["text"]), "\n"), 256))
    return read.select("doc_id", F.size(pages).cast("long").alias("n_pages"), F.get(pages, F.lit(0))["page"].cast("long").alias("first_page"), text.alias("text"))


@query(
    "s09_epub_reader",
    """
    SELECT doc_id, 'Document ' || doc_id AS title, 'Author ' || doc_id AS author, CASE WHEN regexp_matches(coalesce(text, ''), '\\S')
      THEN sha256(regexp_replace(regexp_replace(replace(text, '<', '('), '\\s+', ' ', 'g'), '^ | $', '', 'g')) END AS text
    FROM documents
    """,
)
def s09(spark, sf_dir):
    read = office_files(spark, sf_dir, ".epub").withColumn("x", files.extracted("path", "content"))
    return read.select("doc_id", "x.title", F.get("x.authors", F.lit(0)).alias("author"), F.sha2(F.get("x.pages", F.lit(0))["text"], 256).alias("text"))


@query(
    "f18_biblio",
    """
    SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'd' || doc_id ELSE 'Document ' || doc_id END AS title, CASE doc_id % 3 WHEN 2 THEN '' ELSE 'Author ' || doc_id END AS authors
    FROM documents
    """,
)
def f18(spark, sf_dir):
    """Word files and books that say what they are, and files that aren't what their name says, which are titled by it."""
    k = F.col("doc_id") % 3
    broken = F.encode(F.lit("no archive"), "UTF-8")
    word, book = office_files(spark, sf_dir, ".docx").filter(k != 1), office_files(spark, sf_dir, ".epub").filter(k == 1)
    made = files.biblio(word.withColumn("content", F.when(k == 2, broken).otherwise(F.col("content"))).unionByName(book))
    return made.select("doc_id", "biblio.title", F.array_join("biblio.authors", ", ").alias("authors"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("s01_file_discovery", "SELECT unnest([" + ", ".join(f"'{x}'" for x in TABLES) + "]) AS name")
def s01(spark, sf_dir):
    """The tables' own files, found below their folder."""
    found = files.list_files(spark, sf_dir, [".parquet"])
    return found.select(F.regexp_extract("path", r"([^/]+)\.parquet(?:/[^/]*)?$", 1).alias("name")).distinct()


@query("s19_single_export", "SELECT CAST(item_id AS VARCHAR) AS item_id, sha256(text || chr(10)) AS text FROM benchmark")
def s19(spark, sf_dir):
    """Whole files, one for each benchmark item."""
    path = f"{root(spark)}/export-{uuid.uuid4().hex}"
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    return files.read_export(spark, f"{path}/*").select(F.regexp_extract("path", "item_id=([^/]+)/", 1).alias("item_id"), F.sha2("text", 256).alias("text"))


# -- tables ------------------------------------------------------------------------------------------------------------


@query("s12_backlog_file", "SELECT CAST(event_id AS VARCHAR) AS video_id, CASE event_id % 2 WHEN 0 THEN 'done' ELSE 'pending' END AS status, CAST(event_id % 3 AS INTEGER) AS attempts, user_id % 2 AS playlists FROM events")
def s12(spark, sf_dir):
    """A backlog of JSON lines, written twice; the second version is the one that is read."""
    path = f"{root(spark)}/backlog-{uuid.uuid4().hex}"
    lists_ = F.when(F.col("user_id") % 2 == 1, F.array(F.lit("PL"))).otherwise(F.array().cast("array<string>"))
    one = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("video_id"), lists_.alias("playlists"), F.lit("pending").alias("status"), (F.col("event_id") % 3).cast("int").alias("attempts"))
    lists.write_versioned(one, path, "json")
    lists.write_versioned(one.withColumn("status", F.when(F.col("video_id").cast("long") % 2 == 0, "done").otherwise("pending")), path, "json")
    return lists.read_backlog(spark, lists.newest_folder(spark, path)).select("video_id", "status", "attempts", F.size("playlists").cast("long").alias("playlists"))


@query("p06_table_exists", "SELECT * FROM (VALUES ('documents', true), ('doc_similar', false)) t(name, known)")
def p06(spark, sf_dir):
    lib = Library(spark, f"{root(spark)}/library-{uuid.uuid4().hex}")
    lib.write("documents", table(spark, sf_dir, "documents").select("doc_id"))
    return spark.createDataFrame([(name, lib.read(name) is not None) for name in ("documents", "doc_similar")], "name string, known boolean")


# -- models ------------------------------------------------------------------------------------------------------------


def lengths():
    """A model that needs no weights: a text's length and its number of spaces."""
    return lambda texts: [[float(len(x)), float(x.count(" "))] for x in texts]


def unsteady():
    """A service that fails each time before it answers."""
    state = {"down": True}

    def send(*asked):
        state["down"] = not state["down"]
        if not state["down"]:
            raise OSError("busy")
        return asked[-1]

    return send


def local():
    return embedders.get_embedder("local", model="lengths", load=lengths, passage="passage: ", query="query: ")


def remote():
    send, model = unsteady(), lengths()
    return embedders.get_embedder("remote", model="far", send=lambda name, texts: model(send(texts)), wait=lambda _: None)


VECTOR_SQL = "SELECT doc_id, CAST(length(t) AS DOUBLE) AS a, CAST(length(t) - length(replace(t, ' ', '')) AS DOUBLE) AS b FROM (SELECT doc_id, {} || coalesce(text, '') AS t FROM documents)"


@query("e02_e04_local_embedder", VECTOR_SQL.format("'passage: '"))
def e02(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("v", embedded(local(), "text")).select("doc_id", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))


@query("e03_remote_embedder", VECTOR_SQL.format("''"))
def e03(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("v", embedded(remote(), "text")).select("doc_id", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))


@query("r10_query_vector", "SELECT * FROM (VALUES ('local', 16.0, 2.0), ('remote', 9.0, 1.0)) t(kind, a, b)")
def r10(spark, sf_dir):
    """Queries have their own prefix where the embedder has one for them."""
    made = [(kind, *query_vector("red mices", e)) for kind, e in (("local", local()), ("remote", remote()))]
    return spark.createDataFrame(made, "kind string, a double, b double")


@query(
    "d09_chat_client",
    """
    SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 'Opening text: ' || length(text) END AS reply, CASE WHEN NOT regexp_matches(coalesce(text, ''), '\\S') THEN 'no text' END AS error
    FROM documents
    """,
)
def d09(spark, sf_dir):
    """A client that tries again; the service fails each time before it answers."""
    send = unsteady()
    client = enrichment.RetryingClient(lambda system, user: f"{send(user).partition(':')[0]}: {len(user) - len('Opening text:') - 2}", wait=lambda _: None)
    return enrichment.asked(table(spark, sf_dir, "documents").select("doc_id", "text"), client, "s").select("doc_id", "reply", "error")
