"""Queries over text functions, chunking and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking
from .base import query, table

SIZE, OVERLAP = 1200, 150
#: Chunks of documents in SQL.  The tables' texts have no blank lines, so a text is one paragraph.
CHUNKS_SQL = f"""
t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS text FROM documents),
s AS (
  SELECT doc_id, i // {SIZE - OVERLAP} AS ordinal, substr(text, i + 1, {SIZE}) AS piece
  FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) > {SIZE} THEN range(0, length(text), {SIZE - OVERLAP}) ELSE [0] END) AS i FROM t WHERE text <> '')
),
chunks AS (
  SELECT doc_id || ':' || ordinal AS chunk_id, doc_id, ordinal,
         CASE WHEN prev IS NULL THEN piece ELSE right(prev, {OVERLAP}) || ' ' || piece END AS text
  FROM (SELECT *, lag(piece) OVER (PARTITION BY doc_id ORDER BY ordinal) AS prev FROM s)
)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), SIZE, OVERLAP)


@query("t01_chunks", f"WITH {CHUNKS_SQL} SELECT chunk_id, doc_id, CAST(ordinal AS INTEGER) AS ordinal, sha256(text) AS text_hash, CAST(length(text) AS INTEGER) AS size FROM chunks")
def t01(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "doc_id", "ordinal", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("size"))


@query(
    "t02_w04_page_chunks",
    """
    WITH p AS (SELECT doc_id, i AS page, string_split(text, chr(10))[i] AS text
               FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    q AS (SELECT doc_id, page, trim(text) AS text FROM p WHERE trim(text) <> ''),
    s AS (SELECT doc_id, page, i // 250 AS n, substr(text, i + 1, 300) AS piece
          FROM (SELECT *, unnest(CASE WHEN length(text) > 300 THEN range(0, length(text), 250) ELSE [0] END) AS i FROM q)),
    c AS (SELECT doc_id, page, n, CASE WHEN prev IS NULL THEN piece ELSE right(prev, 50) || ' ' || piece END AS text
          FROM (SELECT *, lag(piece) OVER (PARTITION BY doc_id, page ORDER BY n) AS prev FROM s)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, n) - 1 AS ordinal FROM c)
    SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(page AS INTEGER) AS page, sha256(text) AS text_hash FROM r
    """,
)
def t02(spark, sf_dir):
    """Every chunk of every text: lines as pages, no cap."""
    docs = table(spark, sf_dir, "documents")
    pages = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("page"), x.alias("text")))
    out = chunking.chunk_pages(docs.select("doc_id", pages.alias("pages")), size=300, overlap=50)
    return out.select("doc_id", "ordinal", "page", F.sha2("text", 256).alias("text_hash"))


@query("t03_unnest", "SELECT p_partkey AS doc_id, unnest(string_split(p_name, ' ')) AS word, CAST(generate_subscripts(string_split(p_name, ' '), 1) AS INTEGER) AS position FROM part")
def t03(spark, sf_dir):
    from ..operators.graph import exploded

    return exploded(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.split("p_name", " ").alias("words")), "words", "word")


@query(
    "e01_hash_embedding",
    f"""
    WITH {CHUNKS_SQL},
    w AS (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS token FROM chunks),
    b AS (SELECT chunk_id, CAST(('0x' || right(md5(token), 2)) AS INTEGER) % 64 AS i, count(*) AS n FROM w GROUP BY ALL),
    l AS (SELECT chunk_id, sqrt(sum(n * n)) AS size FROM b GROUP BY chunk_id)
    SELECT b.chunk_id, CAST(i AS INTEGER) AS i, round(n / size, 6) AS x FROM b JOIN l USING (chunk_id)
    """,
)
def e01(spark, sf_dir):
    made = chunks(spark, sf_dir).select("chunk_id", V.HashEmbedder(64).column("text").alias("e"))
    each = made.select("chunk_id", F.posexplode("e").alias("i", "x")).filter("x <> 0")
    return each.select("chunk_id", "i", F.round("x", 6).alias("x"))


@query(
    "e01_hash_buckets",
    """
    WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS token FROM documents)
    SELECT CAST(('0x' || right(md5(token), 2)) AS BIGINT) AS bucket, count(*) AS n FROM w GROUP BY bucket
    """,
)
def e01_buckets(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("token")).filter("token <> ''").distinct()
    return words.groupBy(V.bucket("token", 256).alias("bucket")).agg(F.count("*").alias("n"))


@query("e06_text_hash", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def e06(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))


def _norm_sql(signs: str, by: str) -> str:
    """DuckDB has no NFKD, but takes accents off; the tables' texts hold no other letters that NFKD would take apart."""
    folded = "regexp_replace(strip_accents(coalesce(text, '')), '[^\\x00-\\x7F]', '', 'g')"
    return f"SELECT doc_id, sha256(trim(regexp_replace(lower(regexp_replace({folded}, '{signs}', '{by}', 'g')), '\\s+', ' ', 'g'))) AS norm_hash FROM documents"


@query("f01_norm_name", _norm_sql("[^A-Za-z0-9_\\s.-]", ""))
def f01(spark, sf_dir):
    """Of whole texts; null texts are empty."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.norm_name("text"), 256).alias("norm_hash"))


@query("f02_norm_term", _norm_sql("[^A-Za-z0-9_\\s-]", " "))
def f02(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.norm_term("text"), 256).alias("norm_hash"))


GENERIC_SQL = T.GENERIC_TITLE.removeprefix("(?i)").replace("'", "''")


@query(
    "f03_title_key",
    f"""
    WITH k AS (SELECT item_id, trim(regexp_replace(lower(split_part(text, '.', 1)), '[^a-z0-9]+', ' ', 'g')) AS key FROM benchmark)
    SELECT item_id, key, length(key) >= 25 AND NOT regexp_matches(key, '(?i){GENERIC_SQL}') AS usable FROM k
    """,
)
def f03(spark, sf_dir):
    keyed = table(spark, sf_dir, "benchmark").select("item_id", T.title_key(F.split_part(F.col("text"), F.lit("."), F.lit(1))).alias("key"))
    return keyed.select("item_id", "key", T.usable_key("key").alias("usable"))


@query(
    "f04_slug",
    """
    WITH a AS (SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_\\s.,''()&-]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM benchmark)
    SELECT item_id, CASE WHEN t = '' THEN 'untitled' WHEN length(t) > 60 THEN regexp_replace(substr(t, 1, 60), ' [^ ]*$', '') ELSE t END AS slug FROM a
    """,
)
def f04(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.slug("text", 60).alias("slug"))


@query("f05_clean", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS cleaned FROM documents")
def f05(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean("text"), 256).alias("cleaned"))


@query(
    "f06_boilerplate",
    """
    WITH l AS (SELECT doc_id, i, lower(trim(regexp_replace(lines[i], '\\s+', ' ', 'g'))) AS low
               FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))
    SELECT doc_id, CAST(i AS INTEGER) AS i,
           low = '' OR low IN ('untitled', 'document', 'microsoft word - document', 'presentation', 'contents lists available at sciencedirect')
           OR starts_with(low, 'microsoft word') OR regexp_matches(low, '^[0-9]+(st|nd|rd|th)\\s') AS reader,
           low = '' OR low IN ('untitled', 'document', 'microsoft word - document', 'presentation', 'word document', 'abstract', 'introduction')
           OR starts_with(low, 'microsoft word') OR starts_with(low, 'arxiv:') OR regexp_matches(low, '^[0-9]+(st|nd|rd|th)\\s')
           OR (contains(low, '@') AND len(string_split(low, ' ')) <= 4) AS importer
    FROM l
    """,
)
def f06(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.select("doc_id", (F.col("p") + 1).alias("i"), T.is_boilerplate("line").alias("reader"), T.is_boilerplate_import("line").alias("importer"))


@query(
    "f07_year",
    "SELECT o_orderkey, list_max(list_transform(regexp_extract_all(o_orderpriority || ' ' || strftime(o_orderdate, '%Y') || ' and 2051', '\\b(19[7-9][0-9]|20[0-4][0-9])\\b', 1), lambda y: CAST(y AS INTEGER))) AS year FROM orders",
)
def f07(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.guess_year(F.concat_ws(" ", "o_orderpriority", F.date_format("o_orderdate", "yyyy"), F.lit("and 2051"))).alias("year"))


LABEL_SQL = """CASE len(s) WHEN 0 THEN '{0}' WHEN 1 THEN s[1] WHEN 2 THEN s[1] || ' and ' || s[2] ELSE s[1] || ' et al.' END"""


@query(
    "f08_author_label",
    f"""
    WITH s AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: CASE WHEN p_size % 2 = 0 THEN 'van der ' || w ELSE w END) AS a,
                      list_transform(string_split(p_name, ' '), lambda w: CASE WHEN p_size % 2 = 0 THEN 'der ' || w ELSE w END) AS b FROM part)
    SELECT p_partkey, {LABEL_SQL.format('').replace('s[', 'a[').replace('len(s)', 'len(a)')} AS label, {LABEL_SQL.format('Unknown').replace('s[', 'b[').replace('len(s)', 'len(b)')} AS label_import FROM s
    """,
)
def f08(spark, sf_dir):
    names = F.transform(F.split("p_name", " "), lambda w: F.concat(F.when(F.col("p_size") % 2 == 0, "1st J. van der ").otherwise("J. "), w, F.lit(" (B)")))
    return table(spark, sf_dir, "part").select("p_partkey", T.author_label(names).alias("label"), T.author_label(names, importer=True).alias("label_import"))


@query(
    "f09_file_name",
    "SELECT p_partkey, CASE WHEN len(string_split(p_name, ' ')) = 2 THEN split_part(p_name, ' ', 1) || ' and ' || split_part(p_name, ' ', 2) ELSE p_name END || ' - ' || p_type || ' ' || p_partkey || '.pdf' AS name FROM part",
)
def f09(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.import_name(F.concat_ws(" ", "p_type", "p_partkey"), F.split("p_name", " "), F.lit(".PDF")).alias("name"))


@query(
    "f10_junk_names",
    """
    WITH n AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Unknown - ' || p_name WHEN 1 THEN 'ieee - ' || p_name WHEN 2 THEN p_name || ' 12'
                                 WHEN 3 THEN upper(p_name) || ' AND MORE' ELSE 'Smith - ' || p_name END AS stem, p_size % 5 AS k FROM part)
    SELECT p_partkey, stem, CASE k WHEN 4 THEN false WHEN 2 THEN len(string_split(stem, ' ')) <= 2 WHEN 3 THEN length(stem) > 12 ELSE true END AS junk FROM n
    """,
)
def f10(spark, sf_dir):
    k = F.col("p_size") % 5
    stem = F.when(k == 0, F.concat(F.lit("Unknown - "), "p_name")).when(k == 1, F.concat(F.lit("ieee - "), "p_name")).when(k == 2, F.concat("p_name", F.lit(" 12"))).when(k == 3, F.concat(F.upper("p_name"), F.lit(" AND MORE"))).otherwise(F.concat(F.lit("Smith - "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", stem.alias("stem")).withColumn("junk", T.is_junk_stem("stem"))


@query(
    "f13_source_topic",
    """
    SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Literature' WHEN 1 THEN 'Literature' WHEN 2 THEN 'Transcripts' WHEN 3 THEN 'Outbox' WHEN 4 THEN 'Inbox' ELSE 'Other' END AS source,
           CASE s_suppkey % 6 WHEN 0 THEN 'x/n' || s_nationkey WHEN 1 THEN '(root)' WHEN 2 THEN 'Transcripts/n' || s_nationkey WHEN 3 THEN 'Outbox' WHEN 4 THEN 'Inbox' ELSE 'Other' END AS topic FROM supplier
    """,
)
def f13(spark, sf_dir):
    k, n = F.col("s_suppkey") % 6, F.concat(F.lit("n"), "s_nationkey")
    path = F.when(k == 0, F.concat(F.lit("Literature/x/"), n, F.lit("/f.pdf"))).when(k == 1, "Literature/f.pdf").when(k == 2, F.concat(F.lit("Transcripts/"), n, F.lit("/f.md"))).when(k == 3, "Outbox/a/f.md").when(k == 4, "Inbox/f.pdf").otherwise("elsewhere/f.pdf")
    place = T.source_and_topic("path")
    return table(spark, sf_dir, "supplier").select("s_suppkey", path.alias("path")).select("s_suppkey", place["source"].alias("source"), place["topic"].alias("topic"))


@query("f14_company", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN n_name ELSE '' END AS company FROM nation")
def f14(spark, sf_dir):
    path = F.concat(F.when(F.col("n_regionkey") == 0, "Literature/Blogs/").otherwise("Literature/Other/"), "n_name", F.lit("/post.md"))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.company(path).alias("company"))


@query("f20_clock", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') ELSE lpad(CAST(s // 60 AS VARCHAR), 2, '0') END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 50) AS BIGINT) AS s FROM orders)")
def f20(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.clock(F.col("o_totalprice") / 50).alias("clock"))


@query("f21_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def f21(spark, sf_dir):
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.dashed_date(F.when(F.col("o_orderkey") % 7 == 0, F.substring(compact, 1, 6)).otherwise(compact)).alias("date"))


@query("f22_byte_size", "SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size FROM (SELECT doc_id, CAST(n_chars * n_chars AS DOUBLE) AS n FROM documents)")
def f22(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.byte_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("f23_json_object", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f23(spark, sf_dir):
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(T.json_object(reply), "$.k").cast("long").alias("k"))


@query(
    "f24_clean_lists",
    """
    WITH w AS (SELECT doc_id, list_filter(string_split(trim(text), ' '), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, array_to_string(list_filter(w, lambda x: length(x) <= 80)[1:15], '|') AS authors, array_to_string(list_transform(w, lambda x: lower(trim(x)))[1:8], '|') AS keywords
    FROM (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: x) AS w FROM documents)
    """,
)
def f24(spark, sf_dir):
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.clean_authors(words), "|").alias("authors"), F.array_join(T.clean_keywords(words), "|").alias("keywords"))


@query(
    "f30_cosine",
    "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b",
)
def f30(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    one = df.filter("vec_id = 0").select("embedding").first()[0]
    return df.select("vec_id", F.round(V.cosine("embedding", V.literal(one)), 6).alias("cosine"))


@query("p07_snippet", "SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300) AS snippet, coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END, ''), '(untitled)') AS title FROM documents")
def p07(spark, sf_dir):
    title = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet("text").alias("snippet"), T.or_default(title, "(untitled)").alias("title"))


@query(
    "w05_t05_paragraphs",
    """
    WITH RECURSIVE s AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CAST(turn * 10 AS DOUBLE) AS start, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text
      FROM conversations WHERE trim(text) <> ''
    ), r AS (
      SELECT conv_id, n, 1 AS par, start AS first, text AS body, length(text) AS size FROM s WHERE n = 1
      UNION ALL
      SELECT s.conv_id, s.n, CASE WHEN r.size >= 320 THEN r.par + 1 ELSE r.par END, CASE WHEN r.size >= 320 THEN s.start ELSE r.first END,
             CASE WHEN r.size >= 320 THEN s.text ELSE r.body || ' ' || s.text END, CASE WHEN r.size >= 320 THEN length(s.text) ELSE r.size + length(s.text) END
      FROM r JOIN s ON s.conv_id = r.conv_id AND s.n = r.n + 1
    ), f AS (SELECT conv_id, par, arg_max(body, n) AS body, min(first) AS first FROM r GROUP BY conv_id, par)
    SELECT conv_id, string_agg('[' || lpad(CAST(CAST(first AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(first AS BIGINT) % 60 AS VARCHAR), 2, '0') || '] ' || body, chr(10) || chr(10) ORDER BY par) AS body
    FROM f GROUP BY conv_id
    """,
)
def w05(spark, sf_dir):
    told = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    snippets = F.transform("t", lambda x: F.struct((x["turn"] * 10).alias("start"), x["text"].alias("text")))
    return told.select("conv_id", chunking.transcript_body(snippets).alias("body"))


@query(
    "w06_overlap_tail",
    """
    SELECT conv_id, turn, CASE WHEN prev IS NULL THEN text ELSE right(prev, 50) || ' ' || text END AS text
    FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
    """,
)
def w06(spark, sf_dir):
    from pyspark.sql import Window

    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    df = table(spark, sf_dir, "conversations").withColumn("prev", prev)
    return df.select("conv_id", "turn", F.when(F.col("prev").isNull(), F.col("text")).otherwise(F.concat(F.right("prev", F.lit(50)), F.lit(" "), "text")).alias("text"))
