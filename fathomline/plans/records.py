"""Queries over table changes, predicates, joins, aggregates, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrichment as E
from ..operators import tables
from .base import query, table


def docs(spark, sf_dir) -> DataFrame:
    """Documents with a quality label as needs_review, where there is one."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("needs_review"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("needs_review", F.coalesce("needs_review", F.lit(False)))


@query("k01_upsert", "SELECT c_custkey AS id, c_name AS path, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0")
def k01(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"), F.col("c_acctbal").alias("v"))
    return tables.upsert(old, old.filter("id % 3 = 0").withColumn("v", F.col("v") + 1), ["id", "path"])


@query("k02_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def k02(spark, sf_dir):
    return tables.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query(
    "k03_j07_promote",
    """
    WITH e AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN ['A', 'B'] ELSE [] END AS authors, CASE WHEN doc_id % 4 = 0 THEN 2000 END AS year FROM labels)
    SELECT d.doc_id, coalesce(e.title, d.source) AS title, array_to_string(CASE WHEN len(e.authors) > 0 THEN e.authors ELSE [d.lang] END, '|') AS authors, coalesce(e.year, 1990) AS year,
           CASE WHEN e.doc_id IS NULL THEN true ELSE false END AS needs_review
    FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id
    """,
)
def k03(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.array("lang").alias("authors"), F.lit(1990).alias("year"), F.lit(None).cast("string").alias("venue"), F.lit(True).alias("needs_review"))
    i = F.col("doc_id")
    e = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(i % 2 == 0, F.concat(F.lit("T"), i)).alias("title"), F.when(i % 3 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")).alias("authors"), F.when(i % 4 == 0, F.lit(2000)).alias("year"), F.lit(None).cast("string").alias("venue")
    )
    return tables.promote(d, e).select("doc_id", "title", F.array_join("authors", "|").alias("authors"), "year", "needs_review")


@query("k04_internal_flag", "SELECT doc_id, source = 'src1' AS internal FROM documents")
def k04(spark, sf_dir):
    path = F.concat_ws("/", "source", "doc_id")
    return tables.flag_internal(table(spark, sf_dir, "documents").select("doc_id", path.alias("rel_path")), "src1").select("doc_id", "internal")


@query("k05_prune", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'")
def k05(spark, sf_dir):
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("path"), "o_orderstatus")
    pieces = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")
    _, kept = tables.prune(documents, pieces, documents.filter("o_orderstatus <> 'F'").select("path"))
    return kept.select(F.col("doc_id").alias("l_orderkey"), "l_linenumber")


@query("p01_changed", "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 3 = 1 OR o_orderkey % 5 = 0")
def p01(spark, sf_dir):
    i = F.col("o_orderkey")
    known = table(spark, sf_dir, "orders").select(i.alias("doc_id"), F.lit(10).alias("size"), F.lit(100.0).alias("mtime"))
    now = known.withColumn("size", F.when(F.col("doc_id") % 3 == 1, 11).otherwise(10)).withColumn("mtime", F.when(F.col("doc_id") % 5 == 0, 101.0).otherwise(100.9))
    return tables.changed(now, known).select("doc_id")


@query("p02_boolean_filter", "SELECT doc_id FROM labels WHERE quality = 0")
def p02(spark, sf_dir):
    return docs(spark, sf_dir).filter("needs_review").select("doc_id")


@query("p03_prefix", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'")
def p03(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_name").startswith("red")).select("p_partkey", "p_name")


@query("p04_in_list", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def p04(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("p05_j08_targets", "SELECT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id LIMIT 40")
def p05(spark, sf_dir):
    done = table(spark, sf_dir, "labels").filter("toxic = 1")
    return E.targets(docs(spark, sf_dir), done, only_review=True, limit=40)


@query("o04_opening_text", "SELECT conv_id AS doc_id, sha256(substr(string_agg(text, chr(10) || chr(10) ORDER BY turn), 1, 5000)) AS opening FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 5 GROUP BY conv_id")
def o04(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), "text")
    return E.opening_text(turns).select("doc_id", F.sha2("text", 256).alias("opening"))


class EchoClient:
    """Answers as a model might: by rule, fenced, and for some texts not at all."""

    def complete(self, system: str, user: str) -> str:
        words = user.split()[2:]
        if len(words) % 7 == 0:
            raise TimeoutError("no answer")
        return '```json\n{"title": "%s", "authors": ["A. Writer", ""], "year": 2001, "venue": "", "keywords": ["One ", "two"]}\n```' % words[0].strip('".\\')


@query("d08_enrichment", None)
def d08(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), "text")
    replies = E.asked(E.opening_text(chunks), EchoClient(), "Describe the document.")
    return E.enrichment_rows(replies).drop("enriched_at")


@query("a11_run_counters", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'indexed' WHEN o_orderstatus = 'F' THEN 'pruned' ELSE 'skip' END AS outcome FROM orders) GROUP BY outcome")
def a11(spark, sf_dir):
    outcome = F.when(F.col("o_orderkey") % 5 == 0, "indexed").when(F.col("o_orderstatus") == "F", "pruned").otherwise("skip")
    return table(spark, sf_dir, "orders").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("j01_chunks_documents", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j01(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")


@query("j05_two_hops", "SELECT b.l_orderkey AS doc_id, count(*) AS paths FROM lineitem a JOIN lineitem b ON b.l_partkey = a.l_partkey WHERE a.l_orderkey < 50 GROUP BY b.l_orderkey")
def j05(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    seeds = edges.filter("l_orderkey < 50").select("l_partkey")
    return edges.join(seeds, "l_partkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("paths"))


@query("a02_filtered_count", "SELECT count(*) AS documents, count(*) FILTER (WHERE quality = 0) AS review, count(*) FILTER (WHERE toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def a02(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.agg(F.count("*").alias("documents"), F.count_if(F.col("quality") == 0).alias("review"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("a03_o01_topics", "SELECT source AS topic, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 15")
def a03(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("topic")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(15)


@query("a04_weighted_sum", "SELECT l_partkey, round(0.6 * sum(l_discount), 6) AS score FROM lineitem GROUP BY l_partkey")
def a04(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(0.6 * F.sum("l_discount"), 6).alias("score"))


@query("a07_shared", "SELECT a.l_suppkey AS one, b.l_suppkey AS other, count(*) AS shared FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL")
def a07(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    other = edges.withColumnRenamed("l_suppkey", "other")
    return edges.join(other, "l_orderkey").filter("l_suppkey < other").groupBy(F.col("l_suppkey").alias("one"), "other").agg(F.count("*").alias("shared"))


@query("a09_categories", "SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL")
def a09(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))


@query(
    "a10_k10_manifest",
    """
    WITH f AS (SELECT source AS part, source || '/' || doc_id AS rel, strlen(text) AS n, sha256(text) AS h FROM documents),
    s AS (SELECT part, substr(md5(rel), 1, 3) AS slice, count(*) AS n, sum(n) AS b, sha256(string_agg(h, '' ORDER BY rel)) AS h FROM f GROUP BY ALL)
    SELECT part, CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes, sha256(string_agg(h, '' ORDER BY slice)) AS sha256 FROM s GROUP BY part
    """,
)
def a10(spark, sf_dir):
    from ..sources.lists import manifest

    path = F.concat_ws("/", F.lit("/lib"), "source", "doc_id")
    content = F.encode("text", "UTF-8")
    files = table(spark, sf_dir, "documents").select(path.alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"))
    return manifest(files, "/lib").select("part", "files", "bytes", "sha256")


@query("w01_surrogate_key", "SELECT row_number() OVER (ORDER BY s_name) AS id, s_name FROM supplier")
def w01(spark, sf_dir):
    from ..operators.graph import numbered

    return numbered(table(spark, sf_dir, "supplier").select("s_name"), "s_name", "id").select("id", "s_name")


@query("w02_rank", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events")
def w02(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", rank.alias("rank"))


@query("o02_nulls_last", "SELECT DISTINCT p_brand, CASE WHEN p_size % 5 <> 0 THEN p_size END AS year FROM part ORDER BY year DESC NULLS LAST, p_brand LIMIT 25")
def o02(spark, sf_dir):
    year = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_brand", year.alias("year")).distinct().orderBy(F.desc_nulls_last("year"), "p_brand").limit(25)


@query("o03_multi_key_sort", "SELECT c_mktsegment, c_nationkey, count(*) AS docs FROM customer GROUP BY ALL ORDER BY docs DESC, c_mktsegment, c_nationkey LIMIT 20")
def o03(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "c_mktsegment", "c_nationkey").limit(20)


@query("o05_top_k_per_key", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 8")
def o05(spark, sf_dir):
    best = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(best)).filter("n <= 8").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("o06_top_k", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 5")
def o06(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(5)


@query("u01_union_all", "SELECT doc, CAST(sum(s) AS BIGINT) AS score FROM (SELECT l_orderkey AS doc, 1 AS s FROM lineitem UNION ALL SELECT o_orderkey, 2 FROM orders UNION ALL SELECT c_custkey, 4 FROM customer) GROUP BY doc")
def u01(spark, sf_dir):
    part = lambda name, key, s: table(spark, sf_dir, name).select(F.col(key).alias("doc"), F.lit(s).alias("s"))
    return part("lineitem", "l_orderkey", 1).unionByName(part("orders", "o_orderkey", 2)).unionByName(part("customer", "c_custkey", 4)).groupBy("doc").agg(F.sum("s").alias("score"))


@query("u02_values", "SELECT r_name, CAST(w AS DOUBLE) AS w FROM region JOIN (VALUES (0, 0.5), (2, 0.25)) AS s(k, w) ON k = r_regionkey")
def u02(spark, sf_dir):
    seeds = spark.createDataFrame([(0, 0.5), (2, 0.25)], "r_regionkey int, w double")
    return table(spark, sf_dir, "region").join(F.broadcast(seeds), "r_regionkey").select("r_name", "w")


@query("u03_ordered_distinct", "SELECT user_id, array_to_string(list(event_type ORDER BY first), ',') AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def u03(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))


@query("p08_via", "SELECT doc_id, 'hybrid' AS via FROM documents")
def p08(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("hybrid").alias("via"))


@query("d04_backlog", "SELECT CAST(user_id AS VARCHAR) AS video_id, count(DISTINCT event_type) AS playlists FROM events GROUP BY user_id")
def d04(spark, sf_dir):
    from ..operators.rules import merge_backlog

    e = table(spark, sf_dir, "events")
    entries = e.select(F.col("user_id").cast("string").alias("video_id"), F.lit(None).cast("string").alias("url"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("channel"), F.col("event_type").alias("playlist"), F.col("event_id").alias("order"))
    return merge_backlog(entries).select("video_id", F.size("playlists").cast("long").alias("playlists"))


@query(
    "d06_retry_states",
    """
    WITH RECURSIVE a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type AS k FROM events),
    r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'pending' AS status, CAST(0 AS BIGINT) AS attempts FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL
      SELECT r.user_id, a.n, CASE WHEN k = 'purchase' THEN 'done' WHEN k = 'signup' THEN 'skipped' WHEN k IN ('click', 'view') THEN 'pending' WHEN r.attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END,
             r.attempts + CASE WHEN k = 'purchase' THEN 0 ELSE 1 END
      FROM r JOIN a ON a.user_id = r.user_id AND a.n = r.n + 1 WHERE r.status = 'pending')
    SELECT CAST(user_id AS VARCHAR) AS video_id, arg_max(status, n) AS status, CAST(max(attempts) AS INTEGER) AS attempts FROM r GROUP BY user_id
    """,
)
def d06(spark, sf_dir):
    from ..operators.rules import final_states

    error = F.when(F.col("event_type") == "signup", "VideoUnavailable").when(F.col("event_type").isin("click", "view"), "IpBlocked").when(F.col("event_type") == "error", "RuntimeError")
    attempts = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("n"), error.alias("error"))
    return final_states(attempts).select("video_id", "status", "attempts")


@query("k06_schema_check", "SELECT 64 AS dim, count(*) AS n FROM embeddings WHERE len(embedding) = 64")
def k06(spark, sf_dir):
    """The one width that the vectors have, held against the embedder's."""
    from ..functions.embedders import check_dim, get_embedder

    found = table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    for r in found.select("dim").limit(2).collect():
        check_dim(r["dim"], get_embedder(dim=64))
    return found


@query("k07_registered_functions", "SELECT s_suppkey, lower(regexp_replace(s_name, '#', '')) AS name, lower(replace(s_name, '#', ' ')) AS term FROM supplier")
def k07(spark, sf_dir):
    T.register(spark)
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "norm_name(s_name) AS name", "norm_term(s_name) AS term")
