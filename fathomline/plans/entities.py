"""Queries over entities, edges and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from .base import query, table


def papers(spark, sf_dir) -> DataFrame:
    """Parts as documents: the words of their name are authors (every fourth part spells one twice), brand and type their
    keywords, nation folders their paths."""
    w = F.split("p_name", " ")
    authors = F.when(F.col("p_partkey") % 4 == 0, F.concat(w, F.array(F.upper(F.get(w, F.lit(0)))))).otherwise(w)
    path = F.concat(F.when(F.col("p_size") % 2 == 0, "Literature/Blogs/").otherwise("Literature/x/"), F.initcap("p_type"), F.lit("/"), "p_partkey", F.lit(".md"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("doc_id"), F.concat_ws(" ", "p_name", "p_partkey").alias("title"), authors.alias("authors"), F.lower("p_type").alias("topic"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size") + 1980).alias("year"), path.alias("rel_path"), F.array(F.lower("p_brand"), F.concat(F.col("p_type"), F.lit(" goods")), F.lit("x")).alias("keywords"),
    )


PAPERS_SQL = """
papers AS (
  SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_name || ' ' || p_partkey AS title,
         CASE WHEN p_partkey % 4 = 0 THEN list_append(string_split(p_name, ' '), upper(split_part(p_name, ' ', 1))) ELSE string_split(p_name, ' ') END AS authors, lower(p_type) AS topic,
         CASE WHEN p_size % 5 <> 0 THEN p_size + 1980 END AS year,
         CASE WHEN p_size % 2 = 0 THEN 'Literature/Blogs/' ELSE 'Literature/x/' END || upper(p_type[1]) || lower(p_type[2:]) || '/' || p_partkey || '.md' AS rel_path,
         CASE WHEN p_size % 2 = 0 THEN upper(p_type[1]) || lower(p_type[2:]) END AS company,
         [replace(lower(p_brand), '#', ' '), lower(p_type) || ' goods', 'x'] AS keyword_norms, [lower(p_brand), p_type || ' goods', 'x'] AS keywords
  FROM part
),
x AS (SELECT doc_id, unnest(authors) AS a, generate_subscripts(authors, 1) AS position FROM papers),
authors AS (SELECT row_number() OVER (ORDER BY n) AS author_id, name, n AS name_norm
            FROM (SELECT lower(a) AS n, min({'p': position, 'a': a})['a'] AS name FROM x GROUP BY lower(a))),
doc_authors AS (SELECT doc_id, author_id, CAST(position AS INTEGER) AS position FROM x JOIN authors ON name_norm = lower(a)),
companies AS (SELECT row_number() OVER (ORDER BY lower(company)) AS company_id, company AS name, lower(company) AS name_norm FROM (SELECT DISTINCT company FROM papers WHERE company IS NOT NULL)),
doc_companies AS (SELECT doc_id, company_id FROM papers JOIN companies ON name = company),
kx AS (SELECT doc_id, unnest(keywords) AS k, unnest(keyword_norms) AS n FROM papers),
keywords AS (SELECT row_number() OVER (ORDER BY n) AS keyword_id, term, n AS term_norm FROM (SELECT n, min(k) AS term FROM kx WHERE length(n) >= 3 GROUP BY n)),
doc_keywords AS (SELECT doc_id, keyword_id, CAST(1.0 AS DOUBLE) AS score FROM kx JOIN keywords ON term_norm = n)
"""


@query("a05_w01_authors", f"WITH {PAPERS_SQL} SELECT author_id, name, name_norm FROM authors")
def authors(spark, sf_dir):
    return G.authors(papers(spark, sf_dir))


@query("j02_doc_authors", f"WITH {PAPERS_SQL} SELECT doc_id, author_id, position FROM doc_authors")
def doc_authors(spark, sf_dir):
    docs = papers(spark, sf_dir)
    return G.doc_authors(docs, G.authors(docs))


@query("a06_w01_topics", "SELECT row_number() OVER (ORDER BY t) AS topic_id, t AS name FROM (SELECT DISTINCT lower(p_type) AS t FROM part)")
def topics(spark, sf_dir):
    return G.topics(papers(spark, sf_dir))


@query("j03_doc_topics", "WITH t AS (SELECT row_number() OVER (ORDER BY t) AS topic_id, t FROM (SELECT DISTINCT lower(p_type) AS t FROM part)) SELECT CAST(p_partkey AS VARCHAR) AS doc_id, topic_id FROM part JOIN t ON t = lower(p_type)")
def doc_topics(spark, sf_dir):
    docs = papers(spark, sf_dir)
    return G.doc_topics(docs, G.topics(docs))


@query("a05_companies", f"WITH {PAPERS_SQL} SELECT company_id, name, name_norm FROM companies")
def companies(spark, sf_dir):
    return G.companies(papers(spark, sf_dir))


@query("j03_doc_companies", f"WITH {PAPERS_SQL} SELECT doc_id, company_id FROM doc_companies")
def doc_companies(spark, sf_dir):
    docs = papers(spark, sf_dir)
    return G.doc_companies(docs, G.companies(docs))


@query("a05_keywords", f"WITH {PAPERS_SQL} SELECT keyword_id, term, term_norm FROM keywords")
def keywords(spark, sf_dir):
    return G.keywords(papers(spark, sf_dir))


@query("j04_doc_keywords", f"WITH {PAPERS_SQL} SELECT doc_id, keyword_id, score FROM doc_keywords")
def doc_keywords(spark, sf_dir):
    docs = papers(spark, sf_dir)
    return G.doc_keywords(docs, G.keywords(docs))


@query("j09_papers_by_author", f"WITH {PAPERS_SQL} SELECT DISTINCT title, rel_path, year FROM papers JOIN doc_authors USING (doc_id) JOIN authors USING (author_id) WHERE name_norm = 'red' ORDER BY year DESC NULLS LAST, title, rel_path LIMIT 25")
def papers_by_author(spark, sf_dir):
    docs = papers(spark, sf_dir)
    nodes = G.authors(docs)
    return G.papers_by_author(docs, G.doc_authors(docs, nodes), nodes, "red")


@query(
    "j10_coauthors",
    f"""
    WITH {PAPERS_SQL} SELECT b.name AS coauthor, count(*) AS shared_papers FROM doc_authors e1 JOIN authors a ON a.author_id = e1.author_id JOIN doc_authors e2 ON e2.doc_id = e1.doc_id JOIN authors b ON b.author_id = e2.author_id
    WHERE a.name_norm = 'red' AND b.name_norm <> 'red' GROUP BY b.name ORDER BY shared_papers DESC, coauthor LIMIT 25
    """,
)
def coauthors(spark, sf_dir):
    docs = papers(spark, sf_dir)
    nodes = G.authors(docs)
    return G.coauthors(G.doc_authors(docs, nodes), nodes, "red")


@query("j06_company_counts", f"WITH {PAPERS_SQL} SELECT name, count(*) AS docs FROM companies JOIN doc_companies USING (company_id) GROUP BY name ORDER BY docs DESC, name LIMIT 100")
def company_counts(spark, sf_dir):
    docs = papers(spark, sf_dir)
    nodes = G.companies(docs)
    return G.company_counts(G.doc_companies(docs, nodes), nodes)


@query("j09_docs_by_company", f"WITH {PAPERS_SQL} SELECT DISTINCT title, topic, rel_path FROM papers JOIN doc_companies USING (doc_id) JOIN companies USING (company_id) WHERE name_norm = 'promo' ORDER BY topic, title, rel_path LIMIT 40")
def docs_by_company(spark, sf_dir):
    docs = papers(spark, sf_dir)
    nodes = G.companies(docs)
    return G.docs_by_company(docs, G.doc_companies(docs, nodes), nodes, "promo")


@query(
    "j10_related_by_keyword",
    f"""
    WITH {PAPERS_SQL} SELECT title, rel_path, count(*) AS shared_keywords FROM doc_keywords e1 JOIN doc_keywords e2 ON e2.keyword_id = e1.keyword_id JOIN papers ON papers.doc_id = e2.doc_id
    WHERE e1.doc_id = '5' AND e2.doc_id <> '5' GROUP BY title, rel_path ORDER BY shared_keywords DESC, title, rel_path LIMIT 15
    """,
)
def related_by_keyword(spark, sf_dir):
    docs = papers(spark, sf_dir)
    return G.related_by_keyword(docs, G.doc_keywords(docs, G.keywords(docs)), "5")


@query("a01_graph_counts", f"WITH {PAPERS_SQL} SELECT 'authors' AS name, count(*) AS n FROM authors UNION ALL SELECT 'companies', count(*) FROM companies UNION ALL SELECT 'doc_authors', count(*) FROM doc_authors UNION ALL SELECT 'keywords', count(*) FROM keywords")
def graph_counts(spark, sf_dir):
    docs = papers(spark, sf_dir)
    nodes = G.authors(docs)
    return G.counts({"authors": nodes, "companies": G.companies(docs), "doc_authors": G.doc_authors(docs, nodes), "keywords": G.keywords(docs)})
