"""Pages, links and URL lists: what comes after fetching, over tables of fetched pages."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions.columns import col
from ..operators.graph import numbered
from ..scratch import written


def sitemap_urls(xml: Column | str) -> Column:
    """The <loc> entries; those without a protocol get https."""
    found = F.regexp_extract_all(col(xml), F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
    return F.transform(found, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u))


def hrefs(html: Column | str) -> Column:
    """The href values of anchors, in order, as they stand."""
    found = F.regexp_extract_all(col(html), F.lit(r"(?is)<a\s[^>]*?\bhref\s*=\s*(?:\x22([^\x22]*)\x22|'([^']*)')"), F.lit(0))
    value = lambda a: F.regexp_extract(a, r"(?is)\bhref\s*=\s*[\x22'](.*)[\x22']$", 1)
    return F.transform(found, value)


def absolute(base: Column | str, link: Column | str) -> Column:
    """RFC 3986 resolution; only relative links of the rarer kinds go through Python."""
    base, link = col(base), col(link)
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    simple = F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), link)).when(link.startswith("/") & ~link.contains("/."), F.concat(site, link))

    @F.pandas_udf("string")
    def join(b: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else urljoin(p, q) for p, q in zip(b, x, strict=True)])

    return F.coalesce(simple, join(F.when(simple.isNull(), base), F.when(simple.isNull(), link)))


def link_table(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, pos, link): each anchor's absolute address without fragment and query."""
    each = pages.select(F.col(url).alias("url"), F.posexplode(hrefs(html)).alias("pos", "raw"))
    return each.select("url", "pos", T.page_url(absolute("url", "raw")).alias("link"))


def toc_urls(pages: DataFrame, prefix: str = "", keep: str | None = None) -> DataFrame:
    """(url, pos, link) of contents pages: links below the prefix that the pattern finds."""
    links = link_table(pages).filter(F.col("link").startswith(prefix))
    return links.filter(F.col("link").rlike(keep)) if keep else links


def chapter_links(pages: DataFrame, keep: str, drop: str) -> DataFrame:
    """(url, link, pos): a contents page's links that match `keep` from their start and don't hold `drop`, each once at the
    place where it is first."""
    links = link_table(pages).filter(F.col("link").rlike(f"^(?:{keep})") & ~F.col("link").rlike(drop))
    return links.groupBy("url", "link").agg(F.min("pos").alias("pos"))


def blog_urls(urls: DataFrame, base: str, keep: str | None = None, drop: str | None = None, url: str = "url") -> DataFrame:
    """Distinct absolute URLs in order: those that match `keep` from their start and don't hold `drop`."""
    u = F.trim(F.col(url))
    df = urls.select(u.alias("url"))
    df = df.filter(F.col("url").rlike(f"^(?:{keep})")) if keep else df
    df = df.filter(~F.col("url").rlike(drop)) if drop else df
    return df.select(F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit(base.rstrip("/")), F.col("url"))).alias("url")).distinct().orderBy("url")


def ordered_urls(urls: DataFrame, prefer: str | None = None, drop: str | None = None, cap: int = 1000, url: str = "url") -> DataFrame:
    """The first `cap` distinct URLs, preferred ones before the others, each in order."""
    df = urls.select(F.col(url).alias("url")).distinct()
    df = df.filter(~F.col("url").rlike(drop)) if drop else df
    later = ~F.col("url").rlike(prefer) if prefer else F.lit(False)
    return df.orderBy(later, "url").limit(cap)


def crawl(seeds: DataFrame, links: DataFrame, prefix: str, cap: int, drop: str | None = None, prefer: bool = False, stage=None) -> DataFrame:
    """(url, depth): pages that the seeds reach over links (url, link) below the prefix, a level at a time, each page once.

    The budget is `cap` pages, twice that if an order of preference will choose among them; a level that passes it is cut
    in URL order.  Only pages that have been fetched, the urls of `links`, count.  `stage` cuts lineage between levels.

    Links between fetched pages are made once, as a table; a level joins them to its frontier, and only new pages are written.
    """
    cut = stage or (lambda df: written(df, "crawl"))
    budget = 2 * cap if prefer else cap
    inside = lambda c: F.col(c).startswith(prefix) & (~F.col(c).rlike(drop) if drop else F.lit(True))
    fetched = links.select("url").distinct()
    edges = links.select("url", F.regexp_replace(T.page_url("link"), "/+$", "").alias("link")).filter(inside("link")).distinct()
    edges = cut(edges.join(fetched.withColumnRenamed("url", "link"), "link", "left_semi").select("url", "link"))
    frontier = cut(seeds.select(T.page_url("url").alias("url")).filter(inside("url")).distinct().join(fetched, "url", "left_semi"))
    levels: list[DataFrame] = []
    n = 0
    while found := frontier.count():
        if n + found > budget:
            frontier = frontier.orderBy("url").limit(budget - n)
        levels.append(frontier.select("url", F.lit(len(levels)).alias("depth")))
        n += found
        if n >= budget:
            break
        seen = reduce(DataFrame.unionByName, levels).select("url")
        frontier = cut(edges.join(frontier, "url").select(F.col("link").alias("url")).distinct().join(seen, "url", "left_anti"))
    return reduce(DataFrame.unionByName, levels) if levels else frontier.withColumn("depth", F.lit(0))


def payload_markdown(html: Column | str, url: Column | str) -> Column:
    """struct(title, markdown) of a page that carries its Markdown as JSON in a script; empty without one."""
    data = F.regexp_extract(col(html), r"(?s)<script id=\x22__NEXT_DATA__\x22[^>]*>(.*?)</script>", 1)
    text = F.coalesce(T.strip(F.get_json_object(data, "$.props.pageProps.markdown")), F.lit(""))
    slug = F.initcap(F.regexp_replace(F.regexp_extract(F.regexp_replace(col(url), "/+$", ""), "([^/]*)$", 1), "-", " "))
    head = F.regexp_extract(text, r"(?m)^#[ \t]+(.+)", 1)
    return F.struct(F.when(data == "", "").when(head == "", slug).otherwise(F.trim(head)).alias("title"), text.alias("markdown"))


LEAST_DOC, LEAST_POST = 200, 500


def markdown_pages(pages: DataFrame, blog: bool = False, least: int | None = None) -> DataFrame:
    """pages with title, markdown and links, those whose Markdown is long enough."""
    made = pages.withColumn("page", H.page_column("html", blog)).select(*pages.columns, "page.*")
    return made.filter(F.length("markdown") >= (least if least is not None else LEAST_POST if blog else LEAST_DOC))


#: What stands between the pages of an assembled file, and the pages of one of its parts.
BETWEEN, PART = "\n\n---\n\n", 1000


def assembled(pages: DataFrame, source: str, header: Column | str, part: int = PART) -> DataFrame:
    """(source, part, n_pages, text): a Markdown file for each source, in parts of `part` pages: a header, then its pages in
    order, each after a comment that names where it is from.  pages: the source column, pos, url, title, markdown.  A source's
    parts with BETWEEN between them are its file; no row holds more pages than a part's.

    A null source is one, too; a page that lacks a value is counted and has no place in the text."""
    body = F.concat(F.lit("<!-- source: "), F.col("url"), F.lit(" -->\n\n# "), F.col("title"), F.lit("\n\n"), F.col("markdown"))
    each = pages.select(F.struct(F.col(source).alias("source"), "pos", "url").alias("_key"), body.alias("body"))
    placed = numbered(each, "_key", "_n").withColumn("source", F.col("_key.source"))
    begins = placed.groupBy(F.col("source").alias("_s")).agg(F.min("_n").alias("_first"))
    dealt = placed.join(begins, F.col("source").eqNullSafe(F.col("_s"))).withColumn("part", F.floor((F.col("_n") - F.col("_first")) / part).cast("int"))
    joined = dealt.groupBy("source", "part").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.struct("_n", "body"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["body"]), BETWEEN)
    return joined.select("source", "part", "n_pages", F.concat(F.when(F.col("part") == 0, col(header) if isinstance(header, str) else header).otherwise(""), text).alias("text"))
