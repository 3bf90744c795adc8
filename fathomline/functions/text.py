"""Text, name, path and URL functions.  All are column expressions but fold_ascii, for which Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .columns import col, first_of, idiv, let

WS = r"(?U)\s+"
#: White space as str.strip() knows it.
LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@F.pandas_udf(StringType())
def fold_ascii(s: pd.Series) -> pd.Series:
    """NFKD with everything that isn't ASCII left out; null stays null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def folded(c: Column | str) -> Column:
    """fold_ascii, run only for values that have other characters at all."""
    c = col(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), fold_ascii(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def clean(c: Column | str) -> Column:
    """White space runs as one space, none at the ends; null is empty."""
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), WS, " "))


def norm_name(c: Column | str) -> Column:
    """ASCII, small, without signs but `.`, `-` and `_`; null and empty give an empty string."""
    return clean(F.lower(F.regexp_replace(folded(F.coalesce(col(c), F.lit(""))), r"[^A-Za-z0-9_\s.-]", "")))


def norm_term(c: Column | str) -> Column:
    """As norm_name, but signs, `.` among them, become spaces."""
    return clean(F.lower(F.regexp_replace(folded(F.coalesce(col(c), F.lit(""))), r"[^A-Za-z0-9_\s-]", " ")))


def register(spark: SparkSession) -> None:
    """norm_name and norm_term for SQL; registering twice does no harm."""

    def name(s: pd.Series) -> pd.Series:
        return _norm(s, r"[^A-Za-z0-9_\s.-]", "")

    def term(s: pd.Series) -> pd.Series:
        return _norm(s, r"[^A-Za-z0-9_\s-]", " ")

    spark.udf.register("norm_name", F.pandas_udf(name, StringType()))
    spark.udf.register("norm_term", F.pandas_udf(term, StringType()))


def _norm(s: pd.Series, drop: str, by: str) -> pd.Series:
    ascii_ = s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())
    return ascii_.str.replace(drop, by, regex=True).str.lower().str.replace(r"\s+", " ", regex=True).str.strip()


# -- titles ------------------------------------------------------------------------------------------------------------

#: Headers that are no titles.
GENERIC_TITLE = (
    r"(?i)contents lists available|sciencedirect|latex template|springer nature \d|under consideration for publication|author.?s version|"
    r"this may be the|c documents and settings|^untitled|elsevier|^microsoft word|journal homepage|available online at|^proof$"
)
LEAST_KEY = 25


def title_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


def usable_key(key: Column | str) -> Column:
    return (F.length(col(key)) >= LEAST_KEY) & ~col(key).rlike(GENERIC_TITLE)


def title_keys(stem: Column | str, title: Column | str | None = None) -> Column:
    """The usable keys of a file: its stem, what follows the first ` - ` in it, and its title."""
    stem = col(stem)
    after = F.when(F.instr(stem, " - ") > 0, F.substr(stem, F.instr(stem, " - ") + 3, F.length(stem)))
    keys = [title_key(stem), title_key(after)] + ([title_key(title)] if title is not None else [])
    return F.array_distinct(F.filter(F.array(*keys), usable_key))


#: Titles that say nothing.
BOILERPLATE = ["untitled", "document", "microsoft word - document", "presentation"]
BOILERPLATE_READER = [*BOILERPLATE, "contents lists available at sciencedirect"]
BOILERPLATE_IMPORT = [*BOILERPLATE, "word document", "abstract", "introduction"]


def is_boilerplate(c: Column | str) -> Column:
    low = F.lower(clean(c))
    return (low == "") | low.isin(BOILERPLATE_READER) | low.startswith("microsoft word") | low.rlike(r"^[0-9]+(st|nd|rd|th)\s")


def is_boilerplate_import(c: Column | str) -> Column:
    """The importer's stricter test: also preprint stamps and short lines with an e-mail address."""
    low = F.lower(clean(c))
    short_mail = low.contains("@") & (F.size(F.split(low, " ")) <= 4)
    stamp = low.startswith("arxiv:") | low.rlike(r"^arxiv[\d.v\[\]\s]+")
    return (low == "") | low.isin(BOILERPLATE_IMPORT) | low.startswith("microsoft word") | stamp | low.rlike(r"^[0-9]+(st|nd|rd|th)\s+") | short_mail


def guess_year(c: Column | str) -> Column:
    """The latest year from 1970 to 2049 in the first 4,000 characters."""
    found = F.regexp_extract_all(F.substring(col(c), 1, 4000), F.lit(r"\b(19[7-9][0-9]|20[0-4][0-9])\b"), F.lit(1))
    return F.array_max(F.transform(found, lambda y: y.cast("int")))


def slug(c: Column | str, longest: int = 150, signs: str = r".,'()&-", ascii_only: bool = True) -> Column:
    """A file name part: only letters, digits, `_`, blanks and signs; cut at the last space within `longest`.

    signs: `.,'()&-`, or `.,'()-` for imported files and split volumes.  ascii_only False keeps other scripts.
    """
    text = F.coalesce(col(c), F.lit(""))
    text = folded(text) if ascii_only else text
    kept = r"(?U)[^\w\s" + signs.replace("-", r"\-") + "]"
    text = clean(F.regexp_replace(text, kept, ""))
    cut = let(F.substring(text, 1, longest), lambda t: F.when(F.instr(t, " ") > 0, F.regexp_replace(t, r" [^ ]*$", "")).otherwise(t))
    text = F.when(F.length(text) > longest, cut).otherwise(text)
    return F.when(text == "", "untitled").otherwise(text)


def file_slug(c: Column | str, longest: int = 150) -> Column:
    """The slug of renamed files, which also loses hyphens at its ends."""
    text = folded(F.coalesce(col(c), F.lit("")))
    text = clean(F.regexp_replace(text, r"[^A-Za-z0-9_\s.,'()&\-]", ""))
    text = F.trim(F.regexp_replace(text, "^-+|-+$", ""))
    cut = let(F.substring(text, 1, longest), lambda t: F.when(F.instr(t, " ") > 0, F.regexp_replace(t, r" [^ ]*$", "")).otherwise(t))
    text = F.when(F.length(text) > longest, cut).otherwise(text)
    return F.when(text == "", "untitled").otherwise(text)


# -- people ------------------------------------------------------------------------------------------------------------

#: Name particles, all that lead a family name, and the importer's, of which it takes one.
PARTICLES = ["van", "der", "de", "den", "von", "la", "le", "du", "dos", "da", "ter", "ten"]
PARTICLES_IMPORT = ["van", "der", "de", "den", "von", "la", "le", "du"]


def surname(c: Column | str) -> Column:
    """The last word with all particles before it."""
    name = F.regexp_replace(clean(c), r"\s*\(B\)\s*$", "")
    name = F.regexp_replace(name, r"(?i)^[0-9]+(st|nd|rd|th)?\s+", "")

    def tail(parts: Column) -> Column:
        # From the right: words are taken while the one before the last taken is a particle.
        flags = F.transform(F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), lambda p: F.regexp_replace(F.lower(p), r"^\.+|\.+$", "").isin(PARTICLES))
        run = F.aggregate(flags, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, f: F.struct((s["n"] + (s["on"] & f).cast("int")).alias("n"), (s["on"] & f).alias("on")), lambda s: s["n"])
        return F.array_join(F.slice(parts, F.size(parts) - run, run + 1), " ")

    return let(F.filter(F.split(name, " "), lambda p: p != ""), lambda parts: F.when(F.size(parts) == 0, "").otherwise(tail(parts)))


def surname_import(c: Column | str) -> Column:
    """The last word with one particle before it; `Unknown` for an empty name."""
    name = F.regexp_replace(clean(c), r"(?i)^[0-9]+(st|nd|rd|th)\s+", "")
    name = F.regexp_replace(name, r"\s*\(B\)\s*$", "")
    parts = lambda p: F.when(F.size(p) == 0, "Unknown").when((F.size(p) >= 2) & F.lower(F.get(p, F.size(p) - 2)).isin(PARTICLES_IMPORT), F.array_join(F.slice(p, F.size(p) - 1, 2), " ")).otherwise(F.get(p, F.size(p) - 1))
    return let(F.filter(F.split(name, " "), lambda x: x != ""), parts)


def author_label(authors: Column | str, importer: bool = False) -> Column:
    """`A`, `A and B` or `A et al.`; empty (importer: `Unknown`) without authors."""
    given = F.filter(F.coalesce(col(authors), F.array().cast("array<string>")), lambda a: a.isNotNull() & (strip(a) != ""))
    names = F.filter(F.transform(given, surname_import if importer else surname), lambda s: s != "")
    return let(
        names,
        lambda n: F.when(F.size(n) == 0, "Unknown" if importer else "").when(F.size(n) == 1, F.get(n, F.lit(0))).when(F.size(n) == 2, F.concat_ws(" and ", n)).otherwise(F.concat(F.get(n, F.lit(0)), F.lit(" et al."))),
    )


def desired_stem(title: Column | str, authors: Column | str) -> Column:
    label = author_label(authors)
    return let(F.struct(label.alias("l"), file_slug(title).alias("t")), lambda p: F.when(p["l"] == "", p["t"]).otherwise(F.concat(file_slug_ascii(p["l"]), F.lit(" - "), p["t"])))


def file_slug_ascii(c: Column) -> Column:
    """file_slug of a label, whose letters the label's own folding left as they are."""
    text = clean(F.regexp_replace(c, r"[^A-Za-z0-9_\s.,'()&\-]", ""))
    return F.when(text == "", "untitled").otherwise(F.substring(text, 1, 150))


def import_name(title: Column | str, authors: Column | str, suffix: Column | str) -> Column:
    signs = r".,'()-"
    return F.concat(slug(author_label(authors, importer=True), signs=signs), F.lit(" - "), slug(title, signs=signs), F.lower(col(suffix)))


#: What no author is called, and what no title holds.
JUNK_AUTHORS = [
    "unknown", "approach", "language", "the", "research", "ieee", "sciencedirect", "erp", "springer", "press", "apa", "abstract", "proceedings",
    "taka05", "team", "adminuser", "author", "editors", "editor", "et", "al",
]
JUNK_TITLE = (
    r"(?i)IEEETRANSACTIONS|ScienceDirect|Journal of Intelligent|Proceedings of the IEEE|\bLNCS\b|\.dvi\b|\bVol\b|\bNO\.\s*\d|\d{4}\.\d{4,}|978-3|"
    r"Semantic Web \d|Data Knowledge Engineering|Bulletin of|Springer Nature|-main\b|full-issue|^\d+$"
)
FRONT_MATTER = (
    r"(?i)(Conference Organization|Committee Structure|Table of Contents|^Preface|^Foreword|Author Index|^Proceedings of the \d|Front ?matter|Colophon)"
)


def is_junk_stem(stem: Column | str) -> Column:
    stem = col(stem)
    cut = F.instr(stem, " - ")
    author = F.when(cut > 0, F.substr(stem, F.lit(1), cut - 1)).otherwise("")
    title = F.when(cut > 0, F.substr(stem, cut + 3, F.length(stem))).otherwise(stem)
    low = F.lower(F.trim(author))
    bad_author = low.startswith("unknown") | F.get(F.split(low, r"\s+"), F.lit(0)).isin(JUNK_AUTHORS) | author.rlike(r"^\d") | ((F.length(low) == 1) & ~low.rlike(r"(?U)\w"))
    shouted = (F.length(title) > 12) & (F.upper(title) == title) & (F.lower(title) != title)
    return ((cut > 0) & bad_author) | title.rlike(JUNK_TITLE) | ((cut == 0) & title.rlike(r"\d") & (F.size(F.split(F.trim(title), r"\s+")) <= 2)) | shouted


# -- paths -------------------------------------------------------------------------------------------------------------

#: The folders of a library, in the order in which a path is held against them.
ROOTS = ("Literature", "Transcripts", "Outbox", "Inbox")
#: Fixed value: folders whose subfolder names a company.
COMPANY_PATH = r"^(?:\./)?(?:Literature/)?(?:Blogs|Tool & Competitor Documentation|Source Systems Knowledge|Specifications)/([^/]+)/"


def source_and_topic(path: Column | str) -> Column:
    """struct(source, topic) of a path relative to the library."""
    parts = F.split(col(path), "/")
    root, rest = F.get(parts, F.lit(0)), F.size(parts) - 1
    inner = F.array_join(F.slice(parts, 2, F.greatest(rest - 1, F.lit(0))), "/")
    known = root.isin(*ROOTS) & (rest > 0)
    topic = first_of(
        (~known, "Other"),
        (root == "Literature", F.when(rest > 1, inner).otherwise("(root)")),
        (root == "Transcripts", F.when(rest > 1, F.concat(F.lit("Transcripts/"), F.get(parts, F.lit(1)))).otherwise("Transcripts")),
        otherwise=root,
    )
    return F.struct(F.when(known, root).otherwise("Other").alias("source"), topic.alias("topic"))


def company(path: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(path), F.lit("")), COMPANY_PATH, 1)


def is_internal(path: Column | str, base: str) -> Column:
    """Whether a path is the folder `base` or lies below it."""
    return (col(path) == base) | col(path).startswith(base + "/")


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"[^/.](\.[^./]+)$", 1))


def stem(path: Column | str) -> Column:
    name = F.regexp_extract(col(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


# -- URLs --------------------------------------------------------------------------------------------------------------


def video_id(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(url), r"(?:v=|youtu\.be/|/shorts/|/embed/)([0-9A-Za-z_-]{11})", 1), F.lit(""))


def playlist_id(url: Column | str) -> Column:
    """Mixes (RD...), the watch list and the liked list don't count."""
    found = F.nullif(F.regexp_extract(col(url), r"[?&]list=([0-9A-Za-z_-]+)", 1), F.lit(""))
    return F.when(~(found.startswith("RD") | found.isin("WL", "LL")), found)


def channel_url(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(url), r"(https?://[^/]*youtube\.com/(?:@[^/?&#]+|channel/[^/?&#]+|c/[^/?&#]+|user/[^/?&#]+))", 1), F.lit(""))


def paper_url(url: Column | str) -> Column:
    """Abstract pages of preprints become their PDF; an access token goes."""
    url = F.trim(col(url))
    number = F.regexp_extract(url, r"^https?://arxiv\.org/abs/([^?#]+)", 1)
    plain = F.regexp_replace(F.regexp_replace(url, r"([?&])casa_token=[^&]*", "$1"), r"[?&]+$", "")
    return F.when(number != "", F.concat(F.lit("https://arxiv.org/pdf/"), number)).otherwise(plain)


def page_url(url: Column | str) -> Column:
    """Without fragment and query."""
    return F.regexp_extract(col(url), r"^([^#?]*)", 1)


def language_path(url: Column | str, languages: list[str]) -> Column:
    """Pages below /docs/<language>/ as the ones below /docs/."""
    return F.regexp_replace(col(url), rf"/docs/({'|'.join(languages)})/", "/docs/")


# -- times and sizes ---------------------------------------------------------------------------------------------------


def clock(seconds: Column | str) -> Column:
    """`MM:SS`, or `H:MM:SS` from an hour on."""
    s = F.floor(col(seconds)).cast("long")
    h, m, rest = idiv(s, 3600), idiv(s % 3600, 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%02d:%02d", m, rest))


def dashed_date(c: Column | str) -> Column:
    """`YYYYMMDD` with hyphens; `unknown` for anything of another length."""
    c = col(c)
    return F.when(F.length(c) == 8, F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))).otherwise("unknown")


def byte_size(n: Column | str) -> Column:
    """With one decimal; exact halves go to the even digit."""
    x = col(n).cast("double")
    units = ["B", "KB", "MB", "GB", "TB"]
    cases = [(x < 1024.0 ** (i + 1), F.format_string(f"%.1f {u}", F.bround(x / 1024.0**i, 1))) for i, u in enumerate(units[:-1])]
    return first_of(*cases, otherwise=F.format_string("%.1f TB", F.bround(x / 1024.0**4, 1)))


# -- results and records -----------------------------------------------------------------------------------------------


def snippet(c: Column | str, size: int = 300) -> Column:
    return F.substring(clean(c), 1, size)


def or_default(c: Column | str, default: str) -> Column:
    """Null and empty as the default."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def json_object(c: Column | str) -> Column:
    """The JSON object in a reply: without code fences, or its first {...} block; `{}` for other JSON, null for none."""
    text = strip(c)
    text = F.when(text.startswith("```"), strip(F.regexp_replace(text, r"(?is)^```(?:json)?\s*|\s*```$", ""))).otherwise(text)
    block = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    whole = lambda t: F.try_parse_json(t)
    found = F.coalesce(whole(text), whole(block))
    kind = F.schema_of_variant(found)
    return F.when(found.isNull(), F.lit(None)).when(kind.startswith("OBJECT"), F.to_json(found)).otherwise("{}")


def clean_authors(c: Column | str) -> Column:
    """Names of at most 80 characters and six words, the first 15 of them."""
    names = F.transform(F.coalesce(col(c), F.array().cast("array<string>")), strip)
    return F.slice(F.filter(names, lambda a: (a != "") & (F.length(a) <= 80) & (F.size(F.split(a, WS)) <= 6)), 1, 15)


def clean_keywords(c: Column | str) -> Column:
    terms = F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda k: F.lower(strip(k)))
    return F.slice(F.filter(terms, lambda k: k != ""), 1, 8)


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    import html

    return s.map(lambda x: None if x is None else html.unescape(x))


#: An `&` with the entity that it begins, if that ends in a semicolon.
REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def is_entity(name: str | None) -> bool:
    """Whether what follows an `&` is a number or known name with its semicolon."""
    return name is not None and (name[0] == "#" or name in html5)


@F.pandas_udf(StringType())
def unescape_closed(s: pd.Series) -> pd.Series:
    """HTML entities that end in a semicolon as characters; others, such as those of a text that was cut, stay."""
    import html

    one = lambda m: html.unescape(m[0]) if is_entity(m[1]) else m[0]
    return s.map(lambda x: None if x is None else REFERENCE.sub(one, x))


def strip_tags(c: Column | str, closed: bool = False) -> Column:
    """Tags as blanks and entities as characters, those without a semicolon too unless `closed`; only values with an `&` go
    through Python."""
    bare = F.regexp_replace(col(c), "<[^>]+>", " ")
    plain = unescape_closed if closed else unescape
    return F.when(bare.contains("&"), plain(F.when(bare.contains("&"), bare))).otherwise(bare)
