"""Ordered rules that classify, select and drop; backlogs of work; volumes cut into papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import col, first_of

#: Folders and the words that send a document there, in order; the first that is found decides.
FOLDERS: list[tuple[str, list[str]]] = [
    ("Process Mining/Object-centric", ["object-centric", "object centric", "ocel", "ocpm", "multidimensional event", "event graph", "knowledge graph", "event knowledge graph", "pi graph"]),
    ("Process Mining/Discovery", ["process discovery", "discovery algorithm", "process model discovery", "alpha miner", "inductive miner", "functional dependency", "unique discovery", "tane"]),
    ("Process Mining/Conformance Checking", ["conformance", "alignment", "replay", "process model-log"]),
    ("Process Mining/Stochastic Process Mining", ["stochastic", "queueing", "queue mining", "markov"]),
    ("Process Mining/Simulation", ["simulation", "petri net", "colored petri", "cpn", "workflow net"]),
    ("Process Mining/AI", ["graph neural", "large language model", " llm", "machine learning", "deep learning", "neural network", "differentiable pooling", "embedding"]),
    ("Process Mining/Visual Analytics", ["visualization", "visual analytics", "graph drawing", "layout", "honvis"]),
    ("Process Mining/Architecture", ["scalability", "data structure", "dataframe", "event store", "architecture"]),
    ("Process Mining/Event Log extraction", ["event log extraction", "event data extraction", "event log generation"]),
    ("Process Mining/Resource Mining", ["resource mining", "organizational", "organisational"]),
    ("Process Mining/Uncertainty", ["uncertain", "probabilistic", "probability"]),
    ("Process Mining/Methodology", ["comparative process mining", "process mining methodology"]),
    ("Process Querying", ["query language", "sql", "sparql", "bpql", "process query", "pql", "query dependency", "querying structural"]),
    ("Process Modeling", ["bpmn", "process model", "workflow model", "case management", "artifact", "dcr graph", "ontology", "bounded context", "entity relationship", "entity-relationship", "data model", "relational model", "er model", "business process model", "declarative process"]),
    ("Engineering", ["software design", "philosophy of software"]),
]
#: Parts of file names that decide before the folders' words do.
NAME_RULES = [("taxonomy", "Process Mining/Object-centric"), ("sql_query", "Process Querying"), ("query_dependency", "Process Querying"), ("event_visual", "Process Mining/Visual Analytics")]
DEFAULT_FOLDER = "Inbox"
#: Topics for what lies outside the library's field.
GENERAL_TOPICS = ["Databases", "Graph Theory and Algorithms", "Machine Learning", "Cybernetics and Systems", "Software Engineering", "Reference and Textbooks"]


def classify(name: Column | str, title: Column | str, text: Column | str, folders: list[tuple[str, list[str]]] | None = None) -> Column:
    """The folder of a file: by its name, else by the first folder one of whose words stands in name, title or the first
    2,500 characters of the text."""
    low = F.lower(col(name))
    hay = F.concat_ws(" ", low, F.lower(col(title)), F.lower(F.substring(col(text), 1, 2500)))
    cases = [(T.suffix(low) == ".bpmn", F.lit("Process Modeling"))] + [(low.contains(part), F.lit(folder)) for part, folder in NAME_RULES]
    for folder, words in folders or FOLDERS:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(F.col("_hay"), F.lit(word))
        cases.append((found, F.lit(folder)))
    return first_of(*cases, otherwise=DEFAULT_FOLDER), hay


def classified(files: DataFrame, name: str = "name", title: str = "title", text: str = "text", folders=None) -> DataFrame:
    """files with `folder`.  The text that is searched is made once, not once for each word."""
    folder, hay = classify(name, title, text, folders)
    return files.withColumn("_hay", hay).withColumn("folder", folder).drop("_hay")


def has_term(hay: Column | str, term: str) -> Column:
    """Whether a term stands in small text with no word character or hyphen next to it."""
    import re

    return col(hay).rlike(rf"(?U)(?<![\w-]){re.sub(r'([^A-Za-z0-9 ])', r'\\\1', term)}(?![\w-])")


OFFICE = [".docx", ".pptx", ".xlsx"]


def is_internal_file(name: Column | str, sample: Column | str, strong: list[str], weak: list[str] = (), vendor: str | None = None) -> Column:
    """A strong marker, the vendor's name with a weak one, or an office file.  The markers are the library's own setting."""
    hay = F.lower(F.concat_ws(" ", col(name), col(sample)))
    out = T.suffix(name).isin(OFFICE)
    for term in strong:
        out = out | has_term(hay, term)
    if vendor:
        some = F.lit(False)
        for term in weak:
            some = some | has_term(hay, term)
        out = out | (F.contains(hay, F.lit(vendor)) & some)
    return out


#: Fixed value: posts that are only news about a product or a company.
NEWS = (
    r"(?i)(release[ -]?notes?|changelog|what'?s new in|\bv?\d+\.\d+(\.\d+)?\b.*(release|is (now )?(live|out|available|ga))|roadmap|is now live|"
    r"now generally available|announcing .*(community edition|driver|beta \d|alpha|\bGA\b)|we (raised|closed).*(seed|series|funding)|is hiring|"
    r"join us at|we'?re hiring)"
)


def is_news(title: Column | str, url: Column | str, extra: str | None = None) -> Column:
    slug = F.regexp_extract(F.regexp_replace(col(url), "/+$", ""), r"([^/]*)$", 1)
    out = col(title).rlike(NEWS) | slug.rlike(NEWS)
    return out | col(title).rlike(f"(?i){extra}") if extra else out


#: What marks an award, a journal and what is no paper in a list of publications.
AWARD = r"(?i)best[ -]?paper|best student paper|distinguished paper|test[ -]of[ -]time|outstanding paper|award"
JOURNAL = (
    r"(?i)IEEE Transactions|ACM Transactions|VLDB Journal|SIGMOD Record|ACM Computing Surveys|Journal of |International Journal of |"
    r"\bInformation Systems\b|Data (?:and|&) Knowledge Engineering|Distributed and Parallel Databases|Fundamenta Informaticae|Computers in Industry|"
    r"Decision Support Systems|Software and Systems Modeling|Formal Aspects of Computing|Business (?:and|&) Information Systems Engineering|"
    r"Knowledge and Information Systems|Computer Supported Cooperative Work|Real-Time Systems|Expert Systems with Applications|Applied Intelligence"
)
NO_PAPER = (
    r"(?i)PhD thesis|Master'?s thesis|Master Thesis|Computing Science Notes|Technical Report|BETA (?:Working Paper|report)|Working Paper|\(\s*eds?\.?\s*\)|"
    r"Preface|Editorial|book review|Habilitation|Dagstuhl Reports|\bposter\b|Tool (?:Demonstration|Demo)|Extended Abstract|Abstract of"
)


def publications(pages: DataFrame, html: str = "html", base: str = "") -> DataFrame:
    """(id, pdf, text, year, award, journal, exclude): the entries `<dt>id</dt>` of a page that link to a PDF.  The year is the
    latest in the entry's text; one in its tags, such as a file's name `2031.pdf`, counts only if the text has none."""
    ids = F.regexp_extract_all(F.col(html), F.lit(r"<dt>\s*(\w+)\s*</dt>"), F.lit(1))
    bodies = F.slice(F.split(html, r"<dt>\s*\w+\s*</dt>"), F.lit(2), F.size(ids))
    each = pages.select(F.explode(F.arrays_zip(ids.alias("id"), bodies.alias("body"))).alias("e")).select("e.id", "e.body")
    pdf = F.regexp_extract("body", r"(?i)href=[\x22']([^\x22']+\.pdf)[\x22']", 1)
    latest = lambda c: F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    each = each.withColumn("pdf", pdf).filter("pdf <> ''").withColumn("text", T.clean(T.strip_tags("body")))
    each = each.withColumn("year", F.coalesce(latest(F.col("text")), latest(F.col("body"))))
    pdf = F.when(F.col("pdf").rlike("^[a-z]+:"), F.col("pdf")).otherwise(F.concat(F.lit(base), F.col("pdf")))
    journal = F.col("text").rlike(JOURNAL) & ~F.col("text").rlike("(?i)proceedings")
    return each.select("id", pdf.alias("pdf"), "text", "year", F.col("text").rlike(AWARD).alias("award"), journal.alias("journal"), F.col("text").rlike(NO_PAPER).alias("exclude"))


def select_publications(entries: DataFrame, since: int = 2022) -> DataFrame:
    """Entries that aren't excluded and are recent, in a journal or awarded, with the reasons."""
    why = F.concat_ws("+", F.when(F.col("year") >= since, "recent"), F.when(F.col("journal"), "journal"), F.when(F.col("award"), "award"))
    return entries.filter(~F.col("exclude")).withColumn("reasons", why).filter("reasons <> ''")


def accept_topics(answers: DataFrame, existing: DataFrame) -> DataFrame:
    """answers (path, topic) with `accepted`: the topic if it is a folder of the library or a general one, else null."""
    spark = answers.sparkSession
    folders = existing.select(F.col("topic").alias("_t")).filter("_t <> 'Inbox' and not contains(_t, '(papers)') and not startswith(_t, 'Proceedings')")
    allowed = folders.unionByName(spark.createDataFrame([(t,) for t in GENERAL_TOPICS], "_t string")).distinct()
    told = answers.withColumn("_answer", F.regexp_replace(T.strip(F.coalesce("topic", F.lit(""))), "^/+|/+$", ""))
    return told.join(allowed, F.col("_answer") == F.col("_t"), "left").select(*answers.columns, F.col("_t").alias("accepted"))


# -- papers of a volume ------------------------------------------------------------------------------------------------

#: Fixed value: bookmarks that are never papers.
NO_BOOKMARK = (
    r"(?i)^\s*(preface|foreword|organization|committee|program committee|additional reviewers|reviewers|sponsors?|partners|contents|table of contents|"
    r"author index|subject index|index|editors?|message from|keynotes?|invited talks?|tutorials?|panels?|title\s?page|copyright|frontmatter|front matter|"
    r"back ?matter|in memoriam|acknowledge?ments?|list of (figures|tables)|abstracts?|.*\b(forum|workshop|doctoral consortium|demo track)\b\s*\d*\s*$)"
)
LEAST_VOLUME, LEAST_PAGES, MOST_PAGES, LEAST_PAPERS, LEAST_SANE = 100, 5, 80, 4, 0.8


def first_page_title(text: Column | str) -> Column:
    """The first line of a page that reads like a title: four words or more, no digit at its start, and no sign of front matter,
    addresses or authors.  Null without one."""
    lines = F.transform(F.split(text, T.LINES), T.clean)
    like = lambda x: (F.size(F.split(x, " ")) >= 4) & ~x.rlike(r"^\p{Nd}") & ~x.rlike(NO_BOOKMARK)
    people = lambda x: x.rlike(r"(?i)@|\.(edu|org|com|ac)\b|[A-Z]\d|\(B\)|,$")
    return F.get(F.filter(lines, lambda x: like(x) & ~people(x)), F.lit(0))


def paper_ranges(bookmarks: DataFrame, first_pages: DataFrame | None = None) -> DataFrame:
    """(volume, title, start, end) from bookmarks (volume, n_pages, pos, title, page, nested).

    Papers are entries that aren't front matter and, if any entry of the volume has a list below it, have one too.  Starts
    increase; a paper ends before the next one starts, the last with the volume.  Volumes of fewer than 100 pages, with
    fewer than four entries, or of whose ranges fewer than 80 % have 5 to 80 pages, are left whole; other ranges go.

    Titles that begin with a digit are codes: with first_pages (volume, page, text), a row for each page, they give way to what
    the paper's first page has for a title.
    """
    by_volume = Window.partitionBy("volume")
    df = bookmarks.withColumn("title", T.clean("title")).withColumn("_any", F.max("nested").over(by_volume))
    df = df.filter((F.col("n_pages") >= LEAST_VOLUME) & (F.col("title") != "") & ~F.col("title").rlike(NO_BOOKMARK) & (~F.col("_any") | F.col("nested")))
    df = df.withColumn("_n", F.count("*").over(by_volume)).filter(F.col("_n") >= LEAST_PAPERS)
    ordered = by_volume.orderBy("page", "pos")
    df = df.withColumn("_before", F.lag("page").over(ordered)).filter(F.col("_before").isNull() | (F.col("page") > F.col("_before")))
    df = df.withColumn("end", F.coalesce(F.lead("page").over(ordered) - 1, "n_pages"))
    sane = (F.col("end") - F.col("page") + 1).between(LEAST_PAGES, MOST_PAGES)
    df = df.withColumn("_sane", sane).withColumn("_share", F.avg(F.col("_sane").cast("int")).over(by_volume))
    out = df.filter((F.col("_share") >= LEAST_SANE) & F.col("_sane")).select("volume", "title", F.col("page").alias("start"), "end")
    if first_pages is None:
        return out
    told = first_pages.select("volume", F.col("page").alias("start"), first_page_title("text").alias("_told"))
    better = F.when(F.col("title").rlike(r"^\s*\d"), F.col("_told"))
    return out.join(told, ["volume", "start"], "left").select("volume", F.coalesce(better, "title").alias("title"), "start", "end")


# -- backlogs ----------------------------------------------------------------------------------------------------------


def merge_backlog(entries: DataFrame) -> DataFrame:
    """One row for each video of entries (video_id, url, title, channel, playlist, order): what is missing is filled by the
    first that knows it, and playlists are kept once, in order."""
    named = lambda c: F.get(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("order", F.col(c).alias("v"))))), lambda s: s["v"]), F.lit(0))
    lists = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("playlist").isNotNull(), F.struct("order", F.col("playlist").alias("v"))))), lambda s: s["v"]))
    out = entries.groupBy("video_id").agg(named("url").alias("url"), named("title").alias("title"), named("channel").alias("channel"), lists.alias("playlists"))
    return out.withColumn("url", F.coalesce("url", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id"))).withColumns({"status": F.lit("pending"), "attempts": F.lit(0)})


#: Errors after which a video is never tried again, and those that mean the client is blocked.
SKIP_ERRORS = ["TranscriptsDisabled", "NoTranscriptFound", "VideoUnavailable", "VideoUnplayable", "AgeRestricted", "InvalidVideoId"]
BLOCK_ERRORS = ["RequestBlocked", "IpBlocked", "YouTubeRequestFailed", "PoTokenRequired"]


def final_states(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(video_id, status, attempts, error) after attempts (video_id, n, error) in order; a null error is a success.

    Nothing is tried after done, skipped or failed.  A block counts as an attempt but decides nothing.
    """

    def step(s: Column, a: Column) -> Column:
        tried = s["attempts"] + F.when(a["error"].isNull(), 0).otherwise(1)
        status = first_of((a["error"].isNull(), "done"), (a["error"].isin(BLOCK_ERRORS), "pending"), (a["error"].isin(SKIP_ERRORS), "skipped"), (tried >= most, "failed"), otherwise="pending")
        error = F.when(a["error"].isin(BLOCK_ERRORS), s["error"]).otherwise(a["error"])
        new = F.struct(status.alias("status"), tried.alias("attempts"), error.alias("error"))
        return F.when(s["status"] == "pending", new).otherwise(s)

    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    ordered = attempts.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("n", "error"))).alias("a"))
    return ordered.select("video_id", F.aggregate("a", start, step).alias("s")).select("video_id", "s.status", "s.attempts", "s.error")


def backoffs(outcomes: Column | str, sleep: float = 2.0, most: int = 5) -> Column:
    """Seconds to wait after each outcome of a run (true: blocked), until `most` blocks follow each other and end it."""
    state = F.struct(F.lit(0).alias("n"), F.lit(sleep).alias("wait"), F.array().cast("array<double>").alias("out"), F.lit(False).alias("over"))

    def step(s: Column, blocked: Column) -> Column:
        n = F.when(blocked, s["n"] + 1).otherwise(0)
        wait = F.when(~blocked, F.lit(sleep)).when(n > 1, F.least(s["wait"] * 2, F.lit(900.0))).otherwise(F.least(F.greatest(F.lit(sleep), F.lit(15.0)), F.lit(900.0)))
        over = n >= most
        return F.when(s["over"], s).otherwise(F.struct(n.alias("n"), wait.alias("wait"), F.when(over, s["out"]).otherwise(F.concat(s["out"], F.array(wait))).alias("out"), over.alias("over")))

    return F.aggregate(col(outcomes), state, step, lambda s: s["out"])


def video_kind(url: Column | str) -> Column:
    """What an entry of the source list is: playlist, video, channel or a free query."""
    return first_of((T.playlist_id(url).isNotNull(), "playlist"), (T.video_id(url).isNotNull(), "video"), (T.channel_url(url).isNotNull(), "channel"), otherwise="query")
