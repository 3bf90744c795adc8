import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.functions import vectors as V
from fathomline.operators import chunking, enrichment, graph, retrieval, rules, tables


def chunked(spark, text, size, overlap):
    return spark.createDataFrame([(text,)], "t string").select(chunking.chunk_array("t", size, overlap).alias("c")).first()["c"]


@pytest.mark.parametrize(
    ("text", "size", "overlap", "expected"),
    [
        ("aa\n\nbb\n\ncccccccc", 8, 0, ["aa\n\nbb", "cccccccc"]),
        ("aa\n\nbb\n\ncccccccc", 8, 2, ["aa\n\nbb", "bb cccccccc"]),
        ("abcdefghij", 6, 2, ["abcdef", "ef efghij", "ij ij"]),
        (None, 6, 2, []),
        (" \n \n ", 6, 2, []),
    ],
)
def test_chunks(spark, text, size, overlap, expected):
    assert chunked(spark, text, size, overlap) == expected


def test_chunk_sizes(spark):
    import random

    r = random.Random(5)
    texts = ["".join(r.choice("ab é\n\n") for _ in range(r.randint(0, 300))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size, overlap in ((20, 5), (7, 0), (10, 12)):
        for row in df.select(chunking.chunk_array("t", size, overlap).alias("c")).collect():
            assert all(len(c) <= size + overlap + 1 for c in row["c"])


def test_page_chunks_stop_at_the_cap(spark):
    docs = spark.createDataFrame([(1, [(1, "aaaaa"), (2, "bbbbb"), (3, "ccccc")])], "doc_id int, pages array<struct<page: int, text: string>>")
    got = chunking.chunk_pages(docs, size=10, overlap=0, cap=8).orderBy("ordinal").collect()
    assert [(r["chunk_id"], r["page"], r["text"]) for r in got] == [("1:0", 1, "aaaaa"), ("1:1", 2, "bbbbb")]


def test_whole_texts_are_chunked(spark, tmp_path):
    import hashlib

    from fathomline.plans import registry

    lines = ["first " * 20, "", "b" * 700, *(f"line {i} " * 30 for i in range(40)), "the end"]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "short"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for page, line in enumerate(lines, 1):
        line = line.strip()
        cut = [line[i : i + 300] for i in range(0, len(line), 250)] if len(line) > 300 else [line] if line else []
        expected += [(page, c if not i else cut[i - 1][-50:] + " " + c) for i, c in enumerate(cut)]
    expected = [(1, n, page, hashlib.sha256(c.encode()).hexdigest()) for n, (page, c) in enumerate(expected)]
    got = registry.QUERIES["t02_w04_page_chunks"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [*expected, (2, 0, 1, hashlib.sha256(b"short").hexdigest())]


def test_whole_texts_reach_the_operators(spark, tmp_path):
    import hashlib
    import re
    import unicodedata

    from fathomline.plans import registry

    authors = "Ann Lee, Bo Yi, Cy Po, Di Fu, Ed Ng, Flo Marchand, Gustav Holm, Hanna Berg"
    texts = {1: "Ünï, ½ (Ærø) ﬁn.\n" * 100 + "the Ende-x_y.", 2: authors, 3: None, 4: "short"}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def norm(text, signs, by):
        s = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode("ascii")
        return re.sub(r"\s+", " ", re.sub(signs, by, s).lower()).strip()

    assert dict(run("f01_norm_name").collect()) == {i: sha(norm(t, r"[^\w\s.-]", "")) for i, t in texts.items()}
    assert dict(run("f02_norm_term").collect()) == {i: sha(norm(t, r"[^\w\s-]", " ")) for i, t in texts.items()}
    assert dict(run("f17_author_lines").collect())[2] == authors.replace(", ", "|")
    parts = [f"<!-- source: u{i} -->\n\n# t{i}\n\n{t}" for i, t in texts.items() if t is not None]
    got = run("k08_assembled").first()
    assert (got["n_pages"], got["text"]) == (4, sha("# \n" + "\n\n---\n\n".join(parts)))


def test_all_rows_reach_the_operators(spark, tmp_path):
    import hashlib
    import html
    import re

    from fathomline.plans import registry

    texts = [("en", "so The And, now"), ("fr", "é the and é"), ("de", "äthe and"), ("es", "Mention: onan"), ("es", "mention onanä"), ("fr", "the and-"), ("de", None)]
    spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [f"<html><title> {t}\n x</title><p a='b'>{t} <b>c</b>&copy;</p>" for t in ("A &amp; B", "plain", "&lt;i&gt; &eacute;", "R&D")]
    spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").write.parquet(f"{tmp_path}/pages.parquet")
    orders = [(o, o * 11 % 40, n) for o in range(1, 80) if o % 5 for n in (1, 2)]
    spark.createDataFrame(orders, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()

    def internal(text):
        hay = f"a.pdf {text or ''}".lower()
        has = lambda term: re.search(rf"(?<![\w-]){term}(?![\w-])", hay) is not None
        return has("the and") or "ention" in hay and has("onan")

    expected = {i: internal(t) for i, (_, t) in enumerate(texts)}
    assert dict(run("f16_internal_files")) == expected and set(expected.values()) == {True, False}
    title = lambda p: html.unescape(re.search("<title>([^<]*)", p)[1]).strip()
    assert dict(run("f27_title")) == {i: title(p) for i, p in enumerate(pages)}
    bare = lambda p: hashlib.sha256(html.unescape(re.sub("<[^>]+>", " ", p)).encode()).hexdigest()
    assert dict(run("f28_strip_tags")) == {i: bare(p) for i, p in enumerate(pages)}

    expected = set()
    for volume in {o // 8 for o, _, _ in orders}:
        marks = sorted((o % 8 * 18 + s % 32 + 1, o) for o, s, n in orders if n == 1 and o // 8 == volume)
        if len(marks) < 4:
            continue
        marks = [m for i, m in enumerate(marks) if not i or m[0] > marks[i - 1][0]]
        ends = [m[0] - 1 for m in marks[1:]] + [150]
        sane = [5 <= e - m[0] + 1 <= 80 for m, e in zip(marks, ends, strict=True)]
        if sum(sane) >= 0.8 * len(sane):
            expected |= {(volume, f"Paper {o}", page, e) for (page, o), e, ok in zip(marks, ends, sane, strict=True) if ok}
    assert set(map(tuple, run("t04_w03_paper_ranges"))) == expected and expected


def test_transcript(spark):
    told = [(0.0, "x" * 200), (10.0, " " + "y" * 200), (20.0, "z" * 50), (30.0, " ")]
    df = spark.createDataFrame([(told,)], "s array<struct<start: double, text: string>>")
    assert df.select(chunking.transcript_body("s").alias("x")).first()["x"] == f"[00:00] {'x' * 200} {'y' * 200}\n\n[00:20] {'z' * 50}"


def lists(spark, vector, lexical):
    make = lambda ids: spark.createDataFrame([(c, c, i + 1) for i, c in enumerate(ids)], "chunk_id string, doc_id string, rank int")
    return make(vector), make(lexical)


def test_fusion(spark):
    fused = retrieval.fuse(*lists(spark, "ab", "bc"))
    got = retrieval.best(fused, 10).collect()
    assert [r["chunk_id"] for r in got] == ["b", "a", "c"]
    assert math.isclose(got[0]["score"], 1 / 62 + 1 / 61)
    docs = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "doc_id string, internal boolean")
    left = retrieval.best(retrieval.allowed(fused, docs, True), 10).collect()
    assert [(r["chunk_id"], r["score"]) for r in left] == [("a", 1 / 61), ("c", 1 / 62)]


def test_fusion_ties_keep_the_vector_list_first(spark):
    assert [r["chunk_id"] for r in retrieval.best(retrieval.fuse(*lists(spark, "z", "a")), 5).collect()] == ["z", "a"]


@settings(max_examples=5, deadline=None)
@given(st.permutations("abcdef"))
def test_fusion_is_symmetric(spark, order):
    one, two = lists(spark, order, "fedcba")
    a = {r["chunk_id"]: round(r["score"], 12) for r in retrieval.fuse(one, two).collect()}
    b = {r["chunk_id"]: round(r["score"], 12) for r in retrieval.fuse(two, one).collect()}
    assert a == b


def test_vector_hits_are_exact(spark):
    rows = [(str(i), i, [float(i % 5), float(i % 3), 1.0]) for i in range(50)] + [("zero", 99, [0.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id int, embedding array<double>")
    q = [1.0, 2.0, 0.5]
    got = [r["chunk_id"] for r in retrieval.vector_hits(chunks, q, 100).orderBy("rank").collect()]
    cos = lambda v: sum(x * y for x, y in zip(v, q, strict=True)) / math.sqrt(sum(x * x for x in v)) / math.sqrt(sum(x * x for x in q))
    best = [r[0] for r in sorted(rows[:-1], key=lambda r: (round(1 - cos(r[2]), 12), r[0]))]
    assert len(got) == 50 and got[0] == best[0] and set(got) == set(best)


def test_neighbours(spark):
    seeds = spark.createDataFrame([("d1", 0.5)], "doc_id string, w double")
    similar = spark.createDataFrame([("d1", "d2", 0.8)], "doc_id string, other_id string, score double")
    authors = spark.createDataFrame([("d1", 7), ("d3", 7)], "doc_id string, author_id int")
    words = spark.createDataFrame([("d1", 9), ("d2", 9)], "doc_id string, keyword_id int")
    got = {r["doc_id"]: round(r["score"], 6) for r in retrieval.neighbours(seeds, similar, authors, words, 5).collect()}
    assert got == {"d2": 0.6, "d3": 0.3}


def test_index_and_scan_agree(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, "the cat sat"), ("b", 2, "the the dog"), ("c", 3, "nothing")], "chunk_id string, doc_id int, text string")
    index = retrieval.Bm25Index.build(chunks, str(tmp_path / "postings"))
    for q in ("the cat", "dog dog", "zzz", ""):
        assert index.search(q, 5).collect() == retrieval.bm25_hits(chunks, q, 5).collect()


def test_similar(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0])], "doc_id string, embedding array<double>")
    for block in (4096, 1):
        got = sorted(tuple(r) for r in graph.similar(graph.document_vectors(chunks), block=block).collect())
        assert got == [("a", "b", 1.0), ("b", "a", 1.0)]
    assert graph.similar(graph.document_vectors(chunks.filter("doc_id = 'a'"))).count() == 0


def test_similar_to_has_the_rows_of_similar(spark):
    import random

    r = random.Random(5)
    vectors = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(60)]
    vectors = graph.document_vectors(spark.createDataFrame([*vectors, (60, vectors[3][1]), (61, [0.0] * 4)], "doc_id long, embedding array<double>"))
    seeds = spark.createDataFrame([(3,), (17,), (61,), (99,)], "doc_id long")
    whole = graph.similar(vectors, 4, 0.3).join(seeds, "doc_id", "left_semi")
    pairs = lambda df: sorted((x["doc_id"], x["other_id"], round(x["score"], 6)) for x in df.collect())
    assert pairs(graph.similar_to(seeds, vectors, 4, 0.3)) == pairs(whole) and pairs(whole)
    assert graph.similar_to(seeds.filter("doc_id = 99"), vectors).count() == 0
    assert graph.similar_to(seeds, vectors.filter("doc_id < 0")).count() == 0


def test_expansion_makes_no_table_of_all_pairs(spark, monkeypatch):
    from fathomline.plans import registry, retrieval as plans

    def refused(*_, **__):
        raise AssertionError("all pairs of documents")

    run = lambda: sorted(map(tuple, registry.QUERIES["r11_search_expanded"](spark, "/root/testdata/sf0.001").collect()))
    with monkeypatch.context() as m:  # with the rows of the whole table
        m.setattr(plans.G, "similar_to", lambda seeds, vectors, **kw: graph.similar(vectors, **kw), raising=False)
        whole = run()
    monkeypatch.setattr(plans.G, "similar", refused)
    assert run() == whole and {r[8] for r in whole} == {"hybrid", "graph"}


def test_entities(spark):
    docs = spark.createDataFrame([("1", ["J. Doe"]), ("2", ["X", "j. doe"]), ("3", ["J. Doe", "j. doe"]), ("4", None)], "doc_id string, authors array<string>")
    nodes = graph.authors(docs)
    assert [(r["author_id"], r["name"], r["name_norm"]) for r in nodes.orderBy("author_id").collect()] == [(1, "J. Doe", "j. doe"), (2, "X", "x")]
    assert graph.doc_authors(docs, nodes).filter("doc_id = '3'").count() == 2


def test_upsert(spark):
    old = spark.createDataFrame([("h1", "p1", 1), ("h2", "p2", 2)], "doc_id string, path string, v int")
    new = spark.createDataFrame([("h3", "p1", 3)], "doc_id string, path string, v int")
    once = tables.upsert(old, new, ["doc_id", "path"])
    assert sorted(map(tuple, once.collect())) == [("h2", "p2", 2), ("h3", "p1", 3)]
    assert sorted(map(tuple, tables.upsert(once, new, ["doc_id", "path"]).collect())) == sorted(map(tuple, once.collect()))


def test_promote_keeps_what_enrichment_lacks(spark):
    docs = spark.createDataFrame([("1", "t", ["a"], 1999, None, True), ("2", "u", ["b"], 2000, None, True)], "doc_id string, title string, authors array<string>, year int, venue string, needs_review boolean")
    known = spark.createDataFrame([("1", None, [], None, "v")], "doc_id string, title string, authors array<string>, year int, venue string")
    got = {r["doc_id"]: tuple(r)[1:] for r in tables.promote(docs, known).collect()}
    assert got == {"1": ("t", ["a"], 1999, "v", False), "2": ("u", ["b"], 2000, None, True)}


def test_exact_duplicates(spark):
    batch = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "k")], "path string, hash string")
    library = spark.createDataFrame([("k",)], "hash string")
    assert {r["path"]: r["duplicate"] for r in tables.exact_duplicates(batch, library).collect()} == {"a": False, "b": True, "c": True}


def greedy(files, held):
    held, out = set(held), {}
    for path, keys in sorted(files):
        out[path] = bool(held & set(keys))
        if not out[path]:
            held |= set(keys)
    return out


def test_title_duplicates(spark):
    import random

    r = random.Random(3)
    cases = [([("f1", ["K1"]), ("f2", ["K1", "K2"]), ("f3", ["K2"])], [])]
    cases += [([(f"f{i:02}", [f"K{r.randint(0, 12)}" for _ in range(r.randint(0, 3))]) for i in range(25)], ["K0"]) for _ in range(2)]
    for files, held in cases:
        batch = spark.createDataFrame(files, "path string, keys array<string>")
        library = spark.createDataFrame([(k,) for k in held], "key string")
        assert {x["path"]: x["duplicate"] for x in tables.title_duplicates(batch, library).collect()} == greedy(files, held)


def test_unique_names(spark):
    rows = spark.createDataFrame([("/d", "A", ".pdf", 1), ("/d", "a", ".pdf", 2), ("/e", "A", ".pdf", 3)], "folder string, stem string, suffix string, order int")
    taken = spark.createDataFrame([("/d", "a (2).pdf")], "folder string, name string")
    got = {r["order"]: r["name"] for r in tables.unique_names(rows, taken).collect()}
    assert got == {1: "A.pdf", 2: "a (3).pdf", 3: "A.pdf"}


def test_classify_takes_the_first_rule(spark):
    df = spark.createDataFrame([("x.pdf", "Inductive Miner and conformance", "")], "name string, title string, text string")
    assert rules.classified(df).first()["folder"] == "Process Mining/Discovery"


def test_publication_years_are_those_of_the_text(spark, tmp_path):
    import duckdb

    from fathomline.plans import registry

    html = '<dl><dt>a</dt><dd>A, 2003 <a href="2031.pdf">pdf</a></dd><dt>b</dt><dd>B <a href="2019/b.pdf">pdf</a></dd><dt>c</dt><dd>C, 1998 to 2001 <a href="c.pdf">pdf</a></dd></dl>'
    got = rules.publications(spark.createDataFrame([(html,)], "html string")).collect()
    assert [(r["id"], r["pdf"], r["year"]) for r in got] == [("a", "2031.pdf", 2003), ("b", "2019/b.pdf", 2019), ("c", "c.pdf", 2001)]

    parts = [(k, "red part", f"Brand#{k % 3}", k % 50) for k in (*range(1890, 2110), *range(1, 40))]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = registry.QUERIES["s22_p12_publications"](spark, str(tmp_path)).select("id", "pdf", "year", "reasons").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.ORACLE_SQL["s22_p12_publications"]).fetchall())


def marks(spark, starts):
    return spark.createDataFrame([("v", 120, i, f"Paper {i}", s, False) for i, s in enumerate(starts)], "volume string, n_pages int, pos int, title string, page int, nested boolean")


def test_paper_ranges(spark):
    assert rules.paper_ranges(marks(spark, [11, 25, 25, 40])).count() == 0
    got = rules.paper_ranges(marks(spark, [11, 25, 40, 60])).orderBy("start").collect()
    assert [r["end"] for r in got] == [24, 39, 59, 120]


def test_backlog(spark):
    rows = [("v", None, None, None, None, 1), ("v", None, "T", None, "P", 2), ("v", None, "U", "C", "P", 3)]
    (got,) = rules.merge_backlog(spark.createDataFrame(rows, "video_id string, url string, title string, channel string, playlist string, order int")).collect()
    assert (got["title"], got["channel"], got["playlists"], got["url"]) == ("T", "C", ["P"], "https://www.youtube.com/watch?v=v")


def test_backoffs(spark):
    df = spark.createDataFrame([([True] * 5,), ([True, False, True],)], "o array<boolean>")
    assert [r["b"] for r in df.select(rules.backoffs("o").alias("b")).collect()] == [[15.0, 30.0, 60.0, 120.0], [15.0, 2.0, 15.0]]


def test_final_states(spark):
    rows = [("a", 1, "RuntimeError"), ("a", 2, "RuntimeError"), ("a", 3, "RuntimeError"), ("b", 1, "VideoUnavailable"), ("c", 1, "IpBlocked"), ("c", 2, None), ("c", 3, "RuntimeError")]
    got = {r["video_id"]: (r["status"], r["attempts"]) for r in rules.final_states(spark.createDataFrame(rows, "video_id string, n int, error string")).collect()}
    assert got == {"a": ("failed", 3), "b": ("skipped", 1), "c": ("done", 1)}


def test_retrying_client():
    waits, replies = [], iter([OSError(), enrichment.Refused(), "ok"])

    def send(system, user):
        x = next(replies)
        if isinstance(x, Exception):
            raise x
        return x

    renewed = []
    client = enrichment.RetryingClient(send, renew=lambda: renewed.append(1), wait=waits.append)
    assert client.complete("", "") == "ok" and waits == [1] and renewed == [1]


def test_embedding_cache(spark):
    class Counting(V.HashEmbedder):
        pass

    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, text string")
    cache = spark.createDataFrame([], "model string, text_hash string, embedding array<double>")
    found, fresh = tables.embed_cached(texts, cache, Counting(8))
    assert fresh.count() == 2 and found.count() == 3
    again, none = tables.embed_cached(texts, fresh, Counting(8))
    assert none.count() == 0 and again.count() == 3


def test_graph_degrades(spark):
    chunks = spark.createDataFrame([("1:0", 1, 0, 1, "red cat", [1.0, 0.0])], "chunk_id string, doc_id int, ordinal int, page int, text string, embedding array<double>")
    docs = spark.createDataFrame([(1, None, "p", None, False)], "doc_id int, title string, rel_path string, topic string, internal boolean")
    got = retrieval.search(chunks, docs, "cat", V.HashEmbedder(2), graph={}).collect()
    assert [(r["title"], r["topic"], r["via"]) for r in got] == [("(untitled)", "", "hybrid")]
    assert retrieval.search(chunks, docs, "cat", V.HashEmbedder(2), internal=True).count() == 0
    assert F is not None
