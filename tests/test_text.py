import pytest
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.functions import vectors as V


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (T.norm_name, "Jürgen  O'Neil", "jurgen oneil"),
        (T.norm_name, None, ""),
        (T.norm_term, "Petri-Net (coloured)", "petri-net coloured"),
        (T.guess_year, "1969, 1999, 2051, 2030", 2030),
        (T.guess_year, "none", None),
        (T.surname, "Jan van der Berg", "van der Berg"),
        (T.surname_import, "Jan van der Berg", "der Berg"),
        (T.surname, "2nd A. Name (B)", "Name"),
        (T.surname, " ", ""),
        (T.surname_import, "", "Unknown"),
        (T.company, "Literature/Blogs/DuckDB/p.md", "DuckDB"),
        (T.company, "Literature/X/p.md", ""),
        (T.video_id, "https://youtu.be/0DY543P6BzA", "0DY543P6BzA"),
        (T.playlist_id, "https://x.y/watch?v=a&list=RDx", None),
        (T.playlist_id, "https://x.y/playlist?list=PLabc", "PLabc"),
        (T.dashed_date, "20240131", "2024-01-31"),
        (T.dashed_date, None, "unknown"),
        (T.json_object, 'Sure: {"a":1} done', '{"a":1}'),
        (T.json_object, "[1]", "{}"),
        (T.json_object, "```json\n{\"a\": 2}\n```", '{"a":2}'),
        (T.json_object, "no", None),
        (T.slug, "", "untitled"),
        (T.slug, "Été: a/b?", "Ete ab"),
        (T.file_slug, "-- Title --", "Title"),
        (T.paper_url, "https://arxiv.org/abs/1234.5?x=1", "https://arxiv.org/pdf/1234.5"),
        (T.title_key, "Process-Mining: A  Survey!", "process mining a survey"),
        (T.stem, "/a/b.c/d.tar.gz", "d.tar"),
        (T.strip_tags, "<b>a</b> &amp; <i>b</i>", " a  &  b "),
        (T.is_boilerplate, "3rd Conference", True),
        (T.is_boilerplate_import, "a@b.c and d", True),
        (T.is_junk_stem, "Unknown - Some Title", True),
        (T.is_junk_stem, "Smith - Some Title", False),
        (T.is_junk_stem, "THE WHOLE TITLE IN CAPITALS", True),
    ],
)
def test_function(spark, f, given, expected):
    assert one(spark, f("v"), v=given if given is not None else F.lit(None).cast("string")) == expected


def test_entities_without_a_semicolon(spark):
    given = "<p>a &amp;&amp</p>&lt &copy;&copy2 &ampx; &#39;&#39 &eacute; R&D &amp;lt; &"
    assert one(spark, T.strip_tags("v", closed=True), v=given) == " a &&amp &lt ©&copy2 &ampx; '&#39 é R&D &lt; &"
    assert one(spark, T.strip_tags("v"), v=given) == " a && < ©©2 &x; '' é R&D &lt; &"


def test_f28_agrees_with_its_sql_on_cut_entities(spark, tmp_path):
    import duckdb

    from fathomline.plans import registry

    pages = [(1, "<h1>und&amp;&amp</h1><p>x</p>"), (2, "a &quot b &lt"), (3, "plain &amp; &copy;")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES["f28_strip_tags"](spark, str(tmp_path)).select("page_id", "bare").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.ORACLE_SQL["f28_strip_tags"]).fetchall())


def test_f27_agrees_with_its_sql_on_cut_entities(spark, tmp_path):
    import duckdb

    from fathomline.functions import html as H
    from fathomline.plans import registry

    pages = [(1, "<title>t</title><h1>und&amp;&amp</h1><p>x</p>"), (2, "<title>a &amp;amp; b &quot</title><p>x</p>"), (3, "<h1>\U000f0000 &amp; R&D &amp</h1>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES["f27_title"](spark, str(tmp_path)).select("page_id", "title").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.ORACLE_SQL["f27_title"]).fetchall())
    link = next(n for n in H.parse('<a href="/x?a=1&copy=2&amp;b=3">l</a>').walk() if n.tag == "a")
    assert link.attributes == {"href": "/x?a=1&copy=2&b=3"}


@pytest.mark.parametrize(("seconds", "expected"), [(65, "01:05"), (3725, "1:02:05"), (0.9, "00:00")])
def test_clock(spark, seconds, expected):
    assert one(spark, T.clock("v"), v=seconds) == expected


@pytest.mark.parametrize(("n", "expected"), [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (5 << 40, "5.0 TB"), (2 << 50, "2048.0 TB")])
def test_byte_size(spark, n, expected):
    assert one(spark, T.byte_size("v"), v=n) == expected


@pytest.mark.parametrize(("authors", "expected", "importer"), [(["A B"], "B", "B"), (["A B", "C D"], "B and D", "B and D"), (["A B", "C D", "E F"], "B et al.", "B et al."), ([], "", "Unknown"), ([" "], "", "Unknown")])
def test_author_label(spark, authors, expected, importer):
    assert one(spark, T.author_label("v"), v=authors) == expected
    assert one(spark, T.author_label("v", importer=True), v=authors) == importer


def test_desired_stem(spark):
    assert one(spark, T.desired_stem(F.lit("A: Title?"), "v"), v=["Ann Lee", "Bo Yi"]) == "Lee and Yi - A Title"


def test_functions_keep_normalised_values(spark):
    df = spark.createDataFrame([("Ünï  cödé (x.y)",), ("a-b_c",)], "v string")
    for f in (T.norm_name, T.norm_term, T.clean, T.title_key, T.slug):
        assert df.filter(f(f("v")) != f("v")).count() == 0


def test_hash_embedder(spark):
    (row,) = V.HashEmbedder(256).embed(["abc"])
    assert [i for i, x in enumerate(row) if x] == [114] and row[114] == 1.0
    assert V.HashEmbedder(256).embed(["", None]) == [[0.0] * 256] * 2
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    got = [r["e"] for r in df.select(V.HashEmbedder(16).column("t").alias("e")).collect()]
    assert got == V.HashEmbedder(16).embed(["a b a", "", ""])
    assert one(spark, V.bucket("v", 300), v="naïve") == int(__import__("hashlib").md5("naïve".encode()).hexdigest(), 16) % 300


def test_cosine_of_a_zero_vector_is_null(spark):
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_embedders(spark):
    import pickle

    from fathomline.functions import embedders as E

    local = E.LocalEmbedder("m", lambda: lambda texts: [[len(t), 1] for t in texts], passage="p:", query="query:")
    assert local.dim == 2 and local.embed(["ab"] * 130)[129] == [4.0, 1.0] and local.embed_query("a") == [7.0, 1.0]
    assert len(pickle.loads(pickle.dumps(E.HashEmbedder(8))).embed(["a"])[0]) == 8
    waits, fails = [], [1, 1]

    def send(model, texts):
        if fails:
            fails.pop()
            raise OSError
        return [[0.0] * 3 for _ in texts]

    remote = E.RemoteEmbedder("r", send, wait=waits.append)
    assert remote.dim == 3 and waits == [1, 2] and len(remote.embed(["x"] * 65)) == 65
    with pytest.raises(ValueError):
        E.get_embedder("none")
    with pytest.raises(ValueError):
        E.check_dim(2, remote)
    assert E.check_dim(None, E.get_embedder(dim=16)) == 16
