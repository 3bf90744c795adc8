import io
import json
import shutil
import zipfile

from pyspark.sql import functions as F

from fathomline.functions import html as H
from fathomline.operators import rules
from fathomline.sources import files, lists, web
from fathomline.streaming import incremental


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_readers():
    assert files.read_document("a.md", b"\n# The  Title\ntext 1999")["title"] == "The Title"
    assert files.read_document("a.txt", b"")["pages"] == []
    notebook = {"cells": [{"cell_type": "code", "source": ["x = 1"]}, {"cell_type": "markdown", "source": ["intro\n", "# Head"]}]}
    got = files.read_document("n_b.ipynb", json.dumps(notebook).encode())
    assert (got["title"], got["pages"][0]["text"]) == ("Head", "x = 1\n\nintro\n# Head")
    bpmn = files.read_document("p.bpmn", b'<bpmn:process id="1" name="Order"><task name="Pay"/><task name="Pay"/><task name="Ship"/>')
    assert (bpmn["title"], bpmn["pages"][0]["text"]) == ("Order", "Order\nPay\nShip")
    epub = files.read_document("b.epub", packed(**{"c.opf": "<dc:title>T</dc:title><dc:creator>A B</dc:creator>", "x.html": "<p>one</p><p>two</p>"}))
    assert (epub["title"], epub["authors"], epub["pages"][0]["text"]) == ("T", ["A B"], "one two")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = files.read_document("d.docx", packed(**{"word/document.xml": f"<w:document {w}><w:p><w:r><w:t>Head</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Bo</w:t></w:r><w:r><w:t>dy 2001</w:t></w:r></w:p></w:document>"}))
    assert (docx["title"], docx["year"], docx["pages"][0]["text"]) == ("Head", 2001, "Head\n\nBody 2001")
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    slide = lambda t: f"<p:sld {a}><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sld>"
    pptx = files.read_document("s.pptx", packed(**{"ppt/slides/slide2.xml": slide("B"), "ppt/slides/slide1.xml": slide(""), "ppt/slides/slide10.xml": slide("C")}))
    assert (pptx["title"], [p["page"] for p in pptx["pages"]]) == ("B", [2, 3])


def test_a_file_never_fails_the_job():
    assert files.read_document("x.xyz", b"")["extraction_confidence"] == 0.0
    got = files.read_document("x.docx", b"no zip")
    assert got["needs_review"] and got["abstract"].startswith("[extract error")


def test_pdf_record():
    pages = [(1, "3rd Workshop\nmail@x.org here now\nA Real Title Here\n1998 and 2003")]
    got = files.pdf_record("stem", pages, 3, None, "A. One, B. Two")
    assert (got["title"], got["authors"], got["year"], got["extraction_confidence"]) == ("A Real Title Here", ["A. One", "B. Two"], 2003, 0.8)
    assert files.pdf_record("stem", [], 0, "Untitled", None)["needs_review"]


def test_author_lines(spark):
    cases = [
        (["Title", "University of X", "a@b.org", "1st International Workshop", "Ann Lee, Bo Yi and Cy Po", "Abstract: x", "No One"], ["Ann Lee", "Bo Yi", "Cy Po"]),
        (["T", "Ann Lee", "Bo Yi", "Abstract x", "No One"], ["Ann Lee", "Bo Yi"]),
        (["T", "Abstract", "Ann  Lee"], ["Ann Lee"]),  # a bare heading is boilerplate and ends nothing
        (["T", *[f"A{i} B" for i in range(9)], "C D, E F"], [f"A{i} B" for i in range(6)]),
        (["T", ", ".join(f"A{i} B" for i in range(12))], [f"A{i} B" for i in range(8)]),
        (["T", "a b c d e f g, h i j k l m n", "Ann Lee"], ["Ann Lee"]),
        (["T", *["one long line of many words here"] * 11, "Too Late"], []),
        (["T"], []),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x array<string>")
    got = {r["i"]: r["a"] for r in df.select("i", files.author_lines("x", F.lit(0)).alias("a")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_biblio(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = packed(**{"word/document.xml": f"<w:document {w}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:document>", "docProps/core.xml": "<c><title>A Title</title><creator>Ann Lee</creator></c>"})
    rows = [("/l/a.md", b"# A Title Here\n\nno"), ("/l/b.txt", b"Some Work\nAnn Lee and Bo Yi\nAbstract: x\nNo One"), ("/l/c.docx", b"no zip"), ("/l/d.docx", docx), ("/l/e.xyz", b"")]
    got = {r["path"][3]: (r["biblio"]["title"], r["biblio"]["authors"]) for r in files.biblio(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert got == {"a": ("A Title Here", []), "b": ("Some Work", ["Ann Lee", "Bo Yi"]), "c": ("c", []), "d": ("A Title", ["Ann Lee"]), "e": ("e", [])}


def test_broken_books_and_notebooks():
    assert files.read_document("a_b.epub", b"no zip")["title"] == "a b" and files.read_document("a_b.epub", packed(x="y"))["pages"] == []
    assert files.read_document("a_b.ipynb", b'{"cells": []}')["title"] == "a b"
    assert files.read_document("p.bpmn", b'<task name="x"/><process id="1">')["title"] == "p"


def test_deep_pages():
    assert H.to_markdown(H.parse("<div>" * 5000 + "deep")) == "deep\n"
    assert H.to_markdown(H.parse("<span>a<b>b</b>c</span>")) == "c\n"


def test_listing_and_documents(spark, tmp_path):
    root = tmp_path / "lib"
    for name, text in {"Literature/a/x.md": "# X", "Literature/.hidden.md": "h", "Inbox/y.txt": "Y", "Inbox/z.bin": "z"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "Literature/v.pdf").write_bytes(b"%PDF")
    (root / "Literature/v (papers)").mkdir()
    (root / "Literature/v (papers)/1.pdf").write_bytes(b"%PDF")
    got = {r["path"].rpartition("/")[2] for r in files.list_files(spark, str(root)).select("path").collect()}
    assert got == {"x.md", "y.txt", "1.pdf"}
    docs = files.documents(files.list_files(spark, str(root), [".md", ".txt"]), f"file:{root}")
    rows = {r["rel_path"]: (r["source"], r["topic"], r["title"]) for r in docs.collect()}
    assert rows == {"Literature/a/x.md": ("Literature", "a", "X"), "Inbox/y.txt": ("Inbox", "Inbox", "Y")}


def test_markdown():
    page = (
        "<html><head><title>Site title | Site</title></head><body><nav>no</nav><main><h1> A  head</h1><div>lead<p>One <b>two</b> three.</p>tail</div>"
        "<ul><li>x</li><li>y</li></ul><ol><li>z</ol><table><tr><th>a</th><th>b</th></tr><tr><td>1<td>2</table><pre>code\n</pre><blockquote>q</blockquote>"
        "<div class='sidebar'>no</div><script>no()</script></main></body></html>"
    )
    root = H.parse(page)
    assert H.title(root) == "A head"
    want = "# A  head\n\nlead\nOne two three.\ntail\n- x\n- y\n\n1. z\n\na | b\n1 | 2\n\n```\ncode\n```\n\n> q\n"
    assert H.to_markdown(H.content(root)).replace("# A head", "# A  head") == want
    assert H.title(H.parse("<title>Only | Site</title>")) == "Only"
    assert H.blog_title(H.parse("<title>One - Two - Three</title>")) == "One"


def test_crawl(spark):
    links = spark.createDataFrame([("s/1", "s/2"), ("s/1", "t/9"), ("s/2", "s/3#x"), ("s/3", "s/1"), ("s/2", "s/4")], "url string, link string")
    got = {r["url"]: r["depth"] for r in web.crawl(spark.createDataFrame([("s/1",)], "url string"), links, "s/", 10).collect()}
    assert got == {"s/1": 0, "s/2": 1, "s/3": 2}
    assert web.crawl(spark.createDataFrame([("s/1",)], "url string"), links, "s/", 2).count() == 2


def test_urls(spark):
    df = spark.createDataFrame([("b/sql",), ("a/x",), ("c/sql",), ("a/x",)], "url string")
    assert [r["url"] for r in web.ordered_urls(df, prefer="sql", cap=2).collect()] == ["b/sql", "c/sql"]
    pairs = [("https://h.org/a/b.html", "../c"), ("https://h.org/a/b.html", "/d"), ("https://h.org/a/b.html", "//x.org/e"), ("https://h.org/a/b.html", "f?g")]
    got = spark.createDataFrame(pairs, "b string, l string").select(web.absolute("b", "l").alias("x")).collect()
    assert [r["x"] for r in got] == ["https://h.org/c", "https://h.org/d", "https://x.org/e", "https://h.org/a/f?g"]


def test_versions(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "a int")
    lists.write_versioned(one, str(tmp_path / "t"))
    lists.write_versioned(one.unionByName(one), str(tmp_path / "t"))
    assert lists.read_versioned(spark, str(tmp_path / "t")).count() == 2


def test_manifest(spark):
    rows = [("/r/a/x", 3, bytearray(b"abc")), ("/r/a/y", 1, bytearray(b"d")), ("/r/b/z", 0, bytearray())]
    df = spark.createDataFrame(rows, "path string, length long, content binary")
    now = lists.manifest(df, "/r")
    assert {r["part"]: (r["files"], r["bytes"]) for r in now.collect()} == {"a": (2, 4), "b": (1, 0)}
    before = lists.manifest(df.filter("path <> '/r/a/y'"), "/r")
    assert {r["part"]: r["state"] for r in lists.drift(now, before).collect()} == {"a": "changed", "b": "same"}


def test_incremental_index(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    extract = lambda batch: batch.select(F.sha2("content", 256).alias("doc_id"), "path", F.decode("content", "UTF-8").alias("text"))
    run = lambda: incremental.index_files(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "c"), extract, ["doc_id", "path"]).awaitTermination()
    run()
    (folder / "b.txt").write_text("two")
    run()
    run()
    got = lists.read_versioned(spark, str(tmp_path / "t")).select("text").collect()
    assert sorted(r["text"] for r in got) == ["one", "two"]


def test_event_counts_stream(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    shutil.copy(source, tmp_path)
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(str(tmp_path))
    q = incremental.event_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 1000


def test_video_kinds(spark):
    df = spark.createDataFrame([("https://youtu.be/0DY543P6BzA",), ("https://www.youtube.com/playlist?list=PL1",), ("https://www.youtube.com/@c/videos",), ("a query",)], "u string")
    assert [r["k"] for r in df.select(rules.video_kind("u").alias("k")).collect()] == ["video", "playlist", "channel", "query"]


def test_pdf_pages_are_read_whole(monkeypatch):
    import sys
    from types import SimpleNamespace

    pages = [SimpleNamespace(extract_text=lambda i=i: f"{i} " + "x" * 100_000) for i in range(9)]
    monkeypatch.setitem(sys.modules, "pypdf", SimpleNamespace(PdfReader=lambda data: SimpleNamespace(pages=pages, metadata=None)))
    assert len(files.read_document("a.pdf", b"")["pages"]) == 9
    assert len(files.read_document("a.pdf", b"", 100_000)["pages"]) == 2


def test_retry_states_over_batches(spark, tmp_path):
    attempts = [("a", 1, "IpBlocked"), ("a", 2, None), ("b", 1, "Odd"), ("b", 2, "Odd"), ("b", 3, "Odd"), ("c", 1, "VideoUnavailable")]
    for n in (1, 2, 3):
        rows = [(v, k, e) for v, k, e in attempts if k == n]
        spark.createDataFrame(rows, "video_id string, n int, error string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("video_id string, n int, error string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        got = {}
        keep = lambda batch, _: got.update({r["video_id"]: (r["status"], r["attempts"], r["error"]) for r in batch.collect()})
        incremental.retry_states(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider)
    assert got == {"a": ("done", 1, None), "b": ("failed", 3, "Odd"), "c": ("skipped", 1, "VideoUnavailable")}
