from fathomline import cli
from fathomline.functions.vectors import HashEmbedder


def test_library(spark, tmp_path):
    root = tmp_path / "lib"
    texts = {"Literature/a/x.md": "# Red cats\ncats chase red mice", "Literature/Blogs/Acme/y.txt": "dogs bark at night", "Outbox/z.md": "# Cats\nred cats sleep", "Outbox/e.txt": " \n"}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    lib, embedder = cli.Library(spark, f"file://{tmp_path}/index"), HashEmbedder(64)
    run = lambda: {r["outcome"]: r["n"] for r in cli.index(lib, f"file:{root}", ["literature", "outbox"], embedder, "Outbox").collect()}
    assert run() == {"indexed": 3, "empty": 1, "pruned": 0, "skipped": 0}
    assert run() == {"indexed": 0, "empty": 0, "pruned": 0, "skipped": 4}
    (root / "Literature/a/x.md").write_text("# Red cats\nnow with more cats")
    (root / "Literature/Blogs/Acme/y.txt").unlink()
    assert run() == {"indexed": 1, "empty": 0, "pruned": 1, "skipped": 2}
    assert lib.read("documents").count() == 3
    top = cli.find(lib, "red cats", embedder, 5, False, None).collect()
    assert {r["title"] for r in top} == {"Red cats", "Cats"}
    assert {r["title"] for r in cli.find(lib, "red cats", embedder, 5, False, True).collect()} == {"Cats"}
    counts = {r["name"]: r["n"] for r in cli.build_graph(lib).collect()}
    assert counts["topics"] == 2
    cli.find(lib, "red cats", embedder, 5, True, None).collect()
    assert lib.read("postings").count() > 0
    total, topics = cli.stats(lib)
    assert total.first()["documents"] == 3 and topics.count() == 2


def test_long_texts_are_indexed_whole(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "Outbox").mkdir(parents=True)
    (root / "Outbox/book.txt").write_text("word " * 100_000 + "zebra")
    embedder = HashEmbedder(8)

    def indexed(name, *options):
        a = cli.parser().parse_args(["--index", f"file://{tmp_path}/{name}", "index", f"file:{root}", *options])
        lib = cli.Library(spark, a.index)
        cli.index(lib, a.root, ["outbox"], embedder, a.internal, a.limit, a.reset, a.max_chars)
        return lib.read("chunks")

    assert indexed("all").filter("text like '%zebra'").count() == 1
    some = indexed("some", "--max-chars", "5000")
    assert some.filter("text like '%zebra'").count() == 0 and 4 <= some.count() <= 5


def test_enrichment_and_manifest(spark, tmp_path):
    class Reader:
        """Answers about cats, and fails on others."""

        def complete(self, system: str, user: str) -> str:
            if "cats" not in user:
                raise OSError("down")
            return 'Here: {"title": "On Cats", "authors": ["Ann Lee"], "year": 2020, "keywords": ["Cats"]}'

    root = tmp_path / "lib"
    (root / "Outbox").mkdir(parents=True)
    for name, text in {"a.md": "red cats", "b.md": "dogs bark"}.items():
        (root / "Outbox" / name).write_text(text)
    lib = cli.Library(spark, f"file://{tmp_path}/index")
    cli.index(lib, f"file:{root}", ["outbox"], HashEmbedder(8), "Internal")
    run = lambda **options: dict(cli.enrich(lib, Reader(), **options).collect())
    assert run() == {"enriched": 1, "failed": 1}
    assert {r["title"] for r in lib.read("documents").collect()} == {"On Cats", "dogs bark"}
    assert run() == {"enriched": 0, "failed": 1}
    assert run(redo=True) == {"enriched": 1, "failed": 1}
    assert lib.read("doc_enrichment").count() == 1
    state = lambda **options: {r["part"]: r["state"] for r in cli.manifest(lib, f"file:{root}", **options).collect()}
    assert state(keep=True) == {"Outbox": "new"}
    assert state() == {"Outbox": "same"}
    (root / "Outbox/b.md").write_text("dogs sleep")
    assert state() == {"Outbox": "changed"}


def test_clients_by_name():
    assert isinstance(cli.chat_client("fathomline.functions.vectors:HashEmbedder"), HashEmbedder)
