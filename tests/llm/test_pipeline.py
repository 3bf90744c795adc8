from collections import Counter

import pytest
from pyspark.sql import functions as F
from support import CLASHES, components, corpus, words

import corpus_pipeline as pipeline
from fathomline.llm import neardup, packing, registry, tokens


def quality(texts):
    out = {}
    for i, t in texts.items():
        text = t or ""
        w = words(text)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(5)}
        symbols, size = sum(c in "#*$%&|<>" for c in text), sum(map(len, w))
        bad = len(w) < 10 or 100 * len(covered) > 20 * len(w) or 10 * symbols > len(w) or not 2 * len(w) <= size <= 15 * len(w)
        if not bad:
            out[i] = t
    return out


def written(spark, tmp_path, texts):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def left_over(texts):
    """What line dedup leaves, without what is left of copies."""
    from test_llm_operators import deduped

    whole = quality(texts)
    rest = lambda i, t, gone: gone and len(words(t)) < max(10, 0.2 * len(words(whole[i])))
    return {i: t for i, (t, _, gone) in deduped(whole).items() if not rest(i, t, gone)}


def test_near_copies_of_whole_texts_come_out_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = pipeline.STAGES[0][1](spark, docs, "").cache()
    groups = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(first).collect()}
    out = {r["doc_id"] for r in pipeline.run(spark, "/root/testdata/sf0.01").select("doc_id").distinct().collect()}
    assert out <= set(groups) <= set(texts)
    most = Counter(groups[i] for i in out)
    assert len(groups) - len(set(groups.values())) > 50 and max(most.values()) == 1
    alone = {i for i, n in Counter(groups.values()).items() if n == 1}
    assert len(alone - out) <= 0.01 * len(alone)


def test_a_run_leaves_only_what_its_result_reads(spark, tmp_path):
    import os

    from fathomline.llm import common

    folder = written(spark, tmp_path, corpus(20, seed=3))
    root = common.scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    pipeline.run(spark, folder).collect()
    left = {x.lstrip(".").split("-")[0] + "-" * ("pipeline" in x) + x.partition("-")[2].partition("-")[0] * ("pipeline" in x) for x in set(os.listdir(root)) - before}
    assert left <= {"pipeline-pii", "pseudonyms.key", "pseudonyms.key.crc", "encoded", "checkpoints"}


def test_pipeline_against_plain_stages(spark, tmp_path):
    from test_llm_operators import crc
    from tokenizers import Tokenizer

    texts = corpus(45, seed=7)
    folder = written(spark, tmp_path, texts)
    kept = left_over(texts)
    groups = components(kept)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    got = pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(kept)
    tokenizer = Tokenizer.from_file(tokens.default_path())
    for r in got:
        ids = [*tokenizer.encode(kept[r["doc_id"]], add_special_tokens=False).ids, packing.tokens.END]
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), crc(ids[r["start"] : r["start"] + r["length"]]))


@pytest.mark.parametrize("at", range(len(pipeline.STAGES)))
def test_stages_take_odd_tables(spark, at):
    name, stage = pipeline.STAGES[at]
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long), (1, long), (2, None), (3, ""), (None, long), (4, f"{long} and card 4349000490986231"), (5, "line " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    for column, value in CLASHES.items():
        docs = docs.withColumn(column, F.lit(value))
    out = stage(spark, docs, "")
    if at < len(pipeline.STAGES) - 1:
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == v for c, v in CLASHES.items())
            assert r["text"] is None or r["n_chars"] in (len(r["text"]), None)
    else:
        assert out.count() >= len(rows)
    assert stage(spark, docs.filter("false"), "").count() == 0


def test_stages_and_queries_are_registered():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "pii", "packing"]
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(registry.QUERIES) | {"pipeline"} <= set(known) and {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(known)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    a = registry.QUERIES[name](spark, data).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = con.sql(registry.ORACLE_SQL[name]).df().sort_values("doc_id").reset_index(drop=True)
    assert sorted(a.columns) == sorted(b.columns) and (a[b.columns] == b).all().all()
