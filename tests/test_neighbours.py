"""The inverted file of vectors against all pairs in numpy."""

import numpy as np
import pytest

from fathomline.operators import graph, neighbours
from fathomline.operators.neighbours import VectorIndex

SCHEMA = "chunk_id string, doc_id long, embedding array<double>"


def brute(rows, asks, k):
    kept = [(c, np.array(v)) for c, _, v in rows if v is not None and np.linalg.norm(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in kept])
    out = {}
    for name, v in asks:
        far = np.round(1 - x @ (np.array(v) / np.linalg.norm(v)), 9)
        out[name] = [c for _, c in sorted((d, c) for d, (c, _) in zip(far, kept, strict=True))[:k]]
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_index_against_all_pairs(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    points = centres[rng.integers(0, 12, 300)] + rng.normal(scale=0.2, size=(300, 8))
    points[:100] = points[0]  # a third of all rows in one place
    rows = [(f"c{i:03d}", i, v.tolist()) for i, v in enumerate(points)] + [("none", 900, None), ("zero", 901, [0.0] * 8)]
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/ix")
    assert index.rows().count() == len(rows) and index.probes < len(index.centres)
    asks = [(c, v) for c, i, v in rows if v and i % 20 == 0]
    true = brute(rows, asks, 10)
    asked = spark.createDataFrame([*asks, ("nothing", [0.0] * 8), ("null", None)], "query_id string, vector array<double>")
    got = {}
    for r in index.search_all(asked, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert sum(len(set(got[q]) & set(t)) for q, t in true.items()) >= 0.9 * sum(map(len, true.values()))
    assert set(got) == set(true)
    whole = VectorIndex(spark, index.path, index.centres, len(index.centres))
    exact = {q: [] for q in true}
    for r in whole.search_all(asked, 10).orderBy("query_id", "rank").collect():
        exact[r["query_id"]].append(r["chunk_id"])
    assert exact == true
    name, vector = asks[-1]
    assert [r["chunk_id"] for r in whole.search(vector, 10).orderBy("rank").collect()] == true[name]


def test_similar_nearby(spark, tmp_path):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(6, 8))[rng.integers(0, 6, 80)] + rng.normal(scale=0.1, size=(80, 8))
    vectors = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(points)], "doc_id long, vector array<double>")
    pairs = lambda df: {(r["doc_id"], r["other_id"]) for r in df.collect()}
    true = pairs(graph.similar(vectors, 4, 0.5))
    assert len(true & pairs(neighbours.similar_nearby(vectors, f"file://{tmp_path}/ix", 4, 0.5))) >= 0.9 * len(true)


def test_empty_index(spark, tmp_path):
    index = VectorIndex.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/ix")
    assert index.search([1.0, 0.0], 5).count() == 0
    assert index.search_all(spark.createDataFrame([("a", [1.0])], "query_id string, vector array<double>"), 5).count() == 0
