"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Training uses at most SAMPLE labelled documents, the ones with the smallest hash of their id among those whose fold
(crc32 of the id as text, modulo FOLDS) isn't HELD_OUT; near copies, which share their smallest shingle hash, count once, with the label of the most.
From one part of them the lexicon is learned: words and word beginnings that toxic documents hold far more often, in any
language.  The features of a text are lexicon densities, how close lexicon words are to a second person, and rates of
capitals, punctuation and obfuscated words.  Trees are fitted to the first part, the calibration to the second.

Labels are the only other thing that is learned from; lang, source and doc_id are never inputs.  Only lexicon, trees and
calibration, all of bounded size, go to the executors, which score every row in one pass.

A null or empty text has zero for all features and gets their score.  Repeated rows each get a row; a null doc_id is
scored and belongs to no fold.  Without labelled documents of both kinds, every score is the share of toxic ones, 0 if
there are none.  Other columns are ignored.  An empty table has no scores.  A long text is one slice of its own, in memory
in proportion to it.  Nothing depends on the order or partitions of the rows: ties in the sample, the lexicon and the trees
are settled by ids, spelling and the features' order, so the same rows give the same scores bit for bit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import documents, id_text, stage

SAMPLE = 20_000
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
CUTOFF = 0.3
#: Terms of the lexicon, of which the sample bounds the number: in at least LEAST_DOCS toxic documents and 0.2 % of them, and
#: LEAST_ODDS (logarithm) more often than in others.
LEAST_DOCS, LEAST_ODDS = 3, 2.5
STEMS = (4, 5, 6)
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 80, 3, 0.15, 32, 5
NEAR = 4
#: Second-person pronouns of the four languages of the documents.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
#: Figures and signs that stand for letters.
LEET = str.maketrans("0134578@$!", "oieastbasi")
FEATURES = ("n_words", "hits", "density", "terms", "most", "odds", "near_second", "second", "capitals", "shouted", "exclamations", "punctuation", "obfuscated", "word_length")

#: Words, in training as in scoring.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W\d_]")


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def plain(word: str) -> tuple[str, bool]:
    """The word in small letters without signs at its ends, and whether letters in it were masked."""
    word = _EDGES.sub("", word.lower())
    if _INNER.search(word):
        bare = _INNER.sub("", word.translate(LEET))
        if bare and any(c.isalpha() for c in word):
            return unicodedata.normalize("NFC", bare), True
    return word, False


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)] if len(word) > 2 else []


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple] = field(default_factory=list)
    base: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    constant: float | None = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; equal ones are told apart by a thousandth of the trees' own."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = 1 / (1 + np.exp(-self.margin(x)))
        return np.clip(0.999 * np.interp(raw, *self.steps) + 0.001 * raw, 0, 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)
        return self.base + sum((_walk(t, binned) for t in self.trees), np.zeros(len(x)))


def _walk(tree: tuple, binned: np.ndarray) -> np.ndarray:
    features, cuts, values = tree
    node = np.zeros(len(binned), dtype=np.int64)
    for _ in range(DEPTH):
        right = binned[np.arange(len(binned)), features[node]] > cuts[node]
        node = 2 * node + 1 + right
    return values[node - (2**DEPTH - 1)]


def fit_trees(x: np.ndarray, y: np.ndarray, model: Model) -> None:
    """Newton boosting of the logistic loss with complete trees over binned features."""
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)], axis=1)
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), model.base)
    n_inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        features, cuts = np.zeros(n_inner, dtype=np.int64), np.full(n_inner, BINS, dtype=np.int64)
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            first = 2**depth - 1
            for k in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == k)
                if len(rows) >= 2 * LEAST_LEAF:
                    best = 1e-6
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for j in range(x.shape[1]):
                        b = binned[rows, j]
                        n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
                        gl = np.cumsum(np.bincount(b, g[rows], BINS))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], BINS))[:-1]
                        gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                        gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = -1
                        if gain.max() > best:
                            best, features[k], cuts[k] = gain.max(), j, int(gain.argmax())
                right = binned[rows, features[k]] > cuts[k]
                node[rows] = 2 * k + 1 + right
        leaf = node - n_inner
        values = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        model.trees.append((features, cuts, values))
        margin += values[leaf]


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and the non-decreasing share of ones at each."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, lowest and highest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    at = np.array([s for b in blocks for s in (b[2], b[3])])
    return at, np.repeat([b[0] / b[1] for b in blocks], 2)


def _slice_features(data: np.ndarray, offsets: np.ndarray, lexicon: dict[str, float]) -> np.ndarray:
    """rows x FEATURES.  What a word is, is found once for each distinct word of the slice."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)))
    starts, ends, counts = kernels.words(data, offsets)
    if not len(starts):
        return out
    border = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=border[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(border), pa.py_buffer(data[~kernels.SPACE[data]])).dictionary_encode()
    index = words.indices.to_numpy()
    distinct = words.dictionary.to_pylist()
    odds = np.zeros(len(distinct))
    kind = np.zeros((len(distinct), 4), dtype=bool)  # hit, second person, shouted, obfuscated
    for i, raw in enumerate(distinct):
        word, masked = plain(raw)
        if len(word) > 2:
            best = lexicon.get(word, 0.0)
            for n in STEMS:
                if len(word) > n:
                    best = max(best, lexicon.get(word[:n] + "*", 0.0))
            if best:
                odds[i] = best
                kind[i, 0] = True
                kind[i, 3] = masked
        if word in SECOND_PERSON:
            kind[i, 1] = True
        kind[i, 2] = len(word) > 1 and raw.isupper()
    row = np.repeat(np.arange(rows), counts)
    n = np.maximum(counts, 1)
    per_row = lambda v: np.bincount(row, v, rows)
    hit = np.flatnonzero(kind[index, 0])
    second = np.flatnonzero(kind[index, 1])
    hits = per_row(kind[index, 0])
    if len(hit) and len(second):
        at = np.searchsorted(second, hit)
        after, before = second[np.minimum(at, len(second) - 1)], second[np.maximum(at - 1, 0)]
        close = ((abs(after - hit) <= NEAR) & (row[after] == row[hit])) | ((abs(hit - before) <= NEAR) & (row[before] == row[hit]))
        out[:, 6] = np.bincount(row[hit], close, rows) / n
    if len(hit):
        pairs = np.unique(row[hit].astype(np.int64) << 32 | index[hit])
        out[:, 3] = np.bincount(pairs >> 32, minlength=rows)
        most = np.zeros(rows)
        np.maximum.at(most, row[hit], odds[index[hit]])
        out[:, 4] = most
    out[:, 0] = np.log1p(counts)
    out[:, 1] = np.log1p(hits)
    out[:, 2] = hits / n
    out[:, 5] = per_row(odds[index]) / np.sqrt(n)
    out[:, 7] = per_row(kind[index, 1]) / n
    byte_sum = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    size = np.maximum(np.diff(offsets), 1)
    out[:, 8] = byte_sum((data >= 65) & (data <= 90)) / size
    out[:, 9] = per_row(kind[index, 2]) / n
    out[:, 10] = byte_sum(data == 33) / size
    out[:, 11] = byte_sum((data > 32) & (data < 48) | (data > 57) & (data < 65) | (data > 90) & (data < 97) | (data > 122) & (data < 127)) / size
    out[:, 12] = per_row(kind[index, 3]) / n
    out[:, 13] = np.bincount(row, ends - starts, rows) / n
    return out


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(fold, toxic, text) of at most about `sample` labelled rows, staged; one for each smallest shingle hash.

    Of near copies, the row with the smallest hash of its doc_id stands for all (then the smallest doc_id, then text), and is
    toxic if half of them or more are; so the same rows come out whatever the partitions.  Texts without words have no
    hash and each stand for themselves."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold()).filter(F.col("fold") != HELD_OUT)
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def smallest(batches):
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.uint64)
            some = np.zeros(len(batch), dtype=bool)
            for row, data, offsets in kernels.slices(batch.column("text")):
                hashes, border = kernels.shingles(data, offsets)
                full = np.flatnonzero(np.diff(border) > 0)
                if len(full):
                    out[row + full] = np.minimum.reduceat(hashes, border[full])
                    some[row + full] = True
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "fold", "toxic", "text")), pa.array(out.view(np.int64), mask=~some)], ["doc_id", "fold", "toxic", "text", "least"])

    joined = id_text(docs).join(known, "doc_id").select("doc_id", "fold", "toxic", "text")
    marked = joined.mapInArrow(smallest, "doc_id long, fold long, toxic int, text string, least long")
    order = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "text")
    alone = F.when(F.col("least").isNull(), F.col("doc_id"))
    first = marked.groupBy("least", alone.alias("alone")).agg(F.min(F.struct(order.alias("order"), "fold")).alias("first"), (2 * F.sum("toxic") >= F.count("*")).cast("int").alias("toxic"))
    return stage(first.select("first.fold", "toxic", "first.order.text"), "toxicity-sample")


def _learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """The terms and their log odds, from document counts over the sample, which bounds their number."""

    def count(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for term in {t for w in set(_WORD.findall(text)) for t in terms_of(plain(w)[0])}:
                    seen.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["term", "toxic", "clean"])

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    terms = sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    least = max(LEAST_DOCS, 0.002 * n.get(1, 0))
    rate = lambda x, whole: (x + 0.5) / (whole + 1)
    odds = lambda r: math.log(rate(r["toxic"], n.get(1, 0)) / rate(r["clean"], n.get(0, 0)))
    found = {r["term"]: odds(r) for r in terms.filter(F.col("toxic") >= least).collect()}
    return {term: found[term] for term in sorted(found) if found[term] >= LEAST_ODDS}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = _sampled(docs, labels, sample)
    first = rows.filter(F.col("fold") != CALIBRATION)
    model = Model(lexicon=_learn_lexicon(first))
    lexicon = model.lexicon

    def features(batches):
        for batch in batches:
            x = np.concatenate([_slice_features(d, o, lexicon) for _, d, o in kernels.slices(batch.column("text"))]) if len(batch) else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["fold", "toxic", "x"])

    # At most about `sample` rows of FEATURES numbers.
    table = rows.mapInArrow(features, "fold long, toxic int, x array<double>").toPandas()
    if not len(table) or table.toxic.nunique() < 2:
        model.constant = float(table.toxic.mean()) if len(table) else 0.0
        return model
    x, y = np.array(table.x.tolist()), table.toxic.to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))
    x, y, calibrate = x[order], y[order], (table.fold.to_numpy() == CALIBRATION)[order]
    if len(set(y[~calibrate])) < 2 or len(set(y[calibrate])) < 2:
        calibrate = np.zeros(len(y), dtype=bool)
    fit_trees(x[~calibrate], y[~calibrate], model)
    part = calibrate if calibrate.any() else ~calibrate
    model.steps = isotonic(1 / (1 + np.exp(-model.margin(x[part]))), y[part])
    model.constant = None
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names = batch.column("doc_id")
            for row, data, offsets in kernels.slices(batch.column("text"), 4 << 20):
                score = sent.value.score(_slice_features(data, offsets, sent.value.lexicon))
                yield pa.RecordBatch.from_arrays([names.slice(row, len(score)), pa.array(score)], ["doc_id", "score"])

    out = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
