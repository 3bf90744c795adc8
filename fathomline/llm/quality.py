"""Quality rules as a ledger of bits.

Each rule is evaluated once for each document.  The ledger, a narrow table that is written once, keeps the measurements
and a bit for every failed rule, so policies are only masks over that table: a new version, or an ablation of each of its
rules, costs one bitwise aggregation and no second look at a text.  All of it is DataFrame expressions.

A null or empty text has no words, every measure is 0, and it fails `few_words`.  A null doc_id is kept as null.
Repeated rows each get their own ledger row.  Other columns of the input are ignored, so their names can't clash.  An
empty table has an empty ledger, whose ablation counts 0 for every rule.  A text is measured in its own task, in memory
that grows with its words; Spark's limit of 2 GB a value bounds it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACES, documents, stage

WINDOW = 5
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: name: whether a struct of measures fails it.  A rule's bit is its place; new rules go to the end.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda m: m["n_words"] < 10,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "repeated_lines": lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "word_length": lambda m: (m["n_words"] > 0) & ((m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
}


@dataclass(frozen=True)
class Policy:
    """A version's name and the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(rule) for rule in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
#: Repeated lines alone mark menus and verse as often as junk, so only the strict version counts them.
POLICY = Policy("2026-1", ("few_words", "repeated_windows", "symbols", "word_length"))
STRICT = Policy("2026-1-strict", tuple(RULES))


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def _let(value: Column, f) -> Column:
    """f(value) with value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _pairs(array: Column, f) -> Column:
    """f of each element and the next one; null after the last."""
    return F.zip_with(array, F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0))), f)


def _covered(windows: Column) -> Column:
    """Words in windows that are found twice or more.  Only texts with such a window go through the sorts."""

    def places(ordered: Column) -> Column:
        twice = _pairs(ordered, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return F.sort_array(F.array_distinct(F.flatten(twice)))

    def words(at: Column) -> Column:
        return F.aggregate(_pairs(at, lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda total, x: total + x)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(_let(ordered, places), words)).otherwise(0)


def measures(text: Column) -> Column:
    """struct of all measures of a text: one expression, in which each step is computed once."""
    get = lambda words, i, k: F.get(words, i + k)

    def of(x: Column) -> Column:
        parts = F.struct(
            F.filter(F.split(x, f"{SPACE}+"), lambda w: w != "").alias("words"),
            F.filter(F.split(x, "\n"), lambda line: line.rlike(f"[^{SPACE[1:]}")).alias("lines"),
        )
        return _let(parts, lambda p: counted(x, p["words"], p["lines"]))

    def counted(x: Column, words: Column, lines: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(get(words, i, k) for k in range(WINDOW))))
        found = {
            "n_words": F.size(words),
            "n_lines": F.size(lines),
            "word_chars": F.length(F.translate(x, SPACES, "")),
            "n_symbols": F.length(x) - F.length(F.translate(x, SYMBOLS, "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": F.when(F.size(words) > WINDOW, _let(windows, _covered)).otherwise(0),
        }
        return F.struct(*(c.cast("long").alias(name) for name, c in found.items()))

    return _let(F.coalesce(text, F.lit("")), of)


def judged(text: Column) -> Column:
    """measures() with `failed`, the bits of the failed rules."""

    def with_bits(m: Column) -> Column:
        failed = F.lit(0).cast("long")
        for rule, fails in RULES.items():
            failed = failed.bitwiseOR(F.when(fails(m), F.lit(bit(rule))).otherwise(0).cast("long"))
        return F.struct(*(m[name].alias(name) for name in MEASURES), failed.alias("failed"))

    return _let(measures(text), with_bits)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and `failed` of each row, as a written table: policies, ablations and filters on any column read
    that, and no text is looked at again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), judged(F.col("text")).alias("_j"))
    return stage(rows.select("doc_id", "_j.*"), "quality-ledger")


def _rejects(failed: Column, policy: Policy) -> Column:
    return failed.bitwiseAND(F.lit(BASE.mask | policy.mask)) != 0


def apply_policy(ledger: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """The ledger with the verdict of a policy, in which the base rules always count."""
    failed = F.col("failed")
    return ledger.withColumn("base_failed", failed.bitwiseAND(F.lit(BASE.mask)) != 0).withColumn("kept", ~_rejects(failed, policy)).withColumn("policy", F.lit(policy.version))


def ablation(ledger: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """One row for each rule: documents that fail it, that fail it alone, and that the policy would keep without it."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    sums = [F.count_if(hit == 0).alias("kept")]
    for rule in policy.rules:
        sums += [F.count_if(hit.bitwiseAND(F.lit(bit(rule))) != 0).alias(f"{rule}_n"), F.count_if(hit == bit(rule)).alias(f"{rule}_alone")]
    rows = F.explode(
        F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"{r}_n").alias("n_failed"), F.col(f"{r}_alone").alias("n_alone"), (F.col("kept") + F.col(f"{r}_alone")).alias("n_kept_without")) for r in policy.rules))
    )
    return ledger.agg(*sums).select(rows.alias("x")).select("x.*")


def filter_documents(docs: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Rows of docs that the policy keeps, all columns as they were.  Rows without a doc_id go: nothing later could name
    them.

    A row is judged by its own text, as the same bits that a ledger holds: a written ledger would have to be joined to the
    texts again, which would shuffle them all.  The verdict is one expression, so it is evaluated once wherever it goes.
    """
    return docs.filter("doc_id is not null").filter(_let(judged(F.col("text")), lambda j: ~_rejects(j["failed"], policy)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(documents(spark, sf_dir))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n
  FROM (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5))
), hit AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM win WHERE n > 1
), rep AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words FROM hit GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
), f AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END
       + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
       + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 4 ELSE 0 END
       + CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END
       + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
       (failed & 27) = 0 AS kept, n_lines, failed
FROM f
"""
