"""From raw documents to training sequences: five stages, each an operator of fathomline.llm.

Every stage but the last returns the columns of `documents`; run() writes what a stage returns to a table in the shared
folder and reads it again, so a lost executor costs at most the stage that runs.  Tables that a stage has read and made on its
way are deleted when its result is written.

Line dedup comes before near-dedup, so it takes most lines of most near copies first.  What is then left of a document (fewer
than LEAST_WORDS words, as the quality rules ask for, or than LEAST_SHARE of its words) is dropped with its lines: near-dedup
couldn't tell any more what it was a copy of.

The stages take nulls, empty texts, repeated rows and empty tables as their operators do.  Rows without a doc_id leave
with the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import lines, neardup, packing, pii, quality
from fathomline.llm.common import discard, documents, stage, staged_path, tables_made
from fathomline.session import ship


#: What has to be left of a document that loses lines.
LEAST_WORDS, LEAST_SHARE = 10, 0.2


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality.filter_documents(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go from the texts, and with them documents of which next to nothing is left."""
    return lines.dedup_documents(docs, LEAST_WORDS, LEAST_SHARE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.dedup_documents(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by pseudonyms, under the session's key or one that the shared folder keeps."""
    return pii.clean_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences of token ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express near-duplicate search by signatures, nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents(spark, sf_dir)
    before: list[str] = []
    for name, function in STAGES[:-1]:
        with tables_made() as made:
            docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, [path for path in [*before, *made] if path != staged_path(docs)])
        before = [staged_path(docs)]
    return STAGES[-1][1](spark, docs, sf_dir)
