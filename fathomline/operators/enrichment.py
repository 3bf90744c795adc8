"""Metadata from a model's answers: what to ask about, how an answer becomes a row, and what happens to failures.

The model is any object with complete(system, user) -> str; clients for real services are the caller's, and tests use a
deterministic one.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

OPENING_CHUNKS, OPENING_CHARS = 5, 5000


class ChatClient(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class Refused(RuntimeError):
    """The service doesn't accept the credentials."""


class RetryingClient:
    """A client around `send`, tried up to four times with waits of 1, 2, 4 ... 20 seconds; refused credentials are renewed
    once by `renew` before the next try."""

    def __init__(self, send: Callable[[str, str], str], renew: Callable[[], None] | None = None, tries: int = 4, wait: Callable[[float], None] = time.sleep):
        self.send, self.renew, self.tries, self.wait = send, renew, tries, wait

    def complete(self, system: str, user: str) -> str:
        for n in range(self.tries):
            try:
                return self.send(system, user)
            except Refused:
                if not self.renew or n + 1 == self.tries:
                    raise
                self.renew()
            except OSError:
                if n + 1 == self.tries:
                    raise
                self.wait(min(2**n, 20))
        raise AssertionError("unreachable")


def targets(documents: DataFrame, enrichment: DataFrame, only_review: bool = False, limit: int | None = None, redo: bool = False) -> DataFrame:
    df = documents if redo else documents.join(enrichment.select("doc_id").distinct(), "doc_id", "left_anti")
    df = (df.filter("needs_review") if only_review else df).select("doc_id").orderBy("doc_id")
    return df.limit(limit) if limit else df


def opening_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): the first five chunks, 5,000 characters of them."""
    first = Window.partitionBy("doc_id").orderBy("ordinal")
    few = chunks.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= OPENING_CHUNKS)
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("ordinal", "text"))))
    return few.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n"), 1, OPENING_CHARS).alias("text"))


def asked(openings: DataFrame, client: ChatClient, system: str) -> DataFrame:
    """openings with `reply` and `error`: a call for each row, and a failed one costs only its own row."""

    @F.pandas_udf("struct<reply: string, error: string>")
    def ask(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                rows.append((client.complete(system, f"Opening text:\n\n{text}"), None) if text and text.strip() else (None, "no text"))
            except Exception as error:  # noqa: BLE001  counted, not fatal
                rows.append((None, f"{type(error).__name__}: {error}"[:300]))
        return pd.DataFrame(rows, columns=["reply", "error"])

    return openings.withColumn("_r", ask("text")).select(*openings.columns, "_r.reply", "_r.error")


REPLY = "title string, authors array<string>, year string, venue string, keywords array<string>"


def enrichment_rows(replies: DataFrame, method: str = "chat") -> DataFrame:
    """doc_enrichment rows of replies (doc_id, reply): what isn't a JSON object gives no row."""
    parsed = replies.withColumn("_json", T.json_object("reply")).filter("_json is not null").withColumn("m", F.from_json("_json", REPLY))
    year = F.when(F.get_json_object("_json", "$.year").rlike(r"^-?\d{1,9}$") & ~F.col("_json").rlike(r"\x22year\x22\s*:\s*\x22"), F.col("m.year").cast("int"))
    return parsed.select(
        "doc_id", F.nullif(T.strip("m.title"), F.lit("")).alias("title"), T.clean_authors("m.authors").alias("authors"), year.alias("year"),
        F.nullif(F.col("m.venue"), F.lit("")).alias("venue"), T.clean_keywords("m.keywords").alias("keywords"), F.lit(method).alias("method"), F.current_timestamp().alias("enriched_at"),
    )
