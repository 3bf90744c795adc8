"""Video lists and transcripts as tables.  Expanding lists, finding videos and fetching transcripts is the caller's client;
its answers come in as tables of these schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunking import transcript_body
from ..operators.rules import merge_backlog, video_kind

#: Videos of an expanded list or a search, and a fetched transcript.
EXPANDED = "source string, video_id string, url string, title string, channel string, pos int"
TRANSCRIPTS = "video_id string, lang string, generated boolean, snippets array<struct<start: double, text: string>>"
METADATA = "video_id string, url string, title string, channel string, channel_url string, upload_date string, duration double, description string"


def classify_sources(entries: DataFrame, line: str = "line") -> DataFrame:
    """entries with kind, video_id, playlist and channel: what the client has to expand, look up or search for."""
    return entries.withColumns({"kind": video_kind(line), "video_id": T.video_id(line), "playlist": T.playlist_id(line), "channel_url": T.channel_url(line)})


def enqueue(sources: DataFrame, expanded: DataFrame) -> DataFrame:
    """A backlog of classified sources (line, pos) and of what their lists and queries gave."""
    own = sources.filter("kind = 'video'").select("video_id", F.col("line").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("channel"), F.lit(None).cast("string").alias("playlist"), F.struct("pos", F.lit(-1).alias("n")).alias("order"))
    lists = sources.filter("kind <> 'video'").select(F.col("line").alias("source"), F.when(F.col("kind") == "playlist", F.col("line")).alias("playlist"), F.col("pos").alias("at"))
    found = expanded.join(lists, "source").select("video_id", "url", "title", "channel", "playlist", F.struct(F.col("at").alias("pos"), F.col("pos").alias("n")).alias("order"))
    return merge_backlog(own.unionByName(found))


def preferred(transcripts: DataFrame, languages: list[str]) -> DataFrame:
    """One transcript for each video: by the order of languages, written ones before generated ones."""
    rank = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(i)) for i, lang in enumerate(languages)), F.lit(len(languages)))
    best = F.min_by(F.struct("lang", "generated", "snippets"), F.struct(rank, F.col("generated"), "lang"))
    return transcripts.groupBy("video_id").agg(best.alias("t")).select("video_id", "t.*")


def transcript_document(title: Column, facts: list[tuple[str, Column]], description: Column, snippets: Column) -> Column:
    """Markdown of a video: title, a list of facts, description and the transcript in paragraphs."""
    lines = [F.concat(F.lit(f"- **{name}:** "), F.coalesce(value, F.lit("unknown"))) for name, value in facts]
    about = F.when(F.coalesce(T.strip(description), F.lit("")) != "", F.concat(F.lit("\n\n## Description\n\n"), T.strip(description))).otherwise("")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.concat_ws("\n", *lines), about, F.lit("\n\n## Transcript\n\n"), transcript_body(snippets), F.lit("\n"))


def transcript_documents(backlog: DataFrame, metadata: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(video_id, path, text): a file for each video that has a transcript, in its channel's folder."""
    df = transcripts.join(metadata, "video_id", "left").join(backlog.select("video_id", F.col("title").alias("b_title"), F.col("channel").alias("b_channel"), F.col("url").alias("b_url"), "playlists"), "video_id", "left")
    title = F.coalesce("title", "b_title", "video_id")
    channel = F.coalesce("channel", "b_channel", F.lit("YouTube"))
    url = F.coalesce("url", "b_url")
    language = F.concat("lang", F.when(F.col("generated"), " (auto-generated)").otherwise(""))
    lists = F.when(F.size("playlists") > 0, F.array_join("playlists", ", ")).otherwise("—")
    home = F.when(F.col("channel_url").isNotNull(), F.concat(channel, F.lit(" ("), "channel_url", F.lit(")"))).otherwise(channel)
    facts = [("Video", url), ("Channel", home), ("Published", T.dashed_date("upload_date")), ("Duration", T.clock("duration")), ("Transcript language", language), ("Playlists", lists), ("Video ID", F.col("video_id"))]
    text = transcript_document(title, facts, F.col("description"), F.col("snippets"))
    path = F.concat(T.slug(channel, 60), F.lit("/"), T.slug(title, 120), F.lit(" ["), "video_id", F.lit("].md"))
    return df.select("video_id", path.alias("path"), text.alias("text"))
