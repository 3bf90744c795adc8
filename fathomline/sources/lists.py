"""Lists and backlogs in files, and manifests of file trees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line): lines without the empty ones and those that begin with #."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return list_entries(whole)


def list_entries(files: DataFrame, text: str = "text") -> DataFrame:
    each = files.select(*(c for c in files.columns if c != text), F.posexplode(F.split(text, "\r\n|\r|\n")).alias("pos", "line"))
    return each.withColumn("line", T.strip("line")).filter("line <> '' and not startswith(line, '#')")


def ordered_distinct(entries: DataFrame, value: str = "line", order: str = "pos") -> DataFrame:
    """Each value once, with the place where it is first."""
    return entries.groupBy(value).agg(F.min(order).alias(order))


def read_backlog(spark: SparkSession, path: str) -> DataFrame:
    schema = "video_id string, url string, title string, playlists array<string>, channel_hint string, status string, attempts int, error string, path string, added_at string"
    return spark.read.schema(schema).json(path)


def write_versioned(df: DataFrame, path: str, format: str = "parquet") -> str:
    """Writes a new version beside the old ones and only then names it in `path`/versions, so readers never see half of
    one, nor a moment without any: a version's number and folder are the name of an empty file, which is made in one step and
    stays.  Returns the version's folder."""
    spark = df.sparkSession
    number = int((_newest(spark, path) or "0-").split("-")[0]) + 1
    version = f"v-{uuid.uuid4().hex}"
    df.write.format(format).save(f"{path}/{version}")
    target, fs = _folder(spark, f"{path}/versions/{number:010d}-{version}")
    fs.create(target, False).close()
    return f"{path}/{version}"


def _folder(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def _newest(spark: SparkSession, path: str) -> str | None:
    folder, fs = _folder(spark, f"{path}/versions")
    return max((f.getPath().getName() for f in fs.listStatus(folder)), default=None) if fs.exists(folder) else None


def has_version(spark: SparkSession, path: str) -> bool:
    return _newest(spark, path) is not None


def newest_folder(spark: SparkSession, path: str) -> str:
    newest = _newest(spark, path)
    if newest is None:
        raise FileNotFoundError(f"no version of a table in {path}")
    return f"{path}/{newest.partition('-')[2]}"


def read_versioned(spark: SparkSession, path: str, format: str = "parquet", schema=None) -> DataFrame:
    """The newest version; of two writers with one number, the same one for all readers."""
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(newest_folder(spark, path))


def manifest(files: DataFrame, root: str, depth: int = 1) -> DataFrame:
    """(part, files, bytes, size_human, sha256): totals by top folder, and a digest in two steps: of the files' own digests, in
    path order, for each of 4,096 slices by the first three digits of the path's MD5, and of the slices'.

    Contents are hashed where they are read; a path and 64 characters for each file are all that is shuffled, and a slice is
    what one row collects."""
    rel = F.regexp_replace(F.substr("path", F.length(F.lit(root)) + 1, F.length("path")), "^/+", "")
    each = files.select(rel.alias("rel"), "length", F.sha2("content", 256).alias("hash")).withColumn("part", F.array_join(F.slice(F.split("rel", "/"), 1, depth), "/"))
    digest = lambda order, name: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name]), ""), 256)
    slices = each.groupBy("part", F.substring(F.md5("rel"), 1, 3).alias("slice")).agg(F.count("*").alias("n"), F.sum("length").alias("b"), digest("rel", "hash").alias("h"))
    total = slices.groupBy("part").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), digest("slice", "h").alias("sha256"))
    return total.withColumn("size_human", T.byte_size("bytes"))


def drift(now: DataFrame, packed: DataFrame) -> DataFrame:
    """(part, state): new, gone, changed or same, between two manifests."""
    a, b = now.select("part", F.col("sha256").alias("a")), packed.select("part", F.col("sha256").alias("b"))
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "part", "full").select("part", state.alias("state"))
