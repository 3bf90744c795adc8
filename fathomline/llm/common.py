"""Reading the documents, and tables that cut lineage in the folder all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of the white space that parts words; everything else is part of a word.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch between the JVM and Python: texts are large, and both sides hold a batch outside the heap.
BATCH_ROWS = "2000"


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has set a size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='fathomline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_WATCHING: list[list[str]] = []


@contextlib.contextmanager
def tables_made():
    """The paths of all tables that are staged meanwhile, for discard()."""
    made: list[str] = []
    _WATCHING.append(made)
    try:
        yield made
    finally:
        _WATCHING.remove(made)


def discard(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def staged_path(df: DataFrame) -> str:
    """Where a frame that stage() returned is."""
    return df._fathomline_path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to a table of the shared folder and read again: lost executors cost no earlier work."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _WATCHING:
        made.append(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fathomline_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes the table of a frame that stage() returned and that nothing reads any more."""
    discard(df.sparkSession, [staged_path(df)])


#: Rows of one or two longs that may go to every task: 64 MB at most.
SENT_ROWS = 4_000_000


def sent_if_small(ids: DataFrame) -> DataFrame:
    """A staged table of ids, marked to be sent to every task if it has at most SENT_ROWS rows; else joins shuffle."""
    return F.broadcast(ids) if ids.count() <= SENT_ROWS else ids


def repeats(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether any id has several rows."""
    return bool(docs.groupBy(id_col).count().filter("count > 1").limit(1).count())


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, under fixed names, a null text as an empty one."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
