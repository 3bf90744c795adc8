"""Connected components of a link table, by smallest label and pointer jumping.

Every round sends each node's label along its links and then replaces it by its label's label, so even a chain takes a
logarithmic number of rounds.  Labels and links live in staged tables; the driver only sees one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of a link (a, b) reaches.  Ids without links aren't in it.

    Links may repeat, point either way or from an id to itself; rows with a null end are ignored.
    """
    ends = links.filter("a is not null and b is not null and a <> b")
    both = stage(ends.select("a", "b").unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        sent = both.join(labels, both.a == labels.id).select(F.col("b").alias("id"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("id", "label", F.col("label").alias("old"))
        lower = stage(sent.unionByName(own).groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
        far = lower.select(F.col("id").alias("label"), F.col("label").alias("root"))
        jumped = stage(lower.join(far, "label", "left").select("id", F.coalesce("root", "label").alias("label"), "old"), "labels")
        unstage(labels)
        unstage(lower)
        labels = jumped
        changed = labels.filter("label <> old").limit(1).count()
        out = labels.select("id", "label")
        out._fathomline_path = labels._fathomline_path
        labels = out
        if not changed:
            unstage(both)
            return labels
