"""Sessions with the settings the engine expects, and shipping of the package to Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What every session needs for the results to be right.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}
#: Adaptive execution sizes shuffles, splits skewed joins and picks joins by measured sizes.
ADVISED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("fathomline").config(map=ADVISED | REQUIRED | conf)
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Lets Python workers that don't have the package installed import it from where the driver did."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (home, known) if x)
