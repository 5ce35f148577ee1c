"""A Spark session with the settings the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """An adaptive, UTC session; `conf` adds settings with _ for the dots in their names."""
    builder = SparkSession.builder.appName("corvella")
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=fixed | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()


def spread(rows: DataFrame) -> DataFrame:
    """`rows` over all cores, for work of many operations a byte.

    What is read from less than one file split a core may come in fewer tasks than there are cores
    (a row group is one task); such rows, of bounded size, are dealt out evenly. Rows of larger
    tables fill the cores as they are read and stay where they are: no shuffle.
    """
    spark = rows.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return rows.repartition(cores) if read < cores * split else rows
