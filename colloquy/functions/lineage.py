"""Cutting lineage, and numbering rows without gathering them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only in a local session that sets none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with ``__i``, the place of a row from 0 in the given order, and ``__n``, the number of rows.

    A range sort, written once; then each partition's number of rows before it (a row a partition) is added to
    the places inside it.  No task sees all rows."""
    rows = cut(df.orderBy(*order).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}))
    before = F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    per = rows.groupBy("__p").agg(F.count("*").alias("c"), F.min("__m").alias("__low"))
    per = per.select("__p", "__low", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("c").over(Window.partitionBy()).alias("__n"))
    out = rows.join(F.broadcast(per), "__p")
    return out.withColumn("__i", F.col("__before") + F.col("__m") - F.col("__low")).drop("__p", "__m", "__low", "__before")


def if_few(df: DataFrame, rows: int = 100_000, items=None) -> DataFrame:
    """Hints a broadcast of a materialised side if its rows, or the items in them (a column), are few, else a merge join: the engine
    would go by the bytes of the files that the side was read from, however many rows have come of them."""
    n = df.agg(F.coalesce(F.sum(items if items is not None else F.lit(1)), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= rows else df.hint("merge")
