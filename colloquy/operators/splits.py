"""Splits, samples and batches, reproducible whatever the partitioning.

Random choice is by a hash of seed and key: sizes are exact, and the same rows come
out on every run.  A caller may give an order of its own instead (``key``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..functions.lineage import numbered


def shuffled(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


#: Rows of a group up to which one task numbers it.
GROUP = 1_000_000


def _total(df: DataFrame, key) -> list:
    """The key, and what else a row holds where keys are equal, so that every way of numbering gives one order."""
    rest = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    return [F.col(key) if isinstance(key, str) else key, F.xxhash64(*rest)]


def _numbered(df: DataFrame, key, *by: str) -> DataFrame:
    """df with ``__i``, the place from 0 in its group by key, and ``__n``, the group's size.

    Groups are numbered by a window each, unless one has more than ``GROUP`` rows: then all rows are
    numbered by group and key in one range sort, and each group's first number is taken off; the numbers are the same."""
    order = _total(df, key)
    if not by:
        return numbered(df, *order)
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= GROUP:
        w = Window.partitionBy(*by)
        return df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    rows = numbered(df.withColumn("__g", F.struct(*by)), "__g", *order).drop("__n")
    first = rows.groupBy("__g").agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    return rows.join(first, rows["__g"].eqNullSafe(first["__g"])).withColumn("__i", F.col("__i") - F.col("__first")).drop("__g", "__first")


def numbers_in(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """df with ``name``, the running number from 0 inside its group."""
    return _numbered(df, order, group).withColumn(name, F.col("__i").cast("int")).drop("__i", "__n")


def in_slice(df: DataFrame, order, start: int, end: int | None = None) -> DataFrame:
    """Rows [start, end) in the given order.

    No task sees all rows."""
    rows = numbered(df, *_total(df, order))
    return rows.where((F.col("__i") >= start) & (F.lit(True) if end is None else F.col("__i") < end)).select(*df.columns)


def hold_out(df: DataFrame, fraction: float, key, *by: str) -> DataFrame:
    """df with ``part``: ``validation`` for max(1, int(n * fraction)) rows, else ``train``; in each group of ``by``."""
    n = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(float(fraction))))
    return _numbered(df, key, *by).withColumn("part", F.when(F.col("__i") < n, "validation").otherwise("train")).drop("__i", "__n")


def scenario_key(domains) -> Column:
    """The sorted domains but ``general``, joined by ``_``; ``none`` for no domain."""
    names = F.array_sort(F.filter(domains, lambda x: x != "general"))
    return F.when(F.size(names) == 0, "none").otherwise(F.array_join(names, "_"))


def scenario_split(df: DataFrame, key, scenario: str = "scenario", train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """df with ``part``: each scenario's rows cut at n_train and n_train + n_val.

    n_train = max(1, int(n * train)), n_val = max(1, int(n * validation)), and where nothing would be left for test
    n_val = max(1, n - n_train - 1).  Test gets what the slices leave; fewer than three rows all train."""
    n = F.col("__n")
    a = F.greatest(F.lit(1), F.floor(n * F.lit(float(train))))
    b = F.greatest(F.lit(1), F.floor(n * F.lit(float(validation))))
    b = F.when(n - a - b < 1, F.greatest(F.lit(1), n - a - 1)).otherwise(b)
    part = F.when(n < 3, "train").when(F.col("__i") < a, "train").when(F.col("__i") < a + b, "validation").otherwise("test")
    return _numbered(df, key, scenario).withColumn("part", part).drop("__i", "__n")


def group_fraction(df: DataFrame, fraction: float, key, *by: str) -> DataFrame:
    """max(1, int(n * fraction)) rows of each group."""
    return _numbered(df, key, *by).where(F.col("__i") < F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(float(fraction))))).drop("__i", "__n")


def three_ways(df: DataFrame, split: str, key, fraction: float = 0.2) -> DataFrame:
    """df with ``part``: train, validation and test as ``split`` says; a validation or test part that the split
    has not got is held out of the train rows (test first, then validation of the rest)."""
    has = df.agg(F.bool_or(F.col(split) == "validation").alias("v"), F.bool_or(F.col(split) == "test").alias("t")).first()
    out = df.withColumn("part", F.col(split))
    for name, there in (("test", has.t), ("validation", has.v)):
        if not there:
            mine = hold_out(out.where("part = 'train'").drop("part"), fraction, key).withColumn("part", F.when(F.col("part") == "validation", name).otherwise("train"))
            out = mine.unionByName(out.where("part <> 'train'"))
    return out


def batches(df: DataFrame, size: int, order, *by: str, most: int | None = None) -> DataFrame:
    """df with ``batch_no`` from 0, ``size`` rows each in the given order; the first ``most`` rows only, if given."""
    rows = _numbered(df, order, *by)
    rows = rows if most is None else rows.where(F.col("__i") < most)
    return rows.withColumn("batch_no", F.floor(F.col("__i") / size).cast("int")).drop("__i", "__n")


def balanced_no(i: Column, n: Column, size: int) -> Column:
    """Batch of row i of n: a rest of less than half a batch is dealt to the batches before it, one each in turn."""
    q, r = F.floor(n / size), n % size
    full = q * size
    return F.when(n <= size, 0).when(i < full, F.floor(i / size)).when(r < size / 2.0, (i - full) % F.greatest(q, F.lit(1))).otherwise(q).cast("int")


def balanced_batches(df: DataFrame, size: int, order, *by: str) -> DataFrame:
    """df with ``batch_no`` and ``place`` (dealt rows come last in their batch)."""
    rows = _numbered(df, order, *by)
    return rows.withColumns({"batch_no": balanced_no(F.col("__i"), F.col("__n"), size), "place": F.col("__i")}).drop("__i", "__n")


def take_shuffled(df: DataFrame, n: int, key) -> DataFrame:
    """n rows by the order of key, whatever n: rows are numbered by a range sort, and no task sees all of them."""
    return in_slice(df, key, 0, n)


def cluster_sample(records: DataFrame, n: int, key, cluster: str = "task_id") -> DataFrame:
    """All records of n clusters (of all, if there are no more).  A record without a cluster fails the job."""
    checked = records.withColumn(cluster, F.when(F.col(cluster).isNull(), F.raise_error(F.lit(f"a record has no {cluster}"))).otherwise(F.col(cluster)))
    chosen = take_shuffled(checked.select(cluster).distinct(), n, key)
    return checked.join(chosen, cluster, "left_semi")


def merge_schedule(n: int, size: int, max_levels: int) -> list[list[int]]:
    """How many groups go into each group, level by level, until one is left; one forced last level beyond ``max_levels``."""
    out = []
    while n > 1:
        if len(out) == max_levels:
            return [*out, [n]]
        q, r = divmod(n, size)
        if n <= size:
            level = [n]
        elif r and r < size / 2:
            level = [size + r // q + (i < r % q) for i in range(q)]
        else:
            level = [size] * q + [r] * (r > 0)
        out.append(level)
        n = len(level)
    return out


def first_seen(df: DataFrame, key: str, *order) -> DataFrame:
    """Of rows of the same key the first in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")
