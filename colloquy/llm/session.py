"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows and bytes up to which a side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only a local session, which has no
    other machine, may go without: it gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Stored:
    """A table written once into the shared folder, to be read column by column as often as needed."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/table-{uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; what was not computed from them by then cannot be any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _width(column: Column, kind) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, (ArrayType, MapType)):
        of = kind.elementType if isinstance(kind, ArrayType) else kind.valueType
        each = 8 * len(of.fields) if isinstance(of, StructType) else 16
        return F.greatest(F.size(column), F.lit(0)) * each + 16
    return F.lit(16)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast of a materialised side only when its rows and their bytes are few;
    beyond that the planner is free to shuffle both sides."""
    total = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0)).cast("long")
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got.n <= rows and got.b <= size else df


def unused(name: str, columns: list[str]) -> str:
    """A column name that no column has, whatever its case."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = "_" + name
    return name


def positional(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    """docs with its columns named ``c0``, ``c1``, ... so that no helper column clashes with one of theirs; the new
    names of the needed ones, and the old names in order.

    A needed column is the one of that very spelling, or else of another case."""
    names = docs.columns
    new = {}
    for n in needed:
        same = [i for i, c in enumerate(names) if c == n] or [i for i, c in enumerate(names) if c.lower() == n.lower()]
        if not same:
            raise ValueError(f"no column {n} among {names}")
        new[n] = f"c{same[0]}"
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), new, names


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB: whole texts are long, and a batch is held on both sides of the pipe at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_slice(doc_id, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; -1 for a null id, which is neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))
