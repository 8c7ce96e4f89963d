"""Tables of a data folder, tables stored on the way, and broadcasts behind a check of size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sides up to this many rows are broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 100_000
#: And up to this many characters, written out as JSON.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer partitions than there are (one small file); as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``limit`` rows and ``BROADCAST_BYTES`` or fewer; as it is otherwise."""
    names = df.columns
    size = F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)))) if names else F.lit(0)
    found = df.limit(limit + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found["rows"] <= limit and found["size"] <= BROADCAST_BYTES else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``.

    Where none is set, one is made for the session on one machine; on a cluster,
    whose executors would not share it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/hoplattice"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For what several later steps read: it is made once, plans stay short, and it
    survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Pieces:
    """A table that is made block by block: each block's rows are stored as they come, so the plan of the whole doesn't grow."""

    def __init__(self, spark: SparkSession, schema: str, label: str) -> None:
        self._spark, self._schema = spark, T._parse_datatype_string(schema)
        self._folder, self._paths = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", []

    def add(self, df: DataFrame) -> None:
        self._paths.append(f"{self._folder}/{len(self._paths)}")
        df.write.parquet(self._paths[-1])

    def read(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(*self._paths) if self._paths else self._spark.createDataFrame([], self._schema)
