"""Helpers that every operator of this package shares: tables, scratch tables, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of one Arrow batch sent to a Python worker; bounds the memory of workers on long texts.
BATCH_BYTES = 8 << 20

#: Longer words are worked out each time, so that what workers remember of words is bounded in bytes.
LONG_WORD = 64

#: Words end at these characters and no others (ASCII space, tab, newline, VT, FF, CR).
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name in a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, whose default bound is rows alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) != str(BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset on one
    machine (tests), a temporary folder is made and kept in the session; on a
    cluster, whose executors would not share it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage: what follows never recomputes what came before, and the table
    survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/hoplattice/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(
    df: DataFrame, schema: str | T.StructType, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, Any]]]
) -> DataFrame:
    """``mapInArrow`` for functions that yield columns as a dict of sequences; batches are bounded by their bytes."""
    bounded_batches(df.sparkSession)
    spark_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, spark_schema)


def held_out_column(id_column: str, modulus: int, remainder: int) -> str:
    """SQL: whether crc32 of the id as text leaves ``remainder``; a null id is held out."""
    return f"coalesce(pmod(crc32(cast(cast({id_column} as string) as binary)), {modulus}) = {remainder}, true)"


def chunk_pairs(keyed: DataFrame, key: str, row_id: str, limit: int, hot: DataFrame | None = None) -> DataFrame:
    """Deal the rows of each key into work units; adds ``low``, ``high`` and ``first``.

    A key of ``limit`` rows or fewer is one unit (0, 0). A larger one is cut into
    chunks by a hash of ``row_id``, and each pair of chunks is a unit, which holds
    the lower chunk's rows (``first``) and the higher chunk's. Every two rows of a
    key meet in exactly one unit, and no unit is larger than two chunks. ``hot``, if
    it is known more cheaply than from ``keyed``, has ``key`` and ``rows`` of the larger keys.
    """
    if hot is None:
        hot = keyed.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
    hot = stored(hot.select(key, F.col("rows").alias("_size")), "hot-keys")
    if hot.isEmpty():
        return keyed.withColumns({"low": F.lit(0), "high": F.lit(0), "first": F.lit(True)})
    cut = keyed.join(hot, key, "left").withColumn("_chunks", F.ceil(F.coalesce("_size", F.lit(1)) / limit).cast("int"))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64(row_id), F.col("_chunks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    unit = {"low": F.least("_own", "_other"), "high": F.greatest("_own", "_other"), "first": F.col("_own") <= F.col("_other")}
    return cut.withColumns(unit).drop("_size", "_chunks", "_own", "_other")
