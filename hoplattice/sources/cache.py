"""Values by content: computed once, appended, and looked up without moving what is stored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoplattice.sources.tables import stored


def content_key(text: Column) -> Column:
    """The key of a text: its SHA-256."""
    return F.sha2(text, 256)


class ContentCache:
    """A bucketed table of one row for each key (``content_id``).

    ``config`` (a model's name, its version, a rule for texts) is part of the place, so values of different
    configurations never meet. The table is bucketed and sorted by key: a join with it
    shuffles what is asked for, or nothing, and never what is stored.
    """

    def __init__(self, spark: SparkSession, folder: str, config: str, columns: str, buckets: int = 64) -> None:
        self._spark = spark
        own = hashlib.sha256(f"{folder}|{config}|{columns}".encode()).hexdigest()[:16]
        self.path, self.name = f"{folder.rstrip('/')}/{own}", f"content_cache_{own}"
        self.columns = T._parse_datatype_string(columns)
        named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.columns)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (content_id STRING, {named}) USING parquet CLUSTERED BY (content_id) SORTED BY (content_id) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        self._spark.catalog.refreshTable(self.name)
        return self._spark.table(self.name)

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` whose key is not stored, one for each key."""
        return wanted.dropDuplicates(["content_id"]).join(self.table().select("content_id"), "content_id", "left_anti")

    def fill(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Computes and appends what is missing; returns how many keys that were.

        A computation that leaves a key out, makes one twice or adds others is refused before anything is written.
        """
        asked = stored(self.missing(wanted), "cache-asked")
        n = asked.count()
        if n:
            made = stored(compute(asked).select("content_id", *(F.col(f.name).cast(f.dataType) for f in self.columns)), "cache-made")
            known = made.groupBy("content_id").agg(F.count("*").alias("n")).join(asked.select("content_id", F.lit(1).alias("asked")), "content_id", "full")
            wrong = known.where("asked IS NULL OR n IS NULL OR n > 1").count()
            if wrong:
                raise ValueError(f"{wrong} keys were computed twice, left out or not asked for")
            made.write.insertInto(self.name)
        return n

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` with the stored values; a key that is missing is an error."""
        found = wanted.join(self.table().withColumn("_stored", F.lit(True)), "content_id", "left")
        miss = F.raise_error(F.concat(F.lit("nothing stored for "), F.col("content_id")))
        return found.withColumn("content_id", F.when(F.col("_stored").isNull(), miss).otherwise(F.col("content_id"))).drop("_stored")

    def conflicts(self) -> DataFrame:
        """Keys that are stored with more than one value; a sound table has none."""
        value = F.struct(*(F.col(f.name) for f in self.columns))
        return self.table().groupBy("content_id").agg(F.count_distinct(value).alias("values")).where("values > 1")
