"""Document frequency kept up to date by a stream; an extra beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def running_frequency(incidence: DataFrame, unit: str = "unit_id", node: str = "node_id") -> DataFrame:
    """``(node, df)`` of a stream in which each pair of unit and node may come again; pairs are counted once.

    The state holds the distinct pairs; give the stream a watermark first to bound it.
    """
    return incidence.dropDuplicates([unit, node]).groupBy(node).agg(F.count("*").alias("df"))


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each key and window; what comes later than ``late`` after the newest is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataStreamWriter:
    """A writer that gathers what is there into a table of that name, for tests and reports."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
