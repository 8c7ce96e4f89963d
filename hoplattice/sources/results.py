"""Results of runs: appended, never overwritten, and read back by system and split."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
_RUNS = "run string, system string, split string, config string, rows long, created_at timestamp"


class RunStore:
    """Rows of runs below ``folder/rows/system=.../split=.../run=...``, and a row for each whole run in ``folder/runs``.

    A run gets a name of its own and is written to a folder that must not exist. Its row in ``runs`` is appended last, so a run whose
    job died has rows that no reader sees, and running it again makes another run. Filters on system and split prune folders.
    """

    def __init__(self, spark: SparkSession, folder: str, required: Iterable[str] = ()) -> None:
        self._spark, self._folder, self._required = spark, folder.rstrip("/"), frozenset(required)

    def append(self, rows: DataFrame, system: str, split: str, config: Mapping[str, Any]) -> str:
        """Stores a run and returns its name; an unsafe name or a configuration without a required key is refused before anything is written."""
        for label, value in (("system", system), ("split", split)):
            if not _NAME.fullmatch(value):
                raise ValueError(f"{label} {value!r} can't be part of a path")
        if lacking := sorted(self._required - config.keys()):
            raise ValueError(f"the configuration of {system} on {split} lacks {lacking}")
        if clash := sorted({"system", "split", "run"} & set(rows.columns)):
            raise ValueError(f"rows have columns that the store adds: {clash}")
        run = uuid.uuid4().hex
        path = f"{self._folder}/rows/system={system}/split={split}/run={run}"
        rows.write.mode("errorifexists").parquet(path)
        n = self._spark.read.schema(rows.schema).parquet(path).count()
        row = self._spark.createDataFrame([(run, system, split, json.dumps(dict(config), sort_keys=True), n)], "run string, system string, split string, config string, rows long")
        row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self._folder}/runs")
        return run

    def runs(self) -> DataFrame:
        """``(run, system, split, config, rows, created_at)`` of whole runs; empty where none was stored."""
        try:
            return self._spark.read.schema(_RUNS).parquet(f"{self._folder}/runs")
        except AnalysisException:
            return self._spark.createDataFrame([], _RUNS)

    def newest(self) -> DataFrame:
        """The newest run of each system and split; ties in time by name."""
        one = F.max_by(F.struct("run", "config", "rows", "created_at"), F.struct("created_at", "run"))
        return self.runs().groupBy("system", "split").agg(one.alias("r")).select("system", "split", "r.*")

    def rows(self, chosen: DataFrame, schema: str) -> DataFrame:
        """``(system, split, run, ...)``: the rows of the chosen runs ``(run)``; a run whose rows are not all there is an error."""
        whole = self._spark.read.schema(f"{schema}, system string, split string, run string").parquet(f"{self._folder}/rows")
        picked = chosen.select("run").distinct().join(self.runs().select("run", "rows"), "run", "left")
        rows = whole.join(F.broadcast(picked.select("run")), "run", "left_semi")
        found = picked.join(rows.groupBy("run").agg(F.count("*").alias("found")), "run", "left").where("rows IS NULL OR rows <> coalesce(found, 0)").select("run").first()
        if found:
            raise ValueError(f"run {found['run']} is not whole")
        return rows
