"""Packing: documents' tokens laid end to end and cut into sequences of a fixed length.

First pass: each task encodes its documents, writes their ids to a table in the
shared folder and numbers them from its own zero. The totals of the tasks, one
small row each, give every task its global offset by a prefix sum. Second pass:
each document, now with its global offset, is cut at the multiples of the length;
a document across a boundary gives a record on either side. No row is shuffled,
and only the last sequence has padding.

Defined cases: a null text is empty; each document ends with the end id, so an
empty one has one token; repeated rows are packed each; ids may be null; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoplattice.llm import wordtable
from hoplattice.llm.common import map_arrow, stored

_ROWS = 64


def token_runs(docs: DataFrame, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None) -> DataFrame:
    """First pass: ``(doc_id, part, start, doc_tokens, ids)``, stored.

    ``part`` is the task, ``start`` the tokens before the document in it, and
    ``ids`` little-endian 32-bit ids, the end id included.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(wordtable.tokenizer_json(tokenizer))

    def rows(batches: Iterator[pa.RecordBatch]):
        table = wordtable.table_for(shared.value)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), _ROWS):
                runs = [np.append(ids, end_id).astype("<u4") for ids in table.encode(texts[k : k + _ROWS])]
                ends = before + np.cumsum([len(r) for r in runs])
                yield {
                    "doc_id": batch.column("doc_id").slice(k, _ROWS),
                    "part": [part] * len(runs),
                    "start": [int(e) - len(r) for e, r in zip(ends, runs, strict=True)],
                    "doc_tokens": [len(r) for r in runs],
                    "ids": [r.tobytes() for r in runs],
                }
                before = int(ends[-1])

    runs = map_arrow(source, "doc_id long, part int, start long, doc_tokens long, ids binary", rows)
    return stored(runs, "packing")


def cut(runs: DataFrame, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Second pass: the pieces of every run, at their places in the sequences."""
    totals = runs.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    # one row a task of the first pass: a window without partitions is small here
    offsets = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    offset_of = {r["part"]: r["before"] for r in offsets.collect()}
    shared = runs.sparkSession.sparkContext.broadcast(offset_of)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "part", "start", "doc_tokens", "ids"))
            for doc_id, part, start, tokens, ids in zip(*columns, strict=True):
                place, data, done = shared.value[part] + start, memoryview(ids), 0
                while done < tokens:
                    sequence, offset = divmod(place + done, length)
                    n = min(length - offset, tokens - done)
                    piece = (doc_id, done, n, zlib.crc32(data[4 * done : 4 * (done + n)]), tokens, sequence, offset)
                    for column, value in zip(out.values(), piece, strict=True):
                        column.append(value)
                    done += n
            yield out

    return map_arrow(runs, schema, rows)


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document: which ids it holds and where it lies."""
    return cut(token_runs(docs, end_id, id_column, text_column, tokenizer), length, end_id)
