"""Tar archives read by many tasks: an index of where members lie, and members streamed from there in bounded memory.

For plain tar files in a folder that driver and executors mount alike (members may be bz2 themselves). A tar
that is compressed as a whole has no places to start from; ``files.archive_lines`` reads it as one stream.
"""

from __future__ import annotations

import bz2
import json
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from hoplattice.sources.files import MAX_MEMBER_BYTES, resolved_fields

_CHUNK = 1 << 16


@dataclass
class Member(InputPartition):
    """Where a member's bytes lie in the archive."""

    name: str
    offset: int
    size: int


def index(path: str) -> list[Member]:
    """Regular members with names that stay within the archive; only headers are read. One that is too large is an error."""
    out = []
    with tarfile.open(path, "r:") as archive:
        for m in archive:
            if m.isfile() and not m.name.startswith("/") and ".." not in m.name.split("/"):
                if m.size > MAX_MEMBER_BYTES:
                    raise ValueError(f"{m.name} has {m.size} bytes")
                out.append(Member(m.name, m.offset_data, m.size))
    return out


def _opened(path: str, member: Member) -> Iterator[bytes]:
    """The member's bytes in chunks, unpacked if it is bz2; unpacked ones are bounded too."""
    packed, total = member.name.endswith(".bz2"), 0
    unpack = bz2.BZ2Decompressor()
    with open(path, "rb") as f:
        f.seek(member.offset)
        left = member.size
        while left:
            data = f.read(min(_CHUNK, left))
            if not data:
                raise ValueError(f"{member.name} ends early")
            left -= len(data)
            if not packed:
                yield data
                continue
            while data or not (unpack.needs_input or unpack.eof):
                if unpack.eof:  # several streams may follow each other
                    unpack = bz2.BZ2Decompressor()
                some = unpack.decompress(data, _CHUNK)
                data = unpack.unused_data if unpack.eof else b""  # what isn't taken yet stays inside
                total += len(some)
                if total > MAX_MEMBER_BYTES:
                    raise ValueError(f"{member.name} unpacks to over {MAX_MEMBER_BYTES} bytes")
                yield some
    if packed and member.size and not unpack.eof:
        raise ValueError(f"{member.name} ends early")


def lines(chunks: Iterator[bytes]) -> Iterator[str]:
    """Lines of a stream of bytes, ended by a line feed or the end; no more than a line and a chunk is held."""
    rest: list[bytes] = []
    for chunk in chunks:
        first, *more = chunk.split(b"\n")
        rest.append(first)
        for part in more:
            yield b"".join(rest).decode()
            rest = [part]
    if last := b"".join(rest):
        yield last.decode()


class TarReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Member]:
        return index(self.path)

    def read(self, partition: Member):
        for k, text in enumerate(lines(_opened(self.path, partition))):
            yield partition.name, k, text


class TarLines(DataSource):
    """``spark.read.format("tar_lines").load(path)``: ``(member, line, text)``, a partition for each member."""

    @classmethod
    def name(cls) -> str:
        return "tar_lines"

    def schema(self) -> str:
        return "member string, line long, text string"

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options["path"])


def tar_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(member, line, text)`` of every member, each read by a task of its own."""
    spark.dataSource.register(TarLines)
    return spark.read.format("tar_lines").load(path)


def probe(found: DataFrame, candidates: dict[str, list[str]], sample: int = 100) -> dict[str, str]:
    """Which of the candidate names each field has, from the first ``sample`` lines that aren't blank."""
    rows = found.where(F.trim("text") != "").limit(sample).collect()
    return resolved_fields([json.loads(r["text"]) for r in rows], candidates)


def described(found: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row: members, lines, blank lines, records that lack a field, their bytes, and the fields' names."""
    parsed = [F.get_json_object("text", f"$.{name}").isNull() for name in fields.values()]
    lacking = parsed[0]
    for p in parsed[1:]:
        lacking = lacking | p
    blank = F.trim("text") == ""
    count = lambda c: F.sum(c.cast("long"))
    return found.agg(
        F.count_distinct("member").alias("members"), F.count("*").alias("lines"), F.coalesce(count(blank), F.lit(0)).alias("blank"),
        F.coalesce(count(~blank & lacking), F.lit(0)).alias("lacking"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"),
        *(F.lit(name).alias(f"field_{field}") for field, name in fields.items()),
    )
