"""Files: hashes, JSON lines, write-once tables with digests, archives and newest results."""

from __future__ import annotations

import bz2
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Archive members larger than this are refused.
MAX_MEMBER_BYTES = 256 << 20


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, md5, sha256)`` of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def verified(hashes: DataFrame, expected: DataFrame) -> DataFrame:
    """The hashes, where name, bytes and sha256 agree with what is expected; anything else is an error."""
    named = hashes.withColumn("name", F.element_at(F.split("path", "/"), -1))
    both = expected.select("name", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha256")).join(named, "name", "left")
    sound = (F.col("bytes") == F.col("want_bytes")) & (F.col("sha256") == F.col("want_sha256"))
    return both.select("name", "bytes", F.when(sound, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("file differs: "), F.col("name")))).alias("sha256"))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line under a fixed schema; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_once(df: DataFrame, path: str, key: str) -> str:
    """Write a table that must not exist yet; returns its digest, which ``read_verified`` asks for."""
    df.write.mode("errorifexists").parquet(path)
    return table_digest(df.sparkSession.read.parquet(path), key)


def read_verified(spark: SparkSession, path: str, key: str, digest: str) -> DataFrame:
    """The stored table; another digest is an error."""
    df = spark.read.parquet(path)
    if (found := table_digest(df, key)) != digest:
        raise ValueError(f"{path} has digest {found}, not {digest}")
    return df


def table_digest(df: DataFrame, key: str) -> str:
    """A digest of all rows whatever their order: count, and sums of two row hashes. Nothing but three numbers is collected."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    total = df.select(F.xxhash64(row).alias("x"), F.crc32(row).alias("c")).agg(F.count("*"), F.bit_xor("x"), F.sum("c")).first()
    return f"{key}:{total[0]}:{(total[1] or 0) & 0xFFFFFFFFFFFFFFFF:016x}:{total[2] or 0}"


def newest(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(member, line, text)`` of tar or tar.bz2 archives: regular members only, nested bz2 opened, sizes bounded.

    One task reads an archive as a stream, which the format allows no other way.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
                    for member in archive:
                        if not member.isfile() or member.name.startswith("/") or ".." in member.name.split("/"):
                            continue
                        if member.size > MAX_MEMBER_BYTES:
                            raise ValueError(f"{member.name} has {member.size} bytes")
                        data = archive.extractfile(member).read()
                        data = bz2.decompress(data) if member.name.endswith(".bz2") else data
                        lines = data.decode().splitlines()
                        yield pa.RecordBatch.from_pydict({"member": [member.name] * len(lines), "line": pa.array(range(len(lines)), pa.int64()), "text": pa.array(lines, pa.string())})

    return files.mapInArrow(rows, "member string, line long, text string")


def resolved_fields(sample: list[dict], candidates: dict[str, list[str]]) -> dict[str, str]:
    """Which of the candidate names each field has: the first that every sampled record holds."""
    out = {}
    for field, names in candidates.items():
        found = next((n for n in names if sample and all(n in record for record in sample)), None)
        if found is None:
            raise ValueError(f"no candidate of {field} is in every record")
        out[field] = found
    return out


def archive_records(lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``(title, sentences, member, line, page_id)``; a first sentence that repeats the title is dropped."""
    schema = f"`{fields['id']}` string, `{fields['title']}` string, `{fields['text']}` array<string>"
    parsed = lines.where(F.trim("text") != "").select("member", "line", F.from_json("text", schema).alias("r"))
    title, sentences = F.col("r")[fields["title"]], F.col("r")[fields["text"]]
    kept = F.when(F.trim(sentences[0]) == F.trim(title), F.slice(sentences, 2, F.size(sentences))).otherwise(sentences)
    return parsed.select(title.alias("title"), kept.alias("sentences"), "member", "line", F.col("r")[fields["id"]].alias("page_id"))


def questions_from_columns(rows: DataFrame) -> DataFrame:
    """Parallel arrays ``context.title``/``context.sentences`` and ``supporting_facts.title``/``sent_id`` as arrays of structs."""
    context = F.transform(F.arrays_zip("context.title", "context.sentences"), lambda z: F.struct(z["title"].alias("title"), z["sentences"].alias("sentences")))
    facts = F.transform(F.arrays_zip("supporting_facts.title", "supporting_facts.sent_id"), lambda z: F.struct(z["title"].alias("title"), z["sent_id"].alias("idx")))
    return rows.withColumns({"context": context, "supporting_facts": facts})


def markdown(df: DataFrame, limit: int = 1_000) -> str:
    """A small result as a Markdown table; more rows than ``limit`` are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    lines = [df.columns, ["---"] * len(df.columns), *([("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in lines) + "\n"
