"""BPE encoding and decoding by a distinct-word table.

Encoding: texts are split into words in Spark, each distinct word is encoded once,
and its ids are joined back by position. Words that are frequent are counted over
all texts and encoded into a table of at most ``HOT_WORDS`` rows, which is
broadcast; every other word goes with its places (the text's digest and which gap
of the text it fills) to the partition of the word, is encoded there once, and its
ids go to the partition of the text, where they meet the text's other ids and fill
its gaps. Which words are frequent decides what moves, never the result.

Copies of a text in one batch travel as one row with all their ids. A text without
gaps is sent to any partition, so copies that are frequent, whose words then are
frequent too, do not meet in one task. Words of over ``HOT_LENGTH`` characters are never frequent, so one of them may be in every text:
a text that has one is keyed together with a salt of its own id, and its long words are dealt by that
key. Neither the word's places nor the text's copies meet in one task, and a long
word is encoded once for each salt at most.

Decoding: each id is joined to its piece through the id-to-piece table, whose size
is the vocabulary's and so is fixed; pieces are joined by single spaces, which is
how a tokenizer without a decoder of its own writes them.

Defined cases: a null text is empty and has no ids; the digests of an empty
sequence are those of the empty string; ids may be null and may repeat; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.llm import wordtable
from hoplattice.llm.common import map_arrow, shuffle_partitions, stored

#: Frequent words, at most; their table is broadcast.
HOT_WORDS = 524_288
#: Longer words are never in it, so its bytes are bounded too.
HOT_LENGTH = 128
#: A task names words that it met at least so often.
_OFTEN = 2
_LONG = re.compile(rf"[^ \t\n\r]{{{HOT_LENGTH + 1}}}")
_FLUSH = 600_000  # distinct words that a counting task holds
_ROWS = 64
_WORDS = 1 << 19  # words that are finished side by side
_TEXT = 2**31 - 1  # place of a text's row, behind its gaps'


def _source(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def frequent_words(source: DataFrame, tokenizer_text: str, limit: int = HOT_WORDS) -> pa.Table:
    """``(n, ids, word)`` of the ``limit`` most frequent words at most, each encoded once, the most frequent first."""

    def named(counts: Counter[str]) -> dict[str, list]:
        often = [(w, n) for w, n in counts.items() if n >= _OFTEN]
        return {"word": [w for w, _ in often], "n": [n for _, n in often]}

    def counted(batches: Iterator[pa.RecordBatch]):
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = wordtable.cut(text)
                counts.update([w for w in words if len(w) <= HOT_LENGTH] if _LONG.search(text) else words)
            if len(counts) > _FLUSH:
                yield named(counts)
                counts = Counter()
        yield named(counts)

    counts = map_arrow(source.select("text"), "word string, n long", counted).groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "bpe-counts")
    # the least count of a frequent word, from the numbers of words by count, so that just the frequent words are collected
    total, least = 0, 1
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        total += row["words"]
        if total > limit:
            least = row["n"] + 1
            break
    chosen = counts.where(F.col("n") >= least)
    return _encoded_words(chosen.withColumn("again", F.col("word")), tokenizer_text).toArrow().sort_by([("n", "descending")])


def _encoded_words(words: DataFrame, tokenizer_text: str) -> DataFrame:
    """The rows of ``words``, equal words side by side, with ``ids`` for ``word``; equal words are encoded once."""
    shared = words.sparkSession.sparkContext.broadcast(tokenizer_text)
    kept = [c for c in words.columns if c != "word"]

    def rows(batches: Iterator[pa.RecordBatch]):
        encoder, last, ids = wordtable.WordEncoder(shared.value), None, b""
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, ids = word, np.array(encoder.ids(word), "<u4").tobytes()
                out.append(ids)
            yield {c: batch.column(c) for c in kept} | {"ids": out}

    kinds = dict(words.dtypes)
    return map_arrow(words, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", ids binary", rows)


class _Frequent(dict):
    """Frequent word to its row; any other word is row 0, a gap."""

    def __init__(self, table: pa.Table) -> None:
        super().__init__(zip(table.column("again").to_pylist(), range(1, len(table) + 1), strict=True))
        ids = table.column("ids").to_pylist()
        self._length = np.array([0, *(len(i) // 4 for i in ids)])
        self._start = np.cumsum(self._length) - self._length
        self._flat = np.frombuffer(b"".join(ids), "<u4")

    def __missing__(self, word: str) -> int:
        return 0

    def rows(self, text: str) -> np.ndarray:
        return np.array(list(map(self.__getitem__, wordtable.cut(text))), "<u4")

    def ids(self, rows: list[np.ndarray], parts: list[bytes]) -> list[np.ndarray]:
        """Ids of each list of rows; ``parts`` has the ids of all gaps, in order."""
        row = np.concatenate(rows)
        gap, width = row == 0, self._length[row]
        width[gap] = [len(p) // 4 for p in parts]
        total = np.concatenate([[0], np.cumsum(width)])
        out, in_gap = np.empty(total[-1], np.uint32), np.repeat(gap, width)
        at = (np.repeat(self._start[row] - total[:-1], width) + np.arange(total[-1]))[~in_gap]
        out[~in_gap] = self._flat[at]
        out[in_gap] = np.frombuffer(b"".join(parts), "<u4")
        edges = total[np.cumsum([0, *map(len, rows)])]
        return [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


_CACHE: dict[str, _Frequent] = {}


def _frequent(name: str, table: pa.Table) -> _Frequent:
    """The worker's form of the broadcast table; kept between tasks of one worker."""
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = _Frequent(table)
    return _CACHE[name]


def _digest(data: bytes) -> bytes:
    """96 bits: among 10^10 texts, two of one digest have a chance below 10^-9."""
    return hashlib.blake2b(data, digest_size=12).digest()


def _packed(rows: np.ndarray, codec: pa.Codec) -> bytes:
    """Rows, frequent ones small, as compressed planes of low, middle and high bytes."""
    return codec.compress(rows.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int, codec: pa.Codec) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    out[:, :3] = np.frombuffer(codec.decompress(data, 3 * n, asbytes=True), np.uint8).reshape(3, n).T
    return out.view("<u4").ravel()


def _encoded(source: DataFrame, tokenizer_text: str, schema: str, finisher: Callable[[], Callable[[list[np.ndarray]], dict[str, list]]]) -> DataFrame:
    """``id`` and the columns that each task's ``finisher`` gives for the ids of texts, for every row of ``source``."""
    name, kind = uuid.uuid4().hex, dict(source.dtypes)["id"]
    shared = source.sparkSession.sparkContext.broadcast(frequent_words(source, tokenizer_text))

    salts = shuffle_partitions(source.sparkSession)

    def salt(own: Any, text: str) -> int:
        return zlib.crc32(repr(own).encode()) % salts + 1 if _LONG.search(text) else 0

    def key_of(text: str, salt: int) -> bytes:
        return _digest(b"%d " % salt + text.encode()) if salt else _digest(text.encode())

    def salted(batch: pa.RecordBatch) -> dict[tuple[str, int], list[Any]]:
        """Each text with its salt, and the ids of the rows that have it."""
        owners: dict[tuple[str, int], list[Any]] = {}
        for own, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            owners.setdefault((text, salt(own, text)), []).append(own)
        return owners

    def rare(batches: Iterator[pa.RecordBatch]):
        frequent = _frequent(name, shared.value)
        for batch in batches:
            texts = list(salted(batch))
            for k in range(0, len(texts), _ROWS):
                out: dict[str, list] = {"word": [], "key": [], "place": []}
                for text, own_salt in texts[k : k + _ROWS]:
                    words = [w for w in wordtable.cut(text) if w not in frequent]
                    out["word"] += words
                    out["key"] += [key_of(text, own_salt)] * len(words)
                    out["place"] += range(len(words))
                yield out

    def gapped(batches: Iterator[pa.RecordBatch]):
        frequent, codec = _frequent(name, shared.value), pa.Codec("zstd", compression_level=3)
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            owners = salted(batch)
            texts = list(owners)
            for k in range(0, len(texts), _ROWS):
                some = texts[k : k + _ROWS]
                rows = [frequent.rows(t) for t, _ in some]
                number += len(some)
                yield {
                    "key": [_digest(b"%d %d" % (part, number - j)) if r.all() else key_of(*t) for j, (t, r) in enumerate(zip(some, rows, strict=True))],
                    "place": [_TEXT] * len(some),
                    "ids": [_packed(r, codec) for r in rows],
                    "n": [len(r) for r in rows],
                    "owners": [owners[t] for t in some],
                }

    def assembled(batches: Iterator[pa.RecordBatch]):
        frequent, codec, finish = _frequent(name, shared.value), pa.Codec("zstd"), finisher()
        key, last, parts, waiting, size = None, -1, [], [], 0

        def finished():
            columns = finish(frequent.ids([rows for _, rows, _ in waiting], [p for _, _, filling in waiting for p in filling]))
            times = [len(own) for own, _, _ in waiting]
            again = {c: [v for v, n in zip(values, times, strict=True) for _ in range(n)] for c, values in columns.items()}
            return {"id": [o for own, _, _ in waiting for o in own]} | again

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "place", "ids", "n", "owners"))
            for own_key, place, data, n, owners in zip(*columns, strict=True):
                if own_key != key:
                    key, last, parts = own_key, -1, []
                if owners is None:
                    if place != last:  # copies in several batches name the same gap
                        parts.append(data)
                        last = place
                    continue
                waiting.append((owners, _unpacked(data, n, codec), parts))
                size += n + len(parts)
                if len(waiting) == _ROWS or size > _WORDS:
                    yield finished()
                    waiting, size = [], 0
        if waiting:
            yield finished()

    places = map_arrow(source, "word string, key binary, place int", rare)
    # a long word's rows are dealt by their text too, whose salted key spreads copies; no column travels for it
    spread = F.when(F.length("word") > HOT_LENGTH, F.pmod(F.xxhash64("key"), F.lit(salts)))
    # a word's rows side by side in its partition: encoded once, never gathered
    parts = _encoded_words(places.repartition("word", spread).sortWithinPartitions("word"), tokenizer_text)
    texts = map_arrow(source, f"key binary, place int, ids binary, n int, owners array<{kind}>", gapped)
    met = texts.unionByName(parts, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "place")
    return map_arrow(met, f"id {kind}, {schema}", assembled)


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(id, ids array<int>)`` of every row."""
    text = wordtable.tokenizer_json(tokenizer)
    encoded = _encoded(_source(docs, id_column, text_column), text, "ids array<int>", lambda: lambda ids: {"ids": ids})
    return encoded.withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``(id, text)``: the pieces of ``ids`` joined by single spaces; null ids give an empty text."""
    source = encoded.select(F.col(id_column).alias("id"), F.coalesce(F.col(ids_column), F.array().cast("array<int>")).alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(wordtable.pieces(wordtable.tokenizer_json(tokenizer)))

    def rows(batches: Iterator[pa.RecordBatch]):
        piece = np.array(shared.value, dtype=object)
        for batch in batches:
            texts = [" ".join(piece[np.asarray(ids, dtype=np.int64)]) for ids in batch.column("ids").to_pylist()]
            yield {"id": batch.column("id"), "text": texts}

    return map_arrow(source, f"id {dict(source.dtypes)['id']}, text string", rows).withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encode and decode every text: ``(id, n_tokens, ids_sha256, decoded_sha256)``."""
    text = wordtable.tokenizer_json(tokenizer)
    pieces = wordtable.pieces(text)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def digests():
        piece = np.array(shared.value, dtype=object)
        number = np.array([str(i) for i in range(len(piece))], dtype=object)
        joined = lambda names, ids: hashlib.sha256(" ".join(names[ids]).encode()).hexdigest()
        return lambda encoded: {
            "n_tokens": [len(i) for i in encoded],
            "ids_sha256": [joined(number, i) for i in encoded],
            "decoded_sha256": [joined(piece, i) for i in encoded],
        }

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(_source(docs, id_column, text_column), text, schema, digests).withColumnRenamed("id", id_column)
