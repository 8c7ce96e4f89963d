"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

A word is split greedily into the longest pieces of a vocabulary. Its end is a
mark of its own, which a last piece may hold; left over alone, it costs nothing. The automaton is the trie of the pieces with failure
links: where no edge goes on, the link pops the pieces that greedy matching would
emit from the current path and leads to the path of what is left, so each
character is read once. Only the number of popped pieces is stored with a link;
pieces are never built. Each distinct word runs through the automaton once per
task; a text's count is the sum over its words. Nothing is shuffled.

Defined cases: a null or empty text has no tokens; a word that pieces can't spell
counts as one unknown token (``n_unknown`` tells how many); ids may be null and
repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.llm import wordtable
from hoplattice.llm.common import LONG_WORD, map_arrow

END = "</w>"
_MEMO_WORDS = 500_000


class Automaton:
    """States are the prefixes of pieces; state 0 is the empty prefix."""

    def __init__(self, pieces: list[str], end: str = END) -> None:
        edges: list[dict[str, int]] = [{}]
        accepts = [False]
        parent: list[tuple[int, str]] = [(0, "")]
        for piece in [*pieces, end]:
            at = 0
            # the end mark is one symbol, which no text can hold
            for symbol in [*piece.removesuffix(end), *([""] if piece.endswith(end) else [])]:
                following = edges[at].get(symbol)
                if following is None:
                    following = edges[at][symbol] = len(edges)
                    edges.append({})
                    accepts.append(False)
                    parent.append((at, symbol))
                at = following
            accepts[at] = at > 0
        link = [-1] * len(edges)
        popped = [0] * len(edges)
        queue = deque(edges[0].values())
        while queue:
            state = queue.popleft()
            queue.extend(edges[state].values())
            if accepts[state]:  # the whole path is a piece: pop it
                link[state], popped[state] = 0, int(parent[state] != (0, ""))
                continue
            before, symbol = parent[state]
            at, count = link[before], popped[before]
            while at >= 0 and symbol not in edges[at]:
                count += popped[at]
                at = link[at]
            if at >= 0:
                link[state], popped[state] = edges[at][symbol], count
        self._edges, self._link, self._popped = edges, link, popped

    def count(self, word: str) -> int:
        """Pieces of the word, or -1 if they can't spell it."""
        edges, link, popped = self._edges, self._link, self._popped
        at = total = 0
        for symbol in [*word, ""]:
            while (following := edges[at].get(symbol)) is None:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return -1
            at = following
        while at:
            total += popped[at]
            at = link[at]
            if at < 0:
                return -1
        return total


def greedy_count(word: str, pieces: set[str], end: str = END) -> int:
    """The same by plain search, for tests: tries every length at every place."""
    symbols, at, total, known = [*word, end], 0, 0, pieces | {end}
    while at < len(symbols):
        for stop in range(len(symbols), at, -1):
            if "".join(symbols[at:stop]) in known:
                break
        else:
            return -1
        total += symbols[at:stop] != [end]
        at = stop
    return total


def vocabulary(tokenizer: str | None = None) -> list[str]:
    """Pieces of the word BPE, in the printable spelling of bytes; special tokens left out."""
    return [p for p in wordtable.pieces(wordtable.tokenizer_json(tokenizer)) if not (p.startswith("<|") and p.endswith("|>"))]


class _Counts(dict):
    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self._automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self._automaton.count(wordtable.byte_letters(word))
        if len(word) <= LONG_WORD:
            self[word] = n
        return n


_CACHE: dict[int, _Counts] = {}


def count_tokens(docs: DataFrame, pieces: list[str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_tokens, n_words, n_unknown)`` of every lower-cased text, cut into words at white space.

    The vocabulary, whose size is fixed, is broadcast.
    """
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    chosen = vocabulary() if pieces is None else pieces
    key = hash(tuple(chosen))
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def rows(batches: Iterator[pa.RecordBatch]):
        if key not in _CACHE:  # kept between the tasks of one worker
            _CACHE.clear()
            _CACHE[key] = _Counts(Automaton(shared.value))
        counts = _CACHE[key]
        for batch in batches:
            if len(counts) > _MEMO_WORDS:
                counts.clear()
            out: dict[str, list] = {"n_tokens": [], "n_words": [], "n_unknown": []}
            for text in batch.column("text").to_pylist():
                found = np.array([counts[w] for w in text.lower().split()], np.int64)
                out["n_tokens"].append(int(np.abs(found).sum()))  # an unknown word is -1 here and one token
                out["n_words"].append(len(found))
                out["n_unknown"].append(int((found < 0).sum()))
            yield {"id": batch.column("id")} | out

    schema = f"id {dict(source.dtypes)['id']}, n_tokens long, n_words long, n_unknown long"
    return map_arrow(source, schema, rows).withColumnRenamed("id", id_column)
