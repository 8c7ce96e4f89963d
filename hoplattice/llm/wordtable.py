"""Words of the tokenizer, their ids, and a worker's table of them.

The tokenizer cuts a text into words (runs of letters, single digits, runs of
other marks) and nothing it does looks across them, so a text's ids are its
words' ids in order. Texts of Latin letters and ASCII marks are cut by the
tokenizer's own pattern here, and each distinct word goes through the merges
once. Any other text is cut at white space only, and each distinct run goes
through the whole tokenizer once.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

#: Distinct words that a worker holds; beyond it the table starts anew, so its memory is bounded.
MAX_WORDS = 700_000
#: And their characters.
MAX_CHARACTERS = 40_000_000

_NOT_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]|<\\|")
# Fixed value: the tokenizer's own pattern, with its classes spelt out for plain texts.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\\sa-zà-öø-ÿß0-9]+")
_SPACE = re.compile("[ \t\n\r]+")


class _Words(dict):
    """Word to its row; a missing word is encoded and gets the next row."""

    def __init__(self, ids_of) -> None:
        super().__init__()
        self.flat, self.ends, self._ids_of, self.characters = array("I"), array("q", [0]), ids_of, 0

    def __missing__(self, word: str) -> int:
        self.characters += len(word)
        self.flat.extend(self._ids_of(word))
        self.ends.append(len(self.flat))
        row = self[word] = len(self)
        return row

    def ids(self, rows: list[list[int]]) -> list[np.ndarray]:
        """Ids of each list of rows: those of its words, one after the other."""
        flat, ends = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.ends, np.int64)
        count = np.array([len(r) for r in rows], np.int64)
        row = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        length = ends[row + 1] - ends[row]
        total = np.zeros(len(row) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        ids = flat[np.repeat(ends[row] - total[:-1], length) + np.arange(total[-1])] if len(row) else np.zeros(0, np.uint32)
        edges = total[np.concatenate([[0], np.cumsum(count)])]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def cut(text: str) -> list[str]:
    """The text's words between white space, in order; those of a plain text in small letters."""
    return [w for w in _SPACE.split(text) if w] if _NOT_PLAIN.search(text) else text.lower().split()


class WordEncoder:
    """Ids of single words."""

    def __init__(self, tokenizer_json: str) -> None:
        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model

    def word(self, word: str) -> list[int]:
        """Of a word by the tokenizer's own pattern, plain and in small letters."""
        return [t.id for t in self._model.tokenize(word if word.isascii() else word.translate(_TRANSLATE))]

    def run(self, run: str) -> list[int]:
        """Of anything between white space, by the whole tokenizer."""
        return self._tokenizer.encode(run, add_special_tokens=False).ids

    def ids(self, word: str) -> list[int]:
        """Of a word as ``cut`` gives it."""
        return self.run(word) if _NOT_PLAIN.search(word) else [i for w in _WORD.findall(word.lower()) for i in self.word(w)]


class WordTable:
    """Encodes texts by their distinct words, kept in the worker."""

    def __init__(self, tokenizer_json: str) -> None:
        self._encoder = WordEncoder(tokenizer_json)
        self._clear()

    def _clear(self) -> None:
        self._words, self._runs = _Words(self._encoder.word), _Words(self._encoder.run)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self._words) + len(self._runs) > MAX_WORDS or self._words.characters + self._runs.characters > MAX_CHARACTERS:
            self._clear()
        words, runs = self._words, self._runs
        plain = [not _NOT_PLAIN.search(t) for t in texts]
        found = words.ids([[words[w] for w in _WORD.findall(t.lower())] for t, p in zip(texts, plain, strict=True) if p])
        other = runs.ids([[runs[w] for w in _SPACE.split(t) if w] for t, p in zip(texts, plain, strict=True) if not p])
        found.reverse()
        other.reverse()
        return [found.pop() if p else other.pop() for p in plain]


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte as a printable character."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in kept}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out


_LETTER_OF = _byte_letters()
_TRANSLATE = {c: "".join(_LETTER_OF[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


def byte_letters(word: str) -> str:
    """The word as byte-level vocabularies spell it."""
    if word.isascii() and word.isprintable():
        return word
    return "".join(_LETTER_OF[b] for b in word.encode())


_CACHE: dict[int, WordTable] = {}


def table_for(tokenizer_json: str) -> WordTable:
    """The worker's table of this tokenizer; kept between tasks of one worker."""
    key = hash(tokenizer_json)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = WordTable(tokenizer_json)
    return _CACHE[key]


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's text; by default the public word BPE of 49,408 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces(tokenizer_json_text: str) -> list[str]:
    """Piece of each id, special tokens included."""
    tokenizer = Tokenizer.from_str(tokenizer_json_text)
    return [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
