"""Where a unit's own nodes are named in its text: sentences, mentions, and the words around them.

Each row brings one text and the forms of its own nodes; a worker builds one automaton of these forms
and reads each sentence once, so the work is that of the text and not of text times forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# What ends a sentence, and what parts words (ASCII white space).
_SENTENCE = re.compile(r"[.!?][ \t\n\r\f\v]+|\n+")
_WORD = re.compile(r"[^ \t\n\r\f\v]+")
#: Words on either side of a mention.
WIDTH = 5


def sentences(text: str) -> list[str]:
    """Pieces of a text that are not blank, in order."""
    return [p for p in _SENTENCE.split(text) if p.strip(" \t\n\r\f\v")]


def _bounded(text: str, start: int, end: int) -> bool:
    inner = lambda c: c.isalnum() or c == "_"
    return not (start and inner(text[start - 1])) and not (end < len(text) and inner(text[end]))


def find(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[int]]:
    """Offsets of each form's mentions: no word character beside them, and those of one form do not overlap."""
    out: dict[str, list[int]] = {}
    for last, form in automaton.iter(text):
        start = last + 1 - len(form)
        if _bounded(text, start, last + 1) and (form not in out or out[form][-1] + len(form) <= start):
            out.setdefault(form, []).append(start)
    return out


def automaton_of(forms: Iterator[str]) -> ahocorasick.Automaton | None:
    """None without a form that isn't empty."""
    made = ahocorasick.Automaton()
    for form in forms:
        if form:
            made.add_word(form, form)
    if not len(made):
        return None
    made.make_automaton()
    return made


def window(spans: list[tuple[int, int]], sentence: str, start: int, end: int, width: int = WIDTH) -> str:
    """Up to ``width`` words on either side; every word that the mention touches is masked."""
    touched = [k for k, (a, b) in enumerate(spans) if a < end and start < b]
    near = spans[max(0, touched[0] - width) : touched[0]] + spans[touched[-1] + 1 : touched[-1] + 1 + width]
    return " ".join(sentence[a:b] for a, b in near)


_LOCATED = "sentence int, offset int, said string, window string"


def located(texts: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(qid, node_id, named, sentence, offset, said, window)``: every mention of a unit's own nodes.

    ``texts(qid, unit_id, text, question)``, ``nodes(unit_id, node_id, form)``. ``said`` is the sentence, ``window``
    the words around the mention (empty where there are none), ``named`` tells that the question names the node. A node that no sentence names has one row with a null sentence. A
    unit's nodes fit a row, as they are in its text.
    """
    own = nodes.groupBy("unit_id").agg(F.collect_set(F.struct("node_id", "form")).alias("own"))
    rows = texts.select("qid", "unit_id", "text", "question").join(own, "unit_id").select("qid", "text", "question", "own")
    kinds = dict(texts.dtypes) | dict(nodes.dtypes)

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for qid, text, question, own in zip(*(batch.column(c).to_pylist() for c in ("qid", "text", "question", "own")), strict=True):
                automaton = automaton_of(n["form"] for n in own)
                named = find(question or "", automaton) if automaton else {}
                said: dict[str, list[tuple[int, int, str, str]]] = {}
                for k, sentence in enumerate(sentences(text or "")) if automaton else ():
                    spans = [m.span() for m in _WORD.finditer(sentence)]
                    for form, starts in find(sentence, automaton).items():
                        said.setdefault(form, []).extend((k, a, sentence, window(spans, sentence, a, a + len(form), width)) for a in starts)
                for n in own:
                    out += [(qid, n["node_id"], n["form"] in named, *m) for m in said.get(n["form"], [(None, None, None, None)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    schema = f"qid {kinds['qid']}, node_id {kinds['node_id']}, named boolean, {_LOCATED}"

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return rows.mapInArrow(mentions, schema)
