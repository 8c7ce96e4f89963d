"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Four kinds have fixed patterns and are always kept once they pass their own test
(``BASE``): e-mail addresses, IPv4 addresses with parts up to 255, card numbers that
pass Luhn's check, and international phone numbers of 9 to 15 digits. Matches are
leftmost and do not overlap within a kind; one that fails its test is not tried
again at another place. Further kinds (``ADDED``) need a score of ``threshold``:
account numbers that pass mod 97, card numbers inside longer runs of digits,
national numbers and local phone numbers. A kind starts from its own score, a passed
checksum raises it, words of its list within ``BEFORE`` characters before or
``AFTER`` behind raise it, and words that tell of something else (versions, orders,
parts) lower it. An added span never overlaps one of the base; of two added spans
that overlap the higher score stays, then the first.

Every pattern takes time linear in the text: runs are entered at their start only,
and an address is read outward from its ``@``. One pass over the rows, no shuffle; workers hold one batch.

Defined cases: a null or empty text has no spans; ids may be null and repeat; other
columns, whatever their names, are not read; offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoplattice.llm.common import bounded_batches, map_arrow

#: Kinds with a fixed pattern, in their order, and those that a score decides.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card_part", "national_id", "local_phone")
KINDS = BASE + ADDED
THRESHOLD = 0.5
#: Characters before and behind a span in which words are looked for.
BEFORE, AFTER = 48, 24

# The four patterns, written so that no run is entered twice.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_CARD_PART = re.compile(r"(?<![0-9])(?:[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_WORD = re.compile("[^\\W\\d_]+")
_DIGIT = re.compile("[0-9]")

#: A kind's score before anything else is known, and what a passed checksum adds.
START = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "card_part": 0.2, "national_id": 0.4, "local_phone": 0.4}
CHECKED = {"card": 0.3, "iban": 0.4, "card_part": 0.2}
#: What a word of the kind's list nearby adds, and one that tells of something else takes away.
NEARBY = 0.2
WORDS: dict[str, frozenset[str]] = {
    "email": frozenset("email mail contact write address courriel correo kontakt".split()),
    "ip": frozenset("ip host server client address login adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit payment carte karte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp contact telefon téléphone teléfono".split()),
    "iban": frozenset("iban account bank transfer konto compte cuenta".split()),
    "national_id": frozenset("ssn social security national insurance taxpayer".split()),
}
WORDS |= {"card_part": WORDS["card"], "local_phone": WORDS["phone"]}
OTHERWISE = frozenset("version release build order invoice isbn sku serial part model revision ticket".split())


def luhn(digits: str) -> bool:
    """Luhn's check: every second digit from the right is doubled, nines cast out, and the sum ends in zero."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def mod_97(account: str) -> bool:
    """The first four characters go to the end, letters count from 10, and the remainder by 97 is one."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, floor
        at = text.find("@", floor)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def _digits(text: str) -> str:
    return text.translate(_NO_SIGNS)


_NO_SIGNS = str.maketrans("", "", " ().+-")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield m.span()


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        cuts = [m.end()] + [k for k in range(m.end() - 1, m.start() + 14, -1) if text[k] == " "]
        for end in cuts:  # words in capitals behind the number may have been taken with it
            if 15 <= len(account := text[m.start() : end].replace(" ", "")) <= 34 and mod_97(account):
                yield m.start(), end
                break


def _card_parts(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD_PART.finditer(text):
        if m[0][0] in "23456" and luhn(_digits(m[0])):
            yield m.span()


def _spans(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


#: What proposes the spans of each kind, with the kind's own test.
PROPOSE: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": _emails, "ip": _ips, "card": _cards, "phone": _phones,
    "iban": _accounts, "card_part": _card_parts, "national_id": _spans(_NATIONAL), "local_phone": _spans(_LOCAL_PHONE),
}


def score(text: str, kind: str, start: int, end: int) -> float:
    """From 0 to 1: the kind's start, its checksum, and the words nearby."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - BEFORE) : start])} | {w.lower() for w in _WORD.findall(text[end : end + AFTER])}
    moved = NEARBY * bool(near & WORDS[kind]) - NEARBY * bool(near & OTHERWISE)
    return round(min(1.0, max(0.0, START[kind] + CHECKED.get(kind, 0.0) + moved)), 3)


def find_in(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` of all spans, by kind in the order of ``KINDS`` and then by start."""
    found = [(kind, a, b, score(text, kind, a, b)) for kind in BASE for a, b in PROPOSE[kind](text)]
    if not _DIGIT.search(text):  # every further kind has digits
        return found
    rated = [(kind, a, b, s) for kind in ADDED for a, b in PROPOSE[kind](text) if (s := score(text, kind, a, b)) >= threshold]
    if rated:
        taken = sorted((a, b) for _, a, b, _ in found)
        for span in sorted(rated, key=lambda r: (-r[3], r[1], KINDS.index(r[0]))):
            if not any(a < span[2] and span[1] < b for a, b in taken):
                taken.append((span[1], span[2]))
                found.append(span)
        found.sort(key=lambda r: (KINDS.index(r[0]), r[1]))
    return found


_SPAN = "struct<kind: string, start: long, end: long, score: double>"


def find(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each of ``docs``: its id and ``found``, the array of its spans with their scores."""
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            spans = ([dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_in(t, threshold)] for t in batch.column("text").to_pylist())
            yield {"id": batch.column("id"), "found": list(spans)}

    return map_arrow(source, f"id {dict(source.dtypes)['id']}, found array<{_SPAN}>", rows).withColumnRenamed("id", id_column)


def _of(spans: str, kinds: Iterable[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, for each row."""
    found = find(docs, threshold, id_column, text_column)
    counts = (F.size(_of("found", [kind])).cast("long").alias(f"n_{kind}") for kind in BASE)
    return found.select(id_column, *counts, F.sha2(_joined(_of("found", BASE)), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping ones the first by start stands for all."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def without_pii(docs: DataFrame, threshold: float = THRESHOLD, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind, and the length column brought up to date where a text changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text_column)).to_pylist()
            new = [masked(t, s) if t and (s := find_in(t, threshold)) else t for t in texts]
            place = names.index(text_column)
            batch = batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
            if length_column in names:
                place = names.index(length_column)
                kept = batch.column(place).to_pylist()
                length = [n if t is u else len(u) for t, u, n in zip(texts, new, kept, strict=True)]
                batch = batch.set_column(place, batch.schema.field(place), pa.array(length, batch.schema.field(place).type))
            yield batch

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
