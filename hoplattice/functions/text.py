"""Scalar text functions: ids, order keys, normal forms, mentions, windows and paragraphs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_id(title: Column, text: Column) -> Column:
    """First 16 hex digits of sha1 over title, newline, text."""
    return F.substring(F.sha1(F.concat(title, F.lit("\n"), text)), 1, 16)


def order_key(key: Column, seed: int = 42) -> Column:
    """sha1 of ``seed:key``, the order of subsets and splits."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def salted_order_key(title: Column, text: Column, salt: str = "42") -> Column:
    """sha256 over salt, title and text, the order of nested corpora."""
    return F.sha2(F.concat(F.lit(f"{salt}\n"), title, F.lit("\n"), text), 256)


def collapsed(text: Column) -> Column:
    """White space runs to one space, trimmed; the case is kept. Exact for text that is in NFC."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def _nfc_collapsed(text: str | None, fold: bool) -> str | None:
    if text is None:
        return None
    out = " ".join(unicodedata.normalize("NFC", text).split())
    return out.casefold() if fold else out


@F.pandas_udf(T.StringType())
def normalized_text(text: pd.Series) -> pd.Series:
    """NFC, white space collapsed, trimmed; the case is kept."""
    return text.map(lambda t: _nfc_collapsed(t, False))


@F.pandas_udf(T.StringType())
def normalized_title(title: pd.Series) -> pd.Series:
    """NFC, white space collapsed, trimmed, case folded."""
    return title.map(lambda t: _nfc_collapsed(t, True))


# The characters that node forms fold.
_QUOTES = str.maketrans(dict.fromkeys("‘’‚‛′", "'") | dict.fromkeys("“”„‟″«»", '"'))
_BREAKS = re.compile("[-_/‐‑‒–—―−﹘﹣－]")
_ARTICLES = ("the", "a", "an")
_KERNEL = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)


def node_form(text: str | None) -> str | None:
    """Comparable form of a name: no accents or case, plain quotes, dashes as spaces, no edge marks, no leading article."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text))
    plain = "".join(c for c in plain if not unicodedata.combining(c)).casefold().translate(_QUOTES)
    kernel = _KERNEL.search(_BREAKS.sub(" ", plain))
    words = kernel[0].split() if kernel else []
    return " ".join(words[1:] if len(words) > 1 and words[0] in _ARTICLES else words)


@F.pandas_udf(T.StringType())
def node_forms(text: pd.Series) -> pd.Series:
    """``node_form`` of a column."""
    return text.map(node_form)


def occurs(form: Column, text: Column) -> Column:
    """Whether the form stands in the text with no word character beside it; a form is never read as a pattern."""
    quoted = F.replace(form, F.lit(r"\E"), F.lit(r"\E\\E\Q"))  # an end of quoting within the form is quoted by itself
    return F.rlike(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), quoted, F.lit(r"\E(?!\w)")))


_MENTION = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))


def mentions_in(form: str, text: str) -> list[tuple[int, int, int]]:
    """Every non-overlapping mention: offset, first and last word it touches (words are runs without white space)."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    out = []
    for m in re.finditer(rf"(?<!\w){re.escape(form)}(?!\w)", text) if form else ():
        touched = [k for k, (a, b) in enumerate(words) if a < m.end() and m.start() < b]
        out.append((m.start(), touched[0], touched[-1]))
    return out


@F.pandas_udf(_MENTION)
def mentions(form: pd.Series, text: pd.Series) -> pd.Series:
    """``mentions_in`` of two columns; nulls have none."""
    return pd.Series([
        [{"offset": o, "first_word": a, "last_word": b} for o, a, b in mentions_in(f, t)] if f is not None and t is not None else []
        for f, t in zip(form, text, strict=True)
    ])


def mention_window(text: Column, first_word: Column, last_word: Column, width: int = 5) -> Column:
    """Up to ``width`` words on either side of a mention, which is itself left out."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    before = F.slice(words, F.greatest(first_word - width + 1, F.lit(1)).cast("int"), F.least(first_word, F.lit(width)).cast("int"))
    after = F.slice(words, (last_word + 2).cast("int"), F.lit(width))
    return F.concat_ws(" ", before, after)


def paragraphs(docs: DataFrame, id_column: str, body_column: str) -> DataFrame:
    """``(id, position, text, start, end)``: lines that aren't blank, stripped, with their span in the body."""
    lines = docs.select(F.col(id_column).alias("id"), F.posexplode(F.split(F.col(body_column), "\n", -1)).alias("line", "raw"))
    w = Window.partitionBy("id").orderBy("line")
    before = F.sum(F.length("raw") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    text = F.regexp_replace("raw", r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^[ \t\r\f\x0B]+", ""))
    placed = lines.select("id", "line", text.alias("text"), (F.coalesce(before, F.lit(0)) + lead).alias("start")).where("text <> ''")
    position = F.row_number().over(w) - 1
    return placed.select("id", position.alias("position"), "text", "start", (F.col("start") + F.length("text")).alias("end"))


def dense_rank_class(rank: Column) -> Column:
    """Where a unit stood in the dense list; a missing rank is beyond it."""
    return F.when(rank <= 10, "1-10").when(rank <= 100, "11-100").otherwise("beyond-100")


def positional_id(position: Column, prefix: str = "mhr") -> Column:
    return F.format_string(f"{prefix}-%04d", position)


def percent(share: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit(" %"))


def points(difference: Column, digits: int = 2) -> Column:
    """A signed difference of shares in percentage points."""
    return F.format_string(f"%+.{digits}f pp", difference * 100)


def windows_under(segments: Column, counts: Column, limit: int) -> Column:
    """Greedy runs of segments (title first, then sentences) whose token counts stay within the limit; one segment at least each."""
    pairs = F.arrays_zip(segments.alias("s"), counts.alias("n"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("long").alias("used"))

    def add(state, item):
        fits = (F.size(state["open"]) == 0) | (state["used"] + item["n"] <= limit)
        return F.struct(
            F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(F.array_join(state["open"], " ")))).alias("done"),
            F.when(fits, F.concat(state["open"], F.array(item["s"]))).otherwise(F.array(item["s"])).alias("open"),
            F.when(fits, state["used"] + item["n"]).otherwise(item["n"]).cast("long").alias("used"),
        )

    def finish(state):
        return F.when(F.size(state["open"]) > 0, F.concat(state["done"], F.array(F.array_join(state["open"], " ")))).otherwise(state["done"])

    return F.aggregate(pairs, start, add, finish)


def span_record(forms: Column, most: int = 50, longest: int = 120) -> Column:
    """Stripped, non-empty, distinct forms in order, and ``ok`` or ``failed`` where a bound is broken."""
    clean = F.array_distinct(F.filter(F.transform(forms, lambda f: F.trim(f)), lambda f: f != ""))
    sound = (F.size(clean) <= most) & ~F.exists(clean, lambda f: F.length(f) > longest)
    return F.struct(F.when(sound, "ok").otherwise("failed").alias("status"), F.when(sound, clean).otherwise(F.array().cast("array<string>")).alias("forms"))


def validated_answer(answer: Column, most: int = 50, longest: int = 120) -> Column:
    """A model's JSON answer ``{"entities": [...], "concepts": [...]}`` as (status, entities, concepts, failure)."""
    parsed = F.from_json(answer, "entities array<string>, concepts array<string>")
    none = F.array().cast("array<string>")
    broken = lambda a: (F.size(a) > most) | F.exists(a, lambda f: f.isNull() | (F.length(f) > longest))
    failure = (
        F.when(parsed.isNull() | (parsed["entities"].isNull() & parsed["concepts"].isNull()), "not json")
        .when(parsed["entities"].isNull() | parsed["concepts"].isNull(), "missing list")
        .when(broken(parsed["entities"]) | broken(parsed["concepts"]), "out of bounds")
    )
    ok = failure.isNull()
    return F.struct(
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(ok, parsed["entities"]).otherwise(none).alias("entities"), F.when(ok, parsed["concepts"]).otherwise(none).alias("concepts"), failure.alias("failure"),
    )


def rendered_prompt(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` places filled by columns."""
    out = F.lit(template)
    for name, column in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column, F.lit("")))
    return out
