"""Personal data against plain patterns, scores, masks and defined cases."""

import hashlib
import random
import re
import time

from hoplattice.llm import pii

# The contract's patterns as they are written.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(digits[::-1])]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def base_of(text):
    return [s[:3] for s in pii.find_in(text) if s[0] in pii.BASE]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    for alphabet in ("ab@.-_ 1", "0123456789 -.", "+0123456789() .-x", "a@b.c@d.e 25.6+", "0189.+- @é"):
        for _ in range(6_000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert base_of(text) == brute(text), text


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod_97("DE89370400440532013000") and not pii.mod_97("DE88370400440532013000")
    assert pii.mod_97("GB82WEST12345698765432")


def test_words_nearby_decide_the_added_kinds():
    found = lambda t: {s[0] for s in pii.find_in(t)}
    assert found("ssn 123-45-6789") == {"national_id"} and found("part 123-45-6789") == set() == found("x 123-45-6789")
    assert found("call (415) 555-2671") == {"local_phone"} and found("order (415) 555-2671") == set()
    assert found("to DE89 3704 0044 0532 0130 00 AND MORE") == {"iban"} and found("to DE88 3704 0044 0532 0130 00") == set()
    assert [s for s in pii.find_in("credit card 12 4111 1111 1111 1111")] == [("card_part", 15, 34, 0.6)]
    assert found("phone +1 (297) 555-8151") == {"phone"}  # an added span never overlaps the base
    assert pii.score("server 10.0.0.1", "ip", 7, 15) > pii.score("release 10.0.0.1", "ip", 8, 16)


def test_time_is_linear_in_long_texts():
    for unit in ("a", "1", "1.", "+1", "@a", "a@b.", "+1 (", "1 ", "AB12", "123-"):
        began = time.perf_counter()
        pii.find_in(unit * (300_000 // len(unit)))
        assert time.perf_counter() - began < 10


def test_rows_digests_and_odd_cases(spark):
    texts = {1: "mail a.b@x.org or +1 (297) 555-8151", 2: None, 3: "", 4: "é 😀 192.168.1.1 und 4111 1111 1111 1111", 5: "300.1.1.1", 6: "ssn 123-45-6789"}
    rows = [(i, t, "x", 9.0) for i, t in texts.items()] + [(None, "a@b.c", "x", 9.0), (1, texts[1], "x", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, score double").repartition(3)
    got = pii.scan(docs).collect()
    assert len(got) == 8 and pii.scan(docs.limit(0)).count() == 0
    for row in got:
        text = "a@b.c" if row["doc_id"] is None else texts[row["doc_id"]] or ""
        base = brute(text)
        assert row["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert row["spans"] == joined([s[:3] for s in pii.find_in(text)])
    assert {r["doc_id"]: r["spans"] for r in got}[6] == "national_id:4:15"


def test_masks_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "to a@b.c now", 12), (2, "clean", 5), (3, None, None), (4, "card 4111 1111 1111 1111.", 25)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.without_pii(docs).collect()}
    assert got == {1: ("to [EMAIL] now", 14), 2: ("clean", 5), 3: (None, None), 4: ("card [CARD].", 12)}
