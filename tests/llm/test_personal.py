"""Personal data against a plain version."""

import hashlib
import re

import pyarrow.parquet as pq
import pytest

from barsight.llm import personal
from llm.edge import ROWS, table

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in text.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
        "iban": lambda: mod97(text),
        "ssn": lambda: not re.match("000|666|9", text) and text[4:6] != "00" and text[7:] != "0000",
        "local": lambda: text[0] != "+",
    }[kind]()


def scored(kind, left):
    plain, up, down = personal.SCORES[kind]
    if re.search(rf"(?i)(?<![A-Za-z])(?:{personal.WORDS[kind]})(?![A-Za-z])", left):
        return up
    return down if re.search(rf"(?i)(?<![A-Za-z])(?:{personal.AGAINST})(?![A-Za-z])", left) else plain


def matches(pattern, text):
    last = 0
    for m in re.finditer(pattern, text):
        yield m.start(), m.group(), text[last : m.start()][-48:]
        last = m.end()


def plain(text):
    """(all spans, base spans) as (kind, start, end)."""
    text = text or ""
    base, more = [], []
    for kind, pattern in BASE.items():
        for start, m, left in matches(pattern, text):
            if good(kind, m):
                base.append((kind, start, start + len(m)))
            elif kind == "card" and scored("card", left) >= personal.THRESHOLD:
                for at, g, _ in matches(personal.GROUPED, m):
                    if luhn(re.sub("[^0-9]", "", g)):
                        more.append(("card", start + at, start + at + len(g)))
    for kind in ("iban", "ssn", "local"):
        for start, m, left in matches(personal.PATTERNS[kind], text):
            if good(kind, m) and scored(kind, left) >= personal.THRESHOLD:
                more.append(("phone" if kind == "local" else kind, start, start + len(m)))
    rank = personal.KINDS + personal.ADDED
    order = lambda s: (rank.index(s[0]), s[1])
    return sorted(base + more, key=order), sorted(base, key=order)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def summary(i, text):
    spans, base = plain(text)
    counts = [sum(s[0] == k for s in base) for k in personal.KINDS]
    return (i, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))


TEXTS = [
    "mail a.b+c@d-e.example.com, a@b, a@b.c_d@e.fg and x@y.z.",
    "@a.b .@c.d 漢字 ☃😀 someone@host.example ünï@x.y",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.256.1.1 00001.002.3.0255 version 1.2.3.4 1.2.3 10.0.0.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4465758382889437 4465758382889437 5 x 7 88",
    "1 4111111111111111 | order 4111111111111111 4111111111111111 | 12345678901234567890123",
    "1234 4111 1111 1111 1111 card 99 4111 1111 1111 1111 22",
    "+1 (743) 555-3824 call (743) 555-3824 or 743.555.3824; order 743-555-3824; +12 3456; +1 ((((( +1-1",
    "+123456789012345678 tel +1 2 743-555-3824 phone:(743)555-3824x",
    "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, DE89370400440532013001 XX00",
    "ssn 123-45-6789 social 000-12-3456 order 123-45-6789 123-45-6789 tax 666-11-1111-2",
    "a" * 20000 + "@" + "b." * 20000 + "c 1" + ".1" * 20000 + " +1" + " " * 20000 + "2",
    "9" * 50000,
    "1 " * 30000,
    "x@y.zz " * 3000 + "4111111111111111,",
    "+" * 5000 + "1" * 9,
]


def test_equals_plain_version(spark):
    rows = ROWS + [(200 + i, t) for i, t in enumerate(TEXTS)] + [(200, TEXTS[0])]
    found = personal.find(table(spark, rows))
    assert found.columns == ["doc_id", "spans"]
    got = personal.summary(found)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    want = sorted((summary(i, t) for i, t in rows), key=key)
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), want, strict=True):
        assert a == b
    text = dict((i, t) for i, t in rows if i is not None)
    for r in found.where("doc_id >= 200").collect():
        for s in r["spans"]:
            assert text[r["doc_id"]][s["start"] : s["end"]] == s["text"]


def test_whole_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = {r["doc_id"]: tuple(r) for r in personal.summary(personal.find(spark.read.parquet(path))).collect()}
    docs = pq.read_table(path).to_pydict()
    assert got == {i: summary(i, t) for i, t in zip(docs["doc_id"], docs["text"])}


def test_places_of_many_matches(spark):
    text = "".join(f"{'z' * (i % 5)} u{i}@h.org" for i in range(2000))
    spans = personal.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [(s["start"], s["end"]) for s in spans if s["kind"] == "email"] == [m.span() for m in re.finditer(BASE["email"], text)]


@pytest.mark.parametrize("text,masked", [("to a@b.cc or +1 743 555 3824", "to [EMAIL] or [PHONE]"), ("nothing 1.2", "nothing 1.2"), (None, None), ("", "")])
def test_mask(spark, text, masked):
    docs = table(spark, [(1, text)])
    out = personal.mask(docs)
    assert out.columns == docs.columns and out.first()["text"] == masked


def test_empty_table(spark):
    assert personal.summary(personal.find(table(spark, []))).collect() == []
