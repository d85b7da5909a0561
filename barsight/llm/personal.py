"""Personal data: spans from regular expressions, confirmed by checksums, scored by context.

DataFrame functions only.
"""

from pyspark.sql import functions as F

BLOCK = 256  # lengths that one running sum adds up; sums of blocks are added once more
BEFORE = 48  # code points before a span that are searched for context words
THRESHOLD = 0.6

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn"]

# What is looked for, one pattern a kind. Fixed values. A run of characters is entered at its
# start only (or where the last match ended), as a later start would fail like the first: so a
# long run costs one pass.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    # numbers without a country code, which need a context word; those with one are passed over
    "local": r"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9A-Za-z+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
# Card numbers inside a longer row of digits: one group, or four of four. Fixed value.
GROUPED = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"
# Score of a confirmed span without context; with the kind's own words; with words of something else. Fixed values.
SCORES = {"email": (0.8, 0.95, 0.7), "ip": (0.6, 0.9, 0.3), "card": (0.7, 0.95, 0.5), "phone": (0.7, 0.95, 0.5), "iban": (0.8, 0.95, 0.7), "ssn": (0.5, 0.9, 0.2), "local": (0.4, 0.8, 0.2)}
WORDS = {
    "email": r"e-?mail|mail|contact|write|reply",
    "ip": r"ip|address|host|server|client|login|from",
    "card": r"card|visa|master|amex|credit|debit|payment|pay|cc",
    "phone": r"phone|tel|telephone|call|mobile|cell|fax|sms|contact|whatsapp",
    "local": r"phone|tel|telephone|call|mobile|cell|fax|sms|contact|whatsapp",
    "iban": r"iban|account|bank|transfer|konto",
    "ssn": r"ssn|social|security|tax",
}
AGAINST = r"version|build|release|isbn|issn|order|invoice|ticket|sku|serial|part|model|section|article"


def luhn(digits):
    """The checksum of card numbers holds for a string of digits."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account):
    """The checksum of international account numbers: letters count 10 to 35, the head goes last."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.transform(F.split(turned, ""), value), F.lit(0), step) == 1


def _digits(text):
    return F.regexp_replace(text, "[^0-9]", "")


def _confirmed(kind, text):
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]|[0-9]{4,})"))
    n = F.length(_digits(text))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(text)
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9)|-00-|-0000$")
    return ~text.startswith("+")


def _let(value, use):
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def running(lengths):
    """Sums before each element. Two levels, so a list of n costs n^1.5 copied cells, not n^2."""

    def before(values):
        sums = F.aggregate(values, F.array(F.lit(0).cast("long")), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
        return F.slice(sums, 1, F.size(values))

    def summed(blocks):
        heads = before(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, v: a + v)))
        return F.flatten(F.zip_with(blocks, heads, lambda b, h: F.transform(before(b), lambda s: s + h)))

    def split(values):
        starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK))
        return F.transform(starts, lambda s: F.slice(values, s + 1, BLOCK))

    return _let(_let(lengths, split), summed)


def _none():
    return F.array().cast("array<struct<start:bigint,text:string,left:string>>")


def placed(text, found, pattern):
    """(start, text, left) of all matches of a pattern, in order; starts are code points from 0.

    A text is its matches and the pieces between them, so the starts are sums of their lengths.
    """

    def spans(between):
        gaps = F.transform(between, lambda a: F.length(a).cast("long"))
        steps = F.zip_with(gaps, found, lambda g, m: g + F.coalesce(F.length(m), F.lit(0)))
        starts = F.zip_with(running(steps), gaps, lambda s, g: s + g)
        rows = F.arrays_zip(F.slice(starts, 1, F.size(found)).alias("s"), found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"))
        return F.transform(rows, lambda x: F.struct(x["s"].alias("start"), x["m"].alias("text"), F.substring(x["b"], -BEFORE, BEFORE).alias("left")))

    return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), spans)).otherwise(_none())


def _grouped(rows):
    """Card numbers inside rows of more than 19 digits, or of fewer that the checksum refuses."""

    def of(row):
        found = F.regexp_extract_all(row["text"], F.lit(GROUPED), F.lit(0))
        inside = _let(found, lambda m: placed(row["text"], m, GROUPED))
        good = F.filter(inside, lambda x: luhn(_digits(x["text"])))
        return F.transform(good, lambda x: F.struct((row["start"] + x["start"]).alias("start"), x["text"].alias("text"), row["left"].alias("left")))

    return F.flatten(F.transform(F.filter(rows, lambda r: ~_confirmed("card", r["text"])), of))


def _scored(spans, kind, base, named=None):
    plain, up, down = SCORES[kind]

    def score(left):
        own = left.rlike(rf"(?i)(?<![A-Za-z])(?:{WORDS[kind]})(?![A-Za-z])")
        other = left.rlike(rf"(?i)(?<![A-Za-z])(?:{AGAINST})(?![A-Za-z])")
        return F.when(own, up).when(other, down).otherwise(plain)

    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(named or kind).alias("kind"),
            s["start"].alias("start"),
            (s["start"] + F.length(s["text"])).alias("end"),
            score(s["left"]).alias("score"),
            F.lit(base).alias("base"),
            s["text"].alias("text"),
        ),
    )


def _kept(kind):
    return F.filter(kind, lambda s: _confirmed(kind, s["text"]))


def _ordered(spans):
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    return F.when(F.size(spans) > 1, F.array_sort(spans, order)).otherwise(spans)


def _spans(rows, threshold):
    """Spans of the column ``text`` beside the column ``id``."""
    rows = rows.select("id", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in PATTERNS.items()])
    rows = rows.select("id", *[placed(F.col("text"), F.col(k), p).alias(k) for k, p in PATTERNS.items()])
    rows = rows.select(
        "id",
        F.when(F.size("card") > 0, _grouped(F.col("card"))).otherwise(_none()).alias("grouped"),
        *[_kept(k).alias(k) for k in PATTERNS],
    )
    scored = {k: _scored(F.col(k), k, k in KINDS, "phone" if k == "local" else None) for k in PATTERNS}
    scored["grouped"] = _scored(F.col("grouped"), "card", False)
    strong = {k: F.filter(c, lambda s: s["score"] >= threshold) for k, c in scored.items()}
    merged = [
        scored["email"],
        scored["ip"],
        _ordered(F.concat(scored["card"], strong["grouped"])),
        _ordered(F.concat(scored["phone"], strong["local"])),
        strong["iban"],
        strong["ssn"],
    ]
    return rows.select("id", F.concat(*merged).alias("spans"))


def find(docs, id_col="doc_id", text_col="text", threshold=THRESHOLD):
    """One row per input row: id, spans: array of (kind, start, end, score, base, text), in the order of KINDS and ADDED, then start.

    Patterns propose spans; the Luhn sum confirms cards, mod 97 account numbers, ranges addresses
    and social security numbers. The score starts from the kind's value and rises with a word of
    that kind within 48 code points before (up to the match before it), or falls with a word of
    something else. Spans of the four KINDS are base and stay whatever their score. Added are, from
    the threshold on: account numbers, social security numbers, telephone numbers without a
    country code, and card numbers inside rows of digits that are no card number as a whole.

    Starts are code points from 0, ends exclusive. Null and empty texts have no spans; null ids and
    repeated rows are kept. Rows are independent, so nothing is shuffled; the other columns are not
    read; an empty table gives no rows. Very long texts cost a pass per pattern; n matches in one
    text cost n^1.5 for their places.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return _spans(docs.select(F.col(id_col).alias("id"), text.alias("text")), threshold).withColumnRenamed("id", id_col)


def listed(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found, id_col="doc_id"):
    """id, n_<kind> of base spans, base_sha256, spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    rows = found.select(id_col, "spans", base.alias("base"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def mask(docs, text_col="text", threshold=THRESHOLD):
    """``docs`` with every found value replaced by its kind in brackets, longest values first; null stays null."""
    rows = docs.select(F.struct("*").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _spans(rows, threshold)
    values = F.transform("spans", lambda s: F.struct((-F.length(s["text"])).alias("n"), s["text"].alias("text"), s["kind"].alias("kind")))
    clean = F.aggregate(
        F.array_sort(F.array_distinct(values)),
        F.col(f"id.`{text_col}`"),
        lambda t, s: F.replace(t, s["text"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))),
    )
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"id.`{c}`").alias(c) for c in docs.columns])
