"""Column-level helpers shared by the feature and sizing operators."""

import math
import unicodedata
from statistics import NormalDist

from pyspark.sql import Column, functions as F

EPS = 1e-12


def col(x):
    return x if isinstance(x, Column) else F.col(x)


def num(x):
    return x if isinstance(x, Column) else F.lit(float(x))


def safe_div(a, b):
    """a / b, or 0 where the divisor is (almost) zero."""
    a, b = col(a), col(b)
    return F.when(F.abs(b) > EPS, a / b).otherwise(F.lit(0.0))


def change(a, b):
    """Guarded a / b - 1; a zero base gives -1."""
    return safe_div(a, b) - 1.0


def log_floor(x):
    return F.log(F.greatest(col(x), F.lit(EPS)))


def clamp(x, low, high):
    return F.least(F.greatest(col(x), num(low)), num(high))


def zero_if_null(x):
    return F.coalesce(col(x), F.lit(0.0))


def signed_square(r):
    r = col(r)
    return r * r * 100.0 * F.signum(r)


def optimizer_label(r, label="identity"):
    if label == "identity":
        return col(r)
    if label == "r2_sign_100":
        return signed_square(r)
    raise ValueError(f"unknown optimizer label: {label}")


def logit_clip(p, limit=10.0):
    p = clamp(p, 1e-15, 1.0 - 1e-15)
    return clamp(F.log(p / (1.0 - p)), -limit, limit)


def binary_entropy(p):
    p = clamp(p, 1e-15, 1.0 - 1e-15)
    return -(p * F.log(p) + (1.0 - p) * F.log(1.0 - p))


def probability_margin(p):
    return F.abs(col(p) - 0.5)


# Coefficients of the published double-precision rational form
# of the normal distribution function (Hart 1968, as printed by West 2005).
_HART_TOP = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
_HART_BOTTOM = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)


def _horner(coefficients, x):
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x):
    """Standard normal distribution function as a codegen-friendly expression."""
    x = col(x)
    a = F.abs(x)
    density = F.exp(-a * a / 2.0)
    inner = density * _horner(_HART_TOP, a) / _horner(_HART_BOTTOM, a)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    outer = density / fraction / math.sqrt(2.0 * math.pi)
    tail = F.when(a < 7.07106781186547, inner).when(a <= 37.0, outer).otherwise(0.0)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def normal_quantile(q):
    return NormalDist().inv_cdf(q)


def gaussian_projection(df, quantiles=(0.1, 0.5, 0.9)):
    """(session, mu, sigma) to the prediction contract under a normal return."""
    sigma = F.greatest(F.col("sigma"), F.lit(1e-9))
    low, mid, high = (normal_quantile(q) for q in quantiles)
    mu = F.col("mu")
    return df.select(
        "session",
        "mu",
        clamp(normal_cdf(mu / sigma), 0.0, 1.0).alias("p_up"),
        (mu + sigma * low).alias("q_lower"),
        (mu + sigma * mid).alias("q_median"),
        (mu + sigma * high).alias("q_upper"),
        F.greatest((mu + sigma * high) - (mu + sigma * low), F.lit(1e-6)).alias("u"),
        sigma.alias("sigma"),
        (sigma * sigma).alias("sigma2"),
    )


def empirical_projection(df):
    """Same contract from fitted quantile columns q10, q50, q90."""
    sigma = F.greatest(F.col("sigma"), F.lit(1e-9))
    return df.select(
        "session",
        "mu",
        clamp(normal_cdf(F.col("mu") / sigma), 0.0, 1.0).alias("p_up"),
        F.col("q10").alias("q_lower"),
        F.col("q50").alias("q_median"),
        F.col("q90").alias("q_upper"),
        F.greatest(F.col("q90") - F.col("q10"), F.lit(1e-6)).alias("u"),
        sigma.alias("sigma"),
        (sigma * sigma).alias("sigma2"),
    )


def decay_weight(bar_ix, confidence, decision_bar=49, half_life=10.0):
    gap = F.greatest(F.lit(float(decision_bar)) - col(bar_ix), F.lit(0.0))
    return F.exp(gap * (-math.log(2.0) / max(half_life, 1e-6))) * col(confidence)


def economic_weight(y, std, a=1.0, b=0.5, cap=4.0):
    scale = F.when(col(std) > EPS, col(std)).otherwise(1.0)
    return clamp(a + b * F.abs(col(y)) / scale, 0.0, cap)


def sentiment_sign(sentiment):
    return F.when(F.lower(col(sentiment)) == "buy", 1.0).otherwise(-1.0)


def class_decision(p_pos, p_neg, p_neu):
    """Score, side and confidence columns from three class probabilities."""
    score = col(p_pos) - col(p_neg)
    return [
        F.round(score, 4).alias("sentiment_score"),
        F.when(score > 0, "buy").otherwise("sell").alias("sentiment"),
        F.round(F.greatest(col(p_pos), col(p_neg), col(p_neu)), 4).alias("confidence"),
    ]


# Words that never join a sector name. The scoring form and the
# batch-prediction form differ on purpose.
SCORING_STOP_WORDS = (
    "Chief", "CEO", "CFO", "CTO", "names", "reports", "secures", "sees", "faces", "opens",
)
BATCH_STOP_WORDS = (
    "Chief", "CEO", "CFO", "CTO", "COO", "names", "reports", "secures", "sees", "faces",
    "opens", "Chairman", "Founder", "President", "Officer",
)
# Titles dropped from the first words of a headline.
TITLE_WORDS = ("ceo", "cto", "chief", "officer", "cfo", "founder", "to", "in", "board")


def words(text):
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(col(text), r"\s+"), lambda w: w != "")


# Characters of a text's end in which its outer words are looked for first.
NEAR = 256


def _enough(text, end, pattern):
    """The end of a text if it is all of it or the pattern in it shows that it suffices, else the text."""
    whole = F.octet_length(end) == F.octet_length(text)
    return F.when(whole | end.rlike(pattern), end).otherwise(text)


def leading_words(text, n=3):
    """The first n whitespace tokens; the rest of the text is not split.

    A text is read up to NEAR characters if n words end within them, so a long one costs no more.
    """
    text = col(text)
    start = _enough(text, F.substring(text, 1, NEAR), rf"^\s*(?:\S+\s+){{{n}}}")
    parts = F.split(F.regexp_replace(start, r"^\s+", ""), r"\s+", n + 1)
    return F.slice(F.filter(parts, lambda w: w != ""), 1, n)


def entity(text, missing="None"):
    w = leading_words(text, 1)
    return F.when(F.size(w) > 0, w[0]).otherwise(F.lit(missing))


def granular_sector(text, stop_words=SCORING_STOP_WORDS, missing="None"):
    w = leading_words(text, 3)
    joins = (F.size(w) > 2) & w[2].rlike(r"^\p{Lu}") & ~w[2].isin(*stop_words)
    return (
        F.when(F.size(w) < 2, F.lit(missing))
        .when(joins, F.concat_ws(" ", w[1], w[2]))
        .otherwise(w[1])
    )


def cleaned_entity(text):
    """First three words without verbs in -ing, plurals in -s (unless title case) and titles."""
    first = leading_words(text, 3)

    def title_case(w):
        return w.rlike(r"^\P{L}*\p{Lu}\p{Ll}*(\P{L}+\p{Lu}\p{Ll}*)*\P{L}*$")

    kept = F.filter(
        first,
        lambda w: (~(w.endswith("ing") | w.endswith("s")) | title_case(w))
        & ~F.lower(w).isin(*TITLE_WORDS),
    )
    return F.array_join(kept, " ")


def halfway_bar(n):
    n = col(n)
    return F.when((n >= 2) & (n % 2 == 0), F.floor(n / 2) - 1)


def _accent_pairs():
    """Single characters whose canonical form is a base letter plus marks."""
    source, target = [], []
    for code in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)):
        c = chr(code).lower()
        if len(c) != 1 or c in source:
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


ACCENTS, PLAIN = _accent_pairs()
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def normalised_text(text):
    """Lower case without accents; a text of ASCII characters has none to look up."""
    low = F.lower(col(text))
    return F.when(F.octet_length(col(text)) == F.length(col(text)), low).otherwise(F.translate(low, ACCENTS, PLAIN))


def text_tokens(text):
    return F.regexp_extract_all(normalised_text(text), F.lit(WORD_PATTERN), F.lit(0))


def first_word(text):
    """First token; only its own characters are normalised unless that leaves no token."""
    start = _enough(col(text), F.substring(col(text), 1, NEAR), WORD_PATTERN + r"[^\p{L}\p{N}_]")
    raw = F.regexp_extract(start, WORD_PATTERN, 0)
    word = F.regexp_extract(normalised_text(raw), WORD_PATTERN, 0)
    return F.when(word != "", word).otherwise(
        F.regexp_extract(normalised_text(text), WORD_PATTERN, 0)
    )


def last_word(text):
    """Last token, looked for as ``first_word`` looks for the first."""
    back = lambda c: F.reverse(F.regexp_extract(F.reverse(c), WORD_PATTERN, 0))
    end = _enough(col(text), F.substring(col(text), -NEAR, NEAR), r"[^\p{L}\p{N}_]" + WORD_PATTERN)
    word = back(normalised_text(back(end)))
    return F.when(word != "", word).otherwise(back(normalised_text(text)))


def md5_bucket(text, n):
    return F.conv(F.substring(F.md5(col(text)), 1, 8), 16, 10).cast("long") % n


def seeded_key(seed, *columns):
    """Reproducible shuffle key: the md5 text of seed|id."""
    parts = [F.lit(str(seed))] + [col(c).cast("string") for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def seeded_uniform(seed, *columns):
    """Uniform in (0, 1) from the shuffle key."""
    raw = F.conv(F.substring(seeded_key(seed, *columns), 1, 12), 16, 10).cast("double")
    return (raw + 0.5) / float(16**12)


def seeded_gaussian(seed, *columns):
    u = seeded_uniform(f"{seed}a", *columns)
    v = seeded_uniform(f"{seed}b", *columns)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)
