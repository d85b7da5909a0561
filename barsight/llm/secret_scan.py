"""Secret scanning: candidates, features, and a random forest that removes false positives.

DataFrame functions only; the forest is the JVM's own.
"""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from barsight.session import cut_lineage

SAMPLE = 5000  # labelled findings of each kind that the forest is trained on, at most
LISTED = 1_000_000
KNOWN_SHARE = 1e-4  # of all rows (two at least) that a word of the dictionary stands in
MASK = "[SECRET]"

# Where candidates come from. Fixed values.
TOKEN = r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_.-]{0,40}[0-9])[A-Za-z0-9+/_.-]{11,}[A-Za-z0-9+/](?![A-Za-z0-9@])"
KEYS = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credentials?|private[_-]?key"
ASSIGNED = rf"(?i)(?:{KEYS})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?([^\s\"']{{6,}})"
# A private key from its first line to its last; without a last line, up to the end of its base64 lines. Fixed value.
KEY_BLOCK = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:\s|\\[nr]){1,4}+[A-Za-z0-9+/]{16,}+={0,2})*+(?:(?:\s|\\[nr]){1,4}+[A-Za-z0-9+/]+={1,2})?)"
)
# Formats of issued credentials: what matches is a labelled true finding. Fixed values.
FORMATS = [
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[opsur]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    KEY_BLOCK,
]
# Neighbours that speak for something public. Fixed values.
PUBLIC = r"(?i)\b(?:sha(?:1|256|512)?|md5|commit|checksum|digest|hash|uuid|guid|version|isbn|issn|doi|build|revision|phone|tel|fax|license)\b"
FEATURES = [
    "length", "digits", "uppers", "letter_digit", "upper_lower", "same_kind", "distinct", "consonants", "hex", "dictionary",
    "slashes", "dots", "path", "address", "key_near", "assigned", "quoted", "public_near", "form",
]


def candidates(docs, id_col="doc_id", text_col="text"):
    """(id, finding, candidate, start, occurrences, left, right): one row per finding and distinct neighbourhood.

    A finding is a row of ``docs`` and a distinct candidate. Every place of the candidate counts, also
    those inside longer tokens; places with equal neighbours are one row. A private key is one
    candidate from its first line to its last; nothing is looked for inside it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # no value is assigned over four line ends
    outside = F.regexp_replace(text, KEY_BLOCK, "\n\n\n\n")
    found = F.concat(
        F.regexp_extract_all(outside, F.lit(TOKEN), F.lit(0)),
        F.regexp_extract_all(outside, F.lit(ASSIGNED), F.lit(1)),
        F.regexp_extract_all(outside, F.lit("(?<![A-Za-z0-9])(?:" + "|".join(FORMATS) + ")(?![A-Za-z0-9])"), F.lit(0)),
    )
    trimmed = F.transform(found, lambda c: F.regexp_replace(c, r"[.,;:!?)\]}>]+$", ""))
    trimmed = F.array_distinct(F.concat(trimmed, F.regexp_extract_all(text, F.lit(KEY_BLOCK), F.lit(0))))
    trimmed = F.filter(trimmed, lambda c: F.length(c) >= 6)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.explode(trimmed).alias("candidate"))
    quoted = F.concat(F.lit("\\Q"), F.replace("candidate", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    between = rows.select("id", "candidate", F.split("text", quoted, -1).alias("between"))
    pieces, n = F.col("between"), F.size("between")

    def beside(i):
        # a candidate has 6 characters at least, so these pieces hold all neighbours
        first = F.greatest(i - 10, F.lit(1))
        before = F.call_function("array_join", F.slice(pieces, first, i - first + 1), F.col("candidate"))
        after = F.call_function("array_join", F.slice(pieces, i + 1, F.lit(6)), F.col("candidate"))
        return F.struct(F.substring(before, -60, 60).alias("left"), F.substring(after, 1, 30).alias("right"))

    # numbered before the places are spread, so all places of a finding have its number
    findings = between.select(
        "id",
        F.monotonically_increasing_id().alias("finding"),
        "candidate",
        (F.length(pieces[0]) + 1).cast("long").alias("start"),
        (n - 1).cast("long").alias("occurrences"),
        F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), beside)).alias("beside"),
    )
    return findings.withColumn("beside", F.explode("beside")).select("id", "finding", "candidate", "start", "occurrences", "beside.*")


def _parts(candidate):
    return F.regexp_extract_all(F.lower(candidate), F.lit("([a-z]{4,})"), F.lit(1))


def dictionary(docs, parts, text_col="text"):
    """Words of the texts, of those in ``parts``, that stand in a large enough share of the rows."""
    if parts.count() <= LISTED:
        parts = F.broadcast(parts)
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?<![a-z0-9])([a-z]{4,})(?![a-z0-9])"), F.lit(1))
    words = docs.select(F.explode(F.array_distinct(found)).alias("part"))
    least = max(2, KNOWN_SHARE * docs.count())
    return words.join(parts, "part", "left_semi").groupBy("part").count().where(F.col("count") >= least).select("part")


def features(found, known):
    """Adds the forest's inputs: length, transitions, dictionary coverage, path, neighbouring words."""
    c, n = F.col("candidate"), F.length("candidate")
    parts = found.select("candidate").distinct().select("candidate", F.explode(_parts(c)).alias("part"))
    covered = parts.join(known, "part").groupBy("candidate").agg(F.sum(F.length("part")).alias("covered"))

    def share(pattern):
        return F.regexp_count(c, F.lit(pattern)) / n

    near = F.regexp_extract("left", r"((?:\S+\s+){0,3}\S*)$", 1)

    def seen(column, pattern):
        return column.rlike(pattern).cast("double")

    return found.join(covered, "candidate", "left").select(
        *found.columns,
        n.cast("double").alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        share(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])").alias("letter_digit"),
        share(r"(?<=[A-Z])(?=[a-z])|(?<=[a-z])(?=[A-Z])").alias("upper_lower"),
        share(r"(?<=[0-9])(?=[0-9])|(?<=[a-z])(?=[a-z])|(?<=[A-Z])(?=[A-Z])").alias("same_kind"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        share("(?i)[b-df-hj-np-tv-xz](?=[b-df-hj-np-tv-xz]{2})").alias("consonants"),
        seen(c, "^(?:[0-9a-f]+|[0-9A-F]+)$").alias("hex"),
        (F.coalesce("covered", F.lit(0)) / n).alias("dictionary"),
        share("/").alias("slashes"),
        share(r"\.").alias("dots"),
        F.greatest(seen(c, r"(?i)(?:^|/)[\w.-]+\.(?:[a-z]{2,4}|html|json|yaml)$|^[/~.]|/.*/"), seen(F.col("left"), r"(?i)(?:https?://|www\.|[/\\])\S*$")).alias("path"),
        F.greatest(seen(c, r"^[0-9]{1,3}(?:\.[0-9]{1,3}){2,3}$"), seen(F.col("left"), r"@$|@\S+$")).alias("address"),
        seen(near, rf"(?i)(?:{KEYS})").alias("key_near"),
        seen(F.col("left"), r"[:=]\s{0,3}[\"']?$").alias("assigned"),
        seen(F.col("left"), r"[\"']$").alias("quoted"),
        seen(near, PUBLIC).alias("public_near"),
        seen(c, "|".join(f"^(?:{f})$" for f in FORMATS)).alias("form"),
    )


def labelled(found):
    """Findings with labels by rule: issued formats and assigned credentials with digits are true.

    Stands in where no labelled findings are given.
    """
    true = (F.col("form") == 1) | ((F.col("key_near") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0) & (F.col("dictionary") < 0.5))
    return found.withColumn("label", true.cast("double"))


def scan(docs, id_col="doc_id", text_col="text", findings=None, sample=SAMPLE, threshold=0.5):
    """One row per row of ``docs`` and distinct candidate: id, candidate, start, occurrences, score, is_secret.

    Candidates are runs of at least 12 key characters with a digit, values assigned to a
    credential's name, private keys from their first line to their last, and what has the format of an
    issued credential. A random forest judges each occurrence by its length, kinds of adjacent
    characters, coverage by the corpus's own words, likeness to paths and addresses, and the words
    beside it; the score is the highest of all occurrences. ``start`` is the place of the first, in
    code points from 1. It is trained on
    ``findings`` (columns candidate, left, right, label of 0 or 1), or on this table's candidates
    labelled by rule, at most ``sample`` of each label by hash order; every row is judged.

    Null and empty texts and tables give no rows. A null id is returned as null. Repeated rows repeat
    their findings. If the findings have one label only, the score is that label. Other columns are
    not read.
    """
    found = cut_lineage(candidates(docs, id_col, text_col))
    parts = found.select("candidate")
    if findings is not None:
        parts = parts.unionByName(findings.select("candidate"))
    parts = parts.select(F.explode(_parts(F.col("candidate"))).alias("part")).distinct()
    known = cut_lineage(dictionary(docs, parts, text_col))
    judged = cut_lineage(features(found, known))
    if findings is None:
        marked = labelled(judged)
    else:
        marked = features(findings.select("candidate", "left", "right", F.col("label").cast("double").alias("label")), known)
    marked = marked.select("label", "candidate", "left", *FEATURES).where("label is not null")
    kinds = {}
    for kind in (0.0, 1.0):
        kinds[kind] = cut_lineage(marked.where(F.col("label") == kind).orderBy(F.xxhash64("candidate", "left"), "candidate", "left").limit(sample))
    present = [k for k, rows in kinds.items() if not rows.isEmpty()]
    columns = ["finding", "id", "candidate", "start", "occurrences"]
    if len(present) < 2:
        out = judged.select(*columns, F.lit(present[0] if present else 0.0).alias("score"))
    else:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=30, maxDepth=6, seed=11)
        model = forest.fit(assembler.transform(kinds[0.0].unionByName(kinds[1.0])))
        scored = model.transform(assembler.transform(judged))
        out = scored.select(*columns, F.round(vector_to_array("probability")[1], 6).alias("score"))
    # columns other than the score are those of the finding
    out = out.groupBy("finding").agg(*(F.first(x).alias(x) for x in columns[1:]), F.max("score").alias("score")).drop("finding")
    return out.withColumn("is_secret", F.col("score") >= threshold).withColumnRenamed("id", id_col)


def redact(docs, id_col="doc_id", text_col="text", mask=MASK, **settings):
    """``docs`` with every occurrence of each found secret replaced; ``n_chars`` follows if there.

    All rows stay, with their columns; a text without findings is unchanged, null stays null.
    """
    found = scan(docs, id_col, text_col, **settings).where("is_secret")
    per = found.groupBy(F.col(id_col).alias("_id")).agg(
        F.transform(F.array_sort(F.collect_set(F.struct((-F.length("candidate")).alias("n"), "candidate"))), lambda s: s["candidate"]).alias("_secrets")
    )
    per = cut_lineage(per)
    if per.count() <= LISTED // 10:
        per = F.broadcast(per)
    joined = docs.join(per, docs[id_col].cast("long").eqNullSafe(per["_id"]), "left")
    clean = F.aggregate(F.coalesce("_secrets", F.array().cast("array<string>")), F.col(text_col), lambda t, s: F.replace(t, s, F.lit(mask)))
    joined = joined.withColumn(text_col, clean)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(F.col("_secrets").isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(kind))
    return joined.select(*docs.columns)
