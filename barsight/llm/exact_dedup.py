"""Exact duplicates by skew-safe combining."""

from decimal import Decimal

from pyspark.sql import functions as F

from barsight.session import cut_lineage

BLANK = "[\\x20\\x09-\\x0D]+"
LAST = 2**63 - 1


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def exact_groups(docs, id_col="doc_id", text_col="text", digest=None, salts=64):
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space. Of a group, the row with the
    most code points in its original text stays, then the smallest id.

    Three levels, each grouping by the digest and by the full normalised content:

    1. rows of one task are combined before anything is shuffled (the partial aggregate), to one
       row for each content;
    2. what is left is merged per digest and salt, where tasks take salts in turn, so that a group
       of a third of all rows is spread;
    3. the winners of the salts are merged per digest: at most ``salts`` rows for a group.

    The rank of a row is one decimal, its code points times 2^64 plus the complement of its id, so
    that all buffers are fixed width. Rows find their winner by digest; a digest that holds
    several contents is joined by the content as well.

    Null text is empty, and empty texts form a group. A null id ranks behind all others and is
    returned as null. Rows that repeat an id share its outcome (``kept`` belongs to the id). Other
    columns are not read; an empty table gives no rows.
    """
    digest = digest or (lambda text: F.sha2(text, 256))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("length"),
        normalised(F.col(text_col)).alias("content"),
    ).withColumn("digest", digest(F.col("content")))
    wide = F.lit(Decimal(2**64)).cast("decimal(38,0)")
    rank = F.col("length").cast("decimal(10,0)") * wide + (
        F.lit(LAST).cast("decimal(19,0)") - F.coalesce(F.col("id"), F.lit(LAST)).cast("decimal(19,0)")
    )
    salted = (
        rows.withColumn("rank", rank.cast("decimal(38,0)"))
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("size"))
    )
    winners = salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("size").alias("group_size"))
    low = F.lit(LAST).cast("decimal(38,0)") - F.pmod(F.col("rank"), wide)
    winners = cut_lineage(
        winners.select(
            "digest",
            F.sha2("content", 256).alias("text_sha256"),
            F.nullif(low.cast("long"), F.lit(LAST)).alias("keep_id"),
            "group_size",
        )
    )
    shared = winners.groupBy("digest").count().where("count > 1")
    ids = rows.select("id", "digest")
    if shared.isEmpty():
        found = ids.join(winners, "digest")
    else:
        # several contents under one digest: their rows compare the content's own SHA-256 too
        marked = winners.join(shared.select("digest", F.lit(True).alias("several")), "digest", "left")
        alone = marked.where("several is null").drop("several")
        clash = marked.where("several").drop("several")
        full = rows.select("id", "digest", F.sha2("content", 256).alias("text_sha256"))
        found = ids.join(alone, "digest").select("id", "text_sha256", "keep_id", "group_size").unionByName(
            full.join(clash, ["digest", "text_sha256"]).select("id", "text_sha256", "keep_id", "group_size")
        )
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs, id_col="doc_id", text_col="text"):
    """The rows of ``docs`` that stay, with all their columns.

    Nulls, empty texts and repeated ids as in ``exact_groups``. Rows that repeat a kept id stay.
    """
    keep = exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(keep, docs[id_col].cast("long").eqNullSafe(keep["_kept_id"]), "left_semi")
