"""Near duplicates: MinHash signatures, banding, verification, connected components."""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barsight.llm.components import components
from barsight.llm.words import STEP, Words, grams, mix, runs, slices, small_batches
from barsight.session import cut_lineage

SEED = 7
GROWTH = 8
ORDERS = 1
CENTRAL = 1 << 30  # classes met that are told apart
STEPS = 1
LISTED = 1_000_000  # ids of eight bytes that are broadcast at most


def shingles(column, k):
    """(first row, sorted distinct shingle hashes, offsets per text) for slices of a column.

    A text with fewer than k words, but some, has its whole sequence as one shingle.
    """
    for first, data, offsets in slices(column):
        words = Words(data, offsets, lower=True)
        hashes = words.hashes()
        values, _, text = grams(hashes, words.bounds, k)
        counts = words.counts()
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            whole = []
            for i in short:
                own = hashes[words.bounds[i] : words.bounds[i + 1]]
                whole.append(grams(own, np.array([0, len(own)]), len(own))[0][0] + STEP)
            values = np.concatenate([values, np.array(whole, np.uint64)])
            text = np.concatenate([text, short])
        order = np.lexsort((values, text))
        values, text = values[order], text[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        values, text = values[fresh], text[fresh]
        yield first, values, runs(text, len(counts))


def family(n):
    """n functions (a x + b) mod 2^64 >> 32 of 32-bit x: a strongly universal family."""
    draw = np.random.default_rng(SEED).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def minima(values, offsets, n, block=1 << 15):
    """Signatures of the texts that have shingles, one row of n 32-bit minima each."""
    a, b = family(n)
    filled = np.flatnonzero(np.diff(offsets))
    heads = offsets[filled]
    x = (mix(values) >> np.uint64(32)).astype(np.uint64)
    out = np.empty((len(filled), n), np.uint32)
    at = 0
    while at < len(filled):
        to = max(at + 1, int(np.searchsorted(heads, heads[at] + block, "left")))
        stop = heads[to] if to < len(heads) else len(x)
        part, local = x[heads[at] : stop], heads[at:to] - heads[at]
        for i in range(n):
            out[at:to, i] = np.minimum.reduceat((part * a[i] + b[i]) >> np.uint64(32), local)
        at = to
    return filled, out


def _signed(batches, k, bands, rows):
    for batch in batches:
        ids = batch.column(0)
        for first, values, offsets in shingles(batch.column(1), k):
            count = len(offsets) - 1
            size = np.diff(offsets)
            filled, sign = minima(values, offsets, bands * rows)
            key = np.zeros((2, count), np.uint64)
            if len(filled):
                key[0, filled] = np.add.reduceat(mix(values), offsets[filled])
                key[1, filled] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offsets[filled])
            band = np.zeros((len(filled), bands), np.uint64)
            for j in range(rows):
                band = mix(band * np.uint64(31) + sign[:, j::rows].astype(np.uint64) + np.arange(1, bands + 1, dtype=np.uint64))
            places = np.zeros(count + 1, np.int32)
            places[1:] = np.cumsum(size > 0)
            short = np.ascontiguousarray(sign.astype(np.uint16)).tobytes()
            width = 2 * bands * rows
            yield pa.record_batch(
                {
                    "id": ids.slice(first, count),
                    "size": pa.array(size.astype(np.int64)),
                    "key1": pa.array(key[0].view(np.int64)),
                    "key2": pa.array(key[1].view(np.int64)),
                    "bands": pa.ListArray.from_arrays(pa.array(places * bands, pa.int32()), pa.array(band.ravel().view(np.int64))),
                    "sign": pa.array([short[p * width : (p + (s > 0)) * width] for p, s in zip(places[:-1], size)], pa.binary()),
                }
            )


def _sets(batches, k):
    for batch in batches:
        for first, values, offsets in shingles(batch.column(1), k):
            yield pa.record_batch(
                {
                    "cid": batch.column(0).slice(first, len(offsets) - 1),
                    "grams": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64))),
                }
            )


def _alike(batches, least):
    for batch in batches:
        size = len(batch)
        a = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(size, -1)
        b = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(size, -1)
        good = pa.array((a == b).mean(axis=1) >= least)
        yield pa.record_batch({"p": batch.column(0).filter(good), "m": batch.column(1).filter(good)})


def near_groups(docs, id_col="doc_id", text_col="text", k=5, percent=80, bands=40, rows=6):
    """One row per input row: id, n_shingles, component_id, kept.

    A text's set holds its distinct k-word shingles (words ``[^\\x20\\x09-\\x0D]+`` with A-Z in
    lower case); with fewer words, the whole sequence. Texts are linked when 100 * intersection
    >= percent * union; ``component_id`` is the smallest id a row reaches over links.

    Rows with equal sets become one class, so copies are never expanded. Classes get
    ``bands * rows`` universal-hash minima; a link at 0.8 shares no band with a probability of
    (1 - 0.8^rows)^bands, 5e-6 by default. Each pair of classes that share a bucket is either found
    inside one component already or tested: by signature (five standard deviations below the
    threshold), then on both full sets.

    A bucket is never expanded into its pairs at once. First every class meets one class of each
    other component: the smallest id among the pivots of its buckets. The first pivot of a bucket
    is the member that meets most classes in its own buckets, so that the middle of a large group
    gathers it; those of ORDERS more rounds come first in a random order. Then, in round t, members whose hash is among the
    lowest ``8^t / size`` share of their bucket meet the members behind them, but only across
    components, for STEPS rounds: enough for every small bucket, and a bounded number of pairs per
    member of a large one. Members of large buckets that are still apart then find each other by
    their rarest shingles (``_by_prefix``), which misses no link among them.

    Empty and null texts have size 0 and are linked with nothing; a null id gives a null
    component and is kept. Rows that repeat an id share its outcome. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut_lineage(
        text.mapInArrow(
            partial(_signed, k=k, bands=bands, rows=rows),
            "id long, size long, key1 long, key2 long, bands array<long>, sign binary",
        )
    )
    full = signed.where("size > 0 and id is not null")
    classes = cut_lineage(full.groupBy("key1", "key2", "size").agg(F.min("id").alias("cid")))
    firsts = full.join(classes.select(F.col("cid").alias("id")), "id", "left_semi").select(F.col("id").alias("cid"), "bands", "sign")
    firsts = cut_lineage(firsts.dropDuplicates(["cid"]))

    def hashed(seed):
        return F.shiftrightunsigned(F.xxhash64(F.col("cid"), F.lit(seed)), 1)

    spread = firsts.select("cid", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = cut_lineage(spread.join(shared, "bucket"))
    # how many meet a class in its buckets: a class in the middle of its group meets most
    met = spread.groupBy("cid").agg(F.least(F.sum("n"), F.lit(CENTRAL)).alias("met"))
    spread = spread.join(met, "cid").withColumn("first", (CENTRAL - F.col("met")) * (1 << 32) + F.shiftrightunsigned(hashed(0), 31)).drop("met")
    keys = {"lowest": F.col("first"), **{f"low{i}": hashed(i) for i in range(ORDERS)}}
    buckets = spread.groupBy("bucket").agg(*[F.min(k).alias(c) for c, k in keys.items()])
    members = cut_lineage(spread.join(buckets, "bucket"))
    signs = firsts.select("cid", "sign")
    sets = None
    labels = None

    def state():
        if labels is None:
            return members.withColumn("comp", F.col("cid"))
        return members.join(labels, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "cid")).drop("node", "root")

    def sets_of():
        """Full sets of the classes that share a bucket with another, written once."""
        nonlocal sets
        if sets is None:
            wanted = members.select("cid").distinct()
            sets = cut_lineage(_pick(text, wanted).mapInArrow(partial(_sets, k=k), "cid long, grams array<long>").dropDuplicates(["cid"]))
        return sets

    def merge(pairs):
        """Test pairs (p, m) by signature and on full sets; links that hold merge components."""
        nonlocal labels
        tested = (
            pairs.join(signs.select(F.col("cid").alias("p"), F.col("sign").alias("ps")), "p")
            .join(signs.select(F.col("cid").alias("m"), F.col("sign").alias("ms")), "m")
            .select("p", "m", "ps", "ms")
            .mapInArrow(partial(_alike, least=percent / 100 - 5 * (0.16 / (bands * rows)) ** 0.5), "p long, m long")
        )
        tested = cut_lineage(tested)
        if tested.isEmpty():
            return
        both = F.size(F.array_intersect("pg", "mg"))
        links = (
            tested.join(sets_of().select(F.col("cid").alias("p"), F.col("grams").alias("pg")), "p")
            .join(sets_of().select(F.col("cid").alias("m"), F.col("grams").alias("mg")), "m")
            .where(100 * both.cast("long") >= percent * (F.size("pg") + F.size("mg") - both).cast("long"))
            .select(F.col("p").alias("a"), F.col("m").alias("b"))
        )
        if labels is not None:
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
        labels = components(links)

    for low, key in keys.items():
        now = state()
        pivots = now.where(key == F.col(low)).select("bucket", F.col("cid").alias("p"), F.col("comp").alias("pc"))
        merge(now.join(pivots, "bucket").where("comp <> pc").groupBy(F.col("cid").alias("m"), "pc").agg(F.min("p").alias("p")).select("p", "m"))

    step = 0
    whole = F.lit(float(2**63))
    now = state().withColumn("u", hashed(0)).withColumn("done", F.lit(-1).cast("long"))
    while True:
        # buckets in one component are settled; rows up to ``done`` have met every other member
        now = cut_lineage(_open(now).where("u > done"))
        if now.isEmpty():
            break
        if step == STEPS:
            merge(_by_prefix(now.select("cid", "comp").distinct(), sets_of(), percent))
            break
        share = F.floor(whole * F.least(F.lit(1.0), F.lit(float(GROWTH**step)) / F.col("n"))).cast("long")
        reached = now.withColumn("reach", F.greatest("low0", share))
        pivots = reached.where("u <= reach").select("bucket", F.col("cid").alias("p"), F.col("u").alias("pu"), F.col("comp").alias("pc"))
        merge(reached.join(pivots, "bucket").where("comp <> pc and (u > pu or (u = pu and cid > p))").select("p", F.col("cid").alias("m")).distinct())
        step += 1
        now = reached.withColumn("done", F.col("reach")).drop("reach", "comp").select("bucket", "cid", "n", "low0", "u", "done")
        if labels is not None:
            now = now.join(labels, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "cid")).drop("node", "root")
        else:
            now = now.withColumn("comp", F.col("cid"))

    of_class = classes if labels is None else classes.join(labels, classes["cid"] == labels["node"], "left")
    of_class = of_class.select("key1", "key2", "size", (F.coalesce("root", "cid") if labels is not None else F.col("cid")).alias("component_id"))
    rest = signed.where("size = 0 or id is null").select("id", "size", F.col("id").alias("component_id"))
    out = full.select("id", "size", "key1", "key2").join(of_class, ["key1", "key2", "size"]).select("id", "size", "component_id")
    return out.unionByName(rest).select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _open(members):
    """Members of the buckets that hold several components."""
    found = members.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    return members.join(found.select("bucket"), "bucket", "left_semi")


def _by_prefix(members, sets, percent):
    """Pairs (p, m) of members of different components that may be linked, by their rarest shingles.

    Shingles are ordered by how many members have them. Linked sets share one among the first
    size - ceil(percent / 100 * size) + 1 of both; and if the first they share stands at places i
    and j, the intersection is 1 + min(size_i - i, size_j - j) at most. Copies of one text share
    their frequent shingles only at late places, which that bound rules out.
    """
    own = sets.join(members, "cid")
    grams = own.select("cid", F.explode("grams").alias("gram"))
    spread = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    order = grams.join(spread, "gram").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("order"))
    size = F.size("order")
    rows = own.select("cid", "comp").join(order, "cid")
    rows = rows.select("cid", "comp", size.alias("size"), F.posexplode(F.slice("order", F.lit(1), size - F.ceil(size * percent / 100).cast("int") + 1)))
    rows = rows.where("col.n > 1").select("cid", "comp", "size", (F.col("pos") + 1).alias("at"), F.col("col.gram").alias("gram"))
    left = cut_lineage(rows)
    right = left.select("gram", *[F.col(c).alias(f"{c}2") for c in ("cid", "comp", "size", "at")])
    most = 1 + F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2"))
    return (
        left.join(right, "gram")
        .where((F.col("cid") < F.col("cid2")) & (F.col("comp") != F.col("comp2")))
        .where((100 + percent) * most >= percent * (F.col("size") + F.col("size2")))
        .select(F.col("cid").alias("p"), F.col("cid2").alias("m"))
        .distinct()
    )


def _pick(text, ids):
    """Texts of the listed ids; the list is broadcast only while it is counted to be small."""
    ids = ids.withColumnRenamed("cid", "id")
    if ids.count() <= LISTED:
        ids = F.broadcast(ids)
    return text.join(ids, "id", "left_semi")


def drop_near_copies(docs, id_col="doc_id", text_col="text", **settings):
    """One row of each group of near copies (its smallest id), with all columns of ``docs``."""
    keep = near_groups(docs, id_col, text_col, **settings).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(keep, docs[id_col].cast("long").eqNullSafe(keep["_kept_id"]), "left_semi")
