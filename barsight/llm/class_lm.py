"""Class-based bigram scores; words are put into classes by exchange clustering."""

import os
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barsight.llm.words import Words, mix, slices, small_batches
from barsight.session import cut_lineage, new_path

FOLDS = 10
ADD = 0.1  # added to every word count
ADD_CLASS = 0.5  # added to every class transition
HEAD = 1 << 15  # most frequent words, which the driver puts into classes
CLASSES = 48
PASSES = 4  # of the driver over these words
FIRST = 2048  # words of the head that move one by one
TOGETHER = 64  # other words of the head that move at once
RISE = 1e-3  # likelihood per token (nats) below which a round does not count as a rise
LEAST_SHARE = 8  # rounds end if not even one in so many words can move with a rise
HELD = 1 << 21
STOP = np.uint64(0x5851F42D4C957F2D)  # hash of the end token, which is no word


def tokens_of(column):
    """(token hashes with an end after each text, offsets per text) for slices of a column."""
    for _, data, offsets in slices(column):
        words = Words(data, offsets, lower=True)
        n = len(offsets) - 1
        out = np.empty(len(words) + n, np.uint64)
        ends = words.bounds[1:] + np.arange(n)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = words.hashes()
        out[ends] = STOP
        yield out, np.concatenate([[0], ends + 1])


class Lookup:
    """Hash -> place in a list; each level is a table of the hashes that clashed before."""

    def __init__(self, hashes, bits=20):
        self.hashes, self.bits, self.levels = hashes, bits, []
        left = np.arange(len(hashes))
        while len(left):
            table = np.full(1 << bits, -1, np.int32)
            slot = self.slot(hashes[left], len(self.levels))
            table[slot] = left
            self.levels.append(table)
            left = left[table[slot] != left]

    def slot(self, h, level):
        return (h * np.uint64(2 * level + 1) + (h >> np.uint64(13 + level))) >> np.uint64(64 - self.bits)

    def __call__(self, h):
        """Places, and len(hashes) for what is not listed."""
        out = np.full(len(h), len(self.hashes), np.int32)
        for level, table in enumerate(self.levels):
            at = table[self.slot(h, level)]
            good = (at >= 0) & (self.hashes[at] == h)
            out[good] = at[good]
        return out


def _counted(batches):
    held, size = [], 0

    def flush():
        h = np.concatenate([x for x, _ in held])
        n = np.concatenate([x for _, x in held])
        order = np.argsort(h)
        h, n = h[order], n[order]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return pa.record_batch({"h": pa.array(h[heads].view(np.int64)), "n": pa.array(np.add.reduceat(n, heads))})

    for batch in batches:
        for h, _ in tokens_of(batch.column(0)):
            held.append(np.unique(h, return_counts=True))
            size += len(held[-1][0])
            if size >= HELD:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _contexts(batches, head, classes, count):
    """(key, n): how often each class stands before and after each head word; key is (word, side, class)."""
    find = Lookup(head.value)
    of = np.append(classes.value, count)  # words outside the head have a class of their own
    width = count + 1
    total = np.zeros((len(head.value) + 1) * 2 * width, np.int64)
    for batch in batches:
        for h, offsets in tokens_of(batch.column(0)):
            at = find(h)
            before = np.empty(len(at), np.int64)
            before[1:] = of[at[:-1]]
            before[offsets[:-1]] = of[find(np.array([STOP], np.uint64))][0]
            np.add.at(total, at * np.int64(2 * width) + before, 1)
            inner = np.ones(len(at), bool)
            inner[offsets[1:] - 1] = False  # nothing follows an end
            places = np.flatnonzero(inner)
            np.add.at(total, at[places] * np.int64(2 * width) + width + of[at[places + 1]], 1)
    keys = np.flatnonzero(total)
    for first in range(0, len(keys), 1 << 16):
        part = keys[first : first + (1 << 16)]
        yield pa.record_batch({"key": pa.array(part), "n": pa.array(total[part])})


def contexts(texts, head, classes, count):
    """(before, after): counts of words x classes, over all texts. Their size is fixed by settings."""
    of = texts.sparkSession.sparkContext.broadcast(classes)
    parts = texts.mapInArrow(partial(_contexts, head=head, classes=of, count=count), "key long, n long")
    summed = parts.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(classes) + 1) * 2 * (count + 1), np.int64)
    out[summed["key"].to_numpy()] = summed["n"].to_numpy()
    out = out.reshape(len(classes) + 1, 2, count + 1)
    return out[:, 0], out[:, 1]


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def _growth(x, t):
    """By how much t * log(t) grows when x is added to t."""
    t = np.maximum(t, 0)
    return _xlogx(t + x) - _xlogx(t)


def exchange(before, after, classes, count, fixed):
    """One pass: each word, frequent ones first, goes to the class that most raises the likelihood.

    The ``FIRST`` words move one by one, the others ``TOGETHER`` at a time; the class bigram table
    follows every move. The words' own contexts are those of the pass. Words in ``fixed`` stay.
    Returns (new classes, number of moves).
    """
    of = np.append(classes, count)
    table = np.zeros((count + 1, count + 1))
    np.add.at(table.T, of, before)
    size = np.zeros(count + 1)
    np.add.at(size, of, before.sum(axis=1))
    moves = 0
    words = np.array([w for w in range(len(classes)) if w not in fixed], np.int64)
    for group in [*words[:FIRST].reshape(-1, 1), *(words[i : i + TOGETHER] for i in range(FIRST, len(words), TOGETHER))]:
        a, left, right = of[group], before[group].astype(float), after[group].astype(float)
        n, each = left.sum(axis=1), np.arange(len(group))
        # the table without the word, for each word of the group
        rest = np.repeat(table[None], len(group), axis=0)
        rest[each, :, a] -= left
        rest[each, a] -= right
        sizes = np.repeat(size[None, :count], len(group), axis=0)
        sizes[each, a] -= n
        gain = _growth(left[:, :, None], rest[:, :, :count]).sum(axis=1)
        gain += _growth(right[:, None, :], rest[:, :count]).sum(axis=2)
        gain -= 2 * _growth(n[:, None], sizes)
        b = np.where(gain.max(axis=1) > gain[each, a] + 1e-9, gain.argmax(axis=1), a)
        for target, sign in ((a, -1), (b, 1)):
            np.add.at(table.T, target, sign * left)
            np.add.at(table, target, sign * right)
            np.add.at(size, target, sign * n)
        np.maximum(table, 0, out=table)
        moves += int((b != a).sum())
        of[group] = b
    return of[:-1], moves


def _around(batches, head, classes, count):
    """Neighbours of the words outside the head, with counts.

    Rows (h, null, code, m): class ``code`` (side and class) of a head word stands beside h.
    Rows (h, k, side, m): word k, also outside the head, stands beside h.
    Rows (null, null, code, m): pairs of head words by their classes.
    """
    find = Lookup(head.value)
    of = np.append(classes.value, count)
    stop = of[find(np.array([STOP], np.uint64))][0]
    width = count + 1
    pairs = np.zeros(width * width, np.int64)
    held, size = [], 0

    def flush():
        h, k, code = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((code, k, h))
        h, k, code = h[order], k[order], code[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (code[1:] != code[:-1])])
        heads = np.flatnonzero(new)
        m = np.diff(np.append(heads, len(h)))
        linked = code[heads] >= 2 * width
        return pa.record_batch(
            {
                "h": pa.array(h[heads].view(np.int64)),
                "k": pa.array(k[heads].view(np.int64), mask=~linked),
                "code": pa.array(np.where(linked, code[heads] - 2 * width, code[heads]).astype(np.int32)),
                "m": pa.array(m),
            }
        )

    for batch in batches:
        for h, offsets in tokens_of(batch.column(0)):
            at = find(h)
            rare = at == len(head.value)
            own = of[at]
            before = np.empty(len(at), np.int64)
            before[1:] = own[:-1]
            before[offsets[:-1]] = stop
            known = np.ones(len(at), bool)  # the token before is a head word
            known[1:] = ~rare[:-1]
            known[offsets[:-1]] = True
            both = known & ~rare
            np.add.at(pairs, before[both] * width + own[both], 1)
            here = np.flatnonzero(rare)  # never an end, so a token follows
            left, right = known[here], ~rare[here + 1]
            nothing = np.zeros(len(here), np.uint64)
            for places, k, code in (
                (here[left], nothing[left], before[here[left]]),
                (here[right], nothing[right], width + own[here[right] + 1]),
                (here[~left], h[here[~left] - 1], np.full((~left).sum(), 2 * width)),
                (here[~right], h[here[~right] + 1], np.full((~right).sum(), 2 * width + 1)),
            ):
                held.append((h[places], k, code))
                size += len(places)
            if size >= HELD:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()
    codes = np.flatnonzero(pairs)
    yield pa.record_batch(
        {
            "h": pa.nulls(len(codes), pa.int64()),
            "k": pa.nulls(len(codes), pa.int64()),
            "code": pa.array(codes.astype(np.int32)),
            "m": pa.array(pairs[codes]),
        }
    )


class Stored:
    """A table in the shared folder, in as many buckets by ``key`` as shuffles have partitions.

    Tables with the same buckets are joined without a shuffle. ``free`` deletes the files.
    """

    def __init__(self, df, key):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, "buckets")
        self.name = "buckets_" + os.urandom(8).hex()
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, key).sortBy(key).option("path", self.path).saveAsTable(self.name)

    def read(self):
        return self.spark.table(self.name)

    def free(self):
        self.spark.sql(f"DROP TABLE {self.name}")
        delete(self.spark, self.path)


def delete(spark, path):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def likelihood(table):
    """Log likelihood of the class bigrams, without the words' own counts, which no move changes."""
    return _xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum()


def _lists(batch, width):
    """(row, code, m) of the packed neighbours of a batch; equal codes of a row are summed."""
    around = batch.column("around")
    row = np.repeat(np.arange(batch.num_rows), around.value_lengths().to_numpy())
    packed = around.flatten().to_numpy()
    return np.bincount(row * 2 * width + packed % (2 * width), packed // (2 * width), batch.num_rows * 2 * width).reshape(-1, 2 * width)


def _moved(batches, table, count, share, turn):
    """Each word that may move in this round goes to the class that most raises the likelihood."""
    t = table.value
    width = count + 1
    near = np.concatenate([t[:, :count], t.T[:, :count]])  # by code, class
    one = _growth(1, near)
    size = t.sum(axis=0)[:count]
    for batch in batches:
        h, c, n = (batch.column(x).to_numpy() for x in ("h", "c", "n"))
        m = _lists(batch, width)
        gain = m @ one
        row, code = np.nonzero(m)
        x = m[row, code]
        inside = c[row] < count  # a classed word is taken out of its class first
        r, d, y = row[inside], code[inside], x[inside]
        np.add.at(gain, (r, c[r]), _growth(y, near[d, c[r]] - y) - y * one[d, c[r]])
        for first in range(0, len(row), 1 << 15):
            part = np.flatnonzero(x[first : first + (1 << 15)] > 1) + first
            add = _growth(x[part][:, None], near[code[part]]) - x[part][:, None] * one[code[part]]
            own = np.flatnonzero(c[row[part]] < count)
            add[own, c[row[part][own]]] = 0
            np.add.at(gain, row[part], add)
        rest = np.repeat(size[None], len(h), axis=0)
        classed = np.flatnonzero(c < count)
        rest[classed, c[classed]] -= n[classed]
        gain -= 2 * _growth(n[:, None], rest)
        best = gain.argmax(axis=1)
        now = gain[np.arange(len(h)), np.minimum(c, count - 1)]
        free = mix(h.view(np.uint64)) % np.uint64(share) == np.uint64(turn % share)
        move = (c == count) | free & (gain.max(axis=1) > now + 1e-9)
        yield pa.record_batch({"h": batch.column("h"), "c": pa.array(np.where(move, best, c).astype(np.int32)), "n": batch.column("n")})


def clustered(near, links, of, heads, count):
    """(words with classes, class bigram table): exchange over the words outside the head until the likelihood stops rising.

    ``near`` (h, n, own) has the head classes around each word and ``links`` (h, k, code, m) its
    neighbours outside the head. ``of`` (h, c, n) are the first classes, ``heads`` the bigrams of the
    head. A round moves a part of the words, by hash and in turn, as words that move together
    do not see each other's moves; if the likelihood falls, the round is taken back and smaller
    parts move. A round shuffles only the classes of linked neighbours; all else is in buckets by word.
    Only the class bigram table is broadcast. Older rounds are deleted.
    """
    spark = near.spark
    width = count + 1

    def state(of):
        """Each word's linked neighbours' classes, the bigram table and its likelihood."""
        known = of.read()
        found = links.read().join(known.select(F.col("h").alias("k"), "c"), "k")
        found = found.select("h", (F.col("code") * width + F.col("c")).alias("code"), "m").groupBy("h", "code").agg(F.sum("m").alias("m"))
        more = Stored(found.groupBy("h").agg(F.collect_list(F.col("m") * (2 * width) + F.col("code")).alias("more")), "h")
        table = heads.copy()
        packed = {"own": near.read().select("h", F.explode("own").alias("x")), "more": more.read().select("h", F.explode("more").alias("x"))}
        for kind, rows in packed.items():
            rows = rows.join(known.select("h", "c"), "h").groupBy("c", (F.col("x") % (2 * width)).alias("code")).agg(F.sum(F.expr(f"x div {2 * width}")).alias("m"))
            for r in rows.collect():
                side, d = divmod(r["code"], width)
                if side == 0:
                    table[d, r["c"]] += r["m"]
                elif kind == "own":  # a pair outside the head is counted by its later word
                    table[r["c"], d] += r["m"]
        return more, table, likelihood(table)

    more, table, best = state(of)
    least = RISE * max(table.sum(), 1)
    share, turn, idle = 2, 0, 0
    while share <= LEAST_SHARE and idle < share:
        rows = of.read().join(near.read().select("h", "own"), "h").join(more.read(), "h", "left")
        none = F.array().cast("array<bigint>")
        rows = rows.select("h", "c", "n", F.concat(F.coalesce("own", none), F.coalesce("more", none)).alias("around"))
        moves = partial(_moved, table=spark.sparkContext.broadcast(table), count=count, share=share, turn=turn)
        new = Stored(rows.mapInArrow(moves, "h long, c int, n long"), "h")
        after = state(new)
        turn += 1
        if after[2] > best:
            idle = idle + 1 if after[2] - best <= least else 0
            of.free(), more.free()
            of, (more, table, best) = new, after
        else:
            new.free(), after[0].free()
            share, idle = share * 4, 0
    more.free()
    return of, table


def _spread(batches, head, model):
    """One row per text: what its head words give, and its other words with their places and head neighbours' classes."""
    m = model.value
    find = Lookup(head.value)
    emitted = np.log10(m["n"] + ADD) - np.log10(m["size"][m["of"]] + ADD * m["kinds"][m["of"]])
    kind = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("right", pa.int32())])
    for batch in batches:
        first = 0
        for h, offsets in tokens_of(batch.column("text")):
            k = len(offsets) - 1
            at = find(h)
            own = m["of"][at]
            rare = at == len(head.value)
            left = np.empty(len(at), np.int32)
            left[1:] = np.where(rare[:-1], -1, own[:-1])
            left[offsets[:-1]] = m["stop"]
            known = ~rare
            score = np.where(known, emitted[at] + np.where(left >= 0, m["step"][left, own], 0), 0)
            base = np.where(known, np.log10(m["n"][at] + ADD) - m["floor"], 0)
            here = np.flatnonzero(rare)
            right = np.where(rare[here + 1], -1, own[here + 1]).astype(np.int32)
            pos = here - np.repeat(offsets[:-1], np.diff(np.searchsorted(here, offsets)))
            words = pa.StructArray.from_arrays(
                [pa.array(h[here].view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(left[here]), pa.array(right)], fields=list(kind)
            )
            yield pa.record_batch(
                {
                    "row": batch.column("row").slice(first, k),
                    "id": batch.column("id").slice(first, k),
                    "held_out": batch.column("held_out").slice(first, k),
                    "n_tokens": pa.array(np.diff(offsets)),
                    "n_known": pa.array(np.add.reduceat((m["n"][at] > 0).astype(np.int64), offsets[:-1])),
                    "base_score": pa.array(np.add.reduceat(base, offsets[:-1])),
                    "score": pa.array(np.add.reduceat(score, offsets[:-1])),
                    "rare": pa.ListArray.from_arrays(pa.array(np.searchsorted(here, offsets), pa.int32()), words),
                }
            )
            first += k


def _finished(batches, model):
    """Adds what the words outside the head give."""
    m = model.value
    for batch in batches:
        k = batch.num_rows
        rare = batch.column("rare")
        row = np.repeat(np.arange(k), rare.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        pos, left, right, c, n = (rare.flatten().field(i).to_numpy() for i in range(5))
        order = np.lexsort((pos, row))
        row, left, right, c, n = row[order], left[order], right[order], c[order], n[order]
        before = np.where(left >= 0, left, np.concatenate([[0], c[:-1]]))  # its rare neighbour is the row before
        log = np.log10(n + ADD)
        score = log - np.log10(m["size"][c] + ADD * m["kinds"][c]) + m["step"][before, c] + np.where(right >= 0, m["step"][c, right], 0)
        yield pa.record_batch(
            {
                "id": batch.column("id"),
                "held_out": batch.column("held_out"),
                "n_tokens": batch.column("n_tokens"),
                "n_known": pa.array(batch.column("n_known").to_numpy() + np.bincount(row, n > 0, k).astype(np.int64)),
                "train_tokens": pa.array(np.full(k, m["total"], np.int64)),
                "base_score": pa.array(batch.column("base_score").to_numpy() + np.bincount(row, log - m["floor"], k)),
                "score": pa.array(batch.column("score").to_numpy() + np.bincount(row, score, k)),
            }
        )


def text_scores(docs, id_col="doc_id", text_col="text", head_words=HEAD, classes=CLASSES, passes=PASSES):
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts come from all rows whose crc32(id) mod 10 is not 0. Every training word is put into one
    of ``classes`` classes by exchange: the ``head_words`` most frequent ones on the driver in
    ``passes`` passes over all texts, all others in distributed rounds by the classes of their
    neighbours, until the likelihood stops rising. Words never seen are one class more.

    score is the sum over tokens of log10 of
    (n(c1 c2) + 0.5) / (n(c1) + 0.5 * (classes + 1)) * (c + 0.1) / (n(c2) + 0.1 * words of c2),
    where c is the word's own count. base_score is the same with one class and no transition.
    Words outside the head meet their counts and classes by a 64-bit hash.

    Null and empty texts are one end token. A null id is learned from and returned as null. Repeated
    rows count each. With no training row all counts are 0. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # a written step needs its shuffles no more
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    try:
        return _text_scores(docs, id_col, text_col, head_words, classes, passes)
    finally:
        spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")


def _text_scores(docs, id_col, text_col, head_words, classes, passes):
    spark = docs.sparkSession
    width = classes + 1
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held_out"))
    train = rows.where(~held).select("text")
    counts = cut_lineage(train.mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    end = int(STOP.view(np.int64))
    top = counts.where(F.col("h") != end).orderBy(F.desc("n"), "h").limit(head_words).toArrow()
    ends = counts.where(F.col("h") == end).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = np.append(top["h"].to_numpy().view(np.uint64), STOP)
    n = np.append(top["n"].to_numpy(), ends).astype(np.float64)
    stop = len(words) - 1
    head = spark.sparkContext.broadcast(words)
    # the end token has the last class; others start in turn by frequency
    of = np.arange(len(words)) % max(classes - 1, 1)
    of[stop] = classes - 1
    for _ in range(passes):
        before, after = contexts(train, head, of, classes)
        of, moves = exchange(before, after, of, classes, {stop})
        if not moves:
            break
    placed = spark.sparkContext.broadcast(of)
    around = cut_lineage(train.mapInArrow(partial(_around, head=head, classes=placed, count=classes), "h long, k long, code int, m long"))
    heads = np.zeros(width * width)
    for r in around.where("h is null").groupBy("code").agg(F.sum("m").alias("m")).collect():
        heads[r["code"]] = r["m"]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.createDataFrame(pa.table({"h": words.view(np.int64)}))
    others = counts.join(F.broadcast(listed), "h", "left_anti")
    own = around.where("h is not null and k is null").repartition(buckets, "h").groupBy("h", "code").agg(F.sum("m").alias("m"))
    own = own.groupBy("h").agg(F.collect_list(F.col("m") * (2 * width) + F.col("code")).alias("own"))
    near = Stored(others.repartition(buckets, "h").join(own, "h", "left"), "h")
    links = around.where("k is not null").groupBy("k", "h", "code").agg(F.sum("m").alias("m"))
    links = Stored(links.repartition(buckets, "k"), "k")
    # first classes by the head words around
    none = F.array().cast("array<bigint>")
    first = near.read().select("h", F.lit(classes).alias("c"), "n", F.coalesce("own", none).alias("around"))
    table = spark.sparkContext.broadcast(heads.reshape(width, width))
    first = Stored(first.mapInArrow(partial(_moved, table=table, count=classes, share=1, turn=0), "h long, c int, n long"), "h")
    found, table = clustered(near, links, first, heads.reshape(width, width), classes)
    near.free(), links.free()
    kinds = np.bincount(of, minlength=width).astype(float)
    kinds[classes] += 1
    for r in found.read().groupBy("c").count().collect():
        kinds[r["c"]] += r["count"]
    model = spark.sparkContext.broadcast(
        {
            "of": np.append(of, classes),
            "n": np.append(n, 0.0),
            "stop": classes - 1,
            "step": np.log10((table + ADD_CLASS) / (table.sum(axis=1, keepdims=True) + ADD_CLASS * width)),
            "size": table.sum(axis=0),
            "kinds": kinds,
            "total": total,
            "floor": np.log10(total + ADD * (vocabulary + 1)),
        }
    )
    sums = "row long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    texts = cut_lineage(
        rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            partial(_spread, head=head, model=model), f"{sums}, rare array<struct<h: long, pos: int, left: int, right: int>>"
        )
    )
    known = spark.read.schema("h long, c int, n long").parquet(found.path)
    rare = texts.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(known, "h", "left")
    rare = rare.select("row", F.struct("pos", "left", "right", F.coalesce("c", F.lit(classes)).alias("c"), F.coalesce("n", F.lit(0)).alias("n")).alias("x"))
    rare = rare.groupBy("row").agg(F.collect_list("x").alias("rare"))
    scored = texts.drop("rare").join(rare, "row", "left").mapInArrow(
        partial(_finished, model=model),
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumnRenamed("id", id_col)
