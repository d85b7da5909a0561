"""Boosted trees for many fits at once: folds and heads share every pass over the rows.

A level of all trees of a round is one pass: each task bins its rows' gradients by (fit, node,
feature, bin) and only these sums are shuffled. Rows keep their binned features and, per fit, the
score so far; scores are written again every few rounds, and the trees since then are applied on
the way. Up to HELD rows, the fits are dealt over the tasks instead: each task holds the rows and
makes all rounds of its fits. Above ROWS rows, slopes are rounded to a grid, so that their sums are
exact, and of two children only the one with fewer rows is added up.
"""

import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from barsight.session import cut_lineage

BINS = 32
WRITTEN = 10  # rounds between two written score tables
SALTS = 4  # tasks that may add the sums of one key
STEPS = 256  # that a leaf's residuals are counted in
EXACT = 4096  # residuals of a step that are listed
DIRECT = 8  # tasks whose sums go to the driver as they are
ROWS = 200_000  # rows of a partition, about; each takes some 200 bytes
GRID = 2.0**-32  # share of a loss's usual slope that slopes are rounded to, so that their sums have no rounding
HELD = 500_000  # rows that a task may hold for fits of its own, some 250 MB with its copies


@dataclass(frozen=True)
class Fit:
    """One model: ``loss`` is 'log' (label 0 or 1), 'square', 'huber' or 'pinball' (at ``q``).

    ``fold`` leaves out the rows whose fold number in column ``split`` of the fold list is it; they
    stop the rounds early if ``patience`` is given, unless ``hold`` names other rows for that: the
    share of sessions, chosen by hash, that is kept for it. ``weight`` names a column of row weights.
    """

    loss: str = "square"
    label: str = "R"
    split: int = 0
    fold: int | None = None
    rounds: int = 100
    q: float = 0.5
    hold: float = 0.0
    patience: int = 0
    seed: int = 0
    weight: str | None = None


@dataclass
class Model:
    """Trees of one fit. A tree is (feature, cut bin, left child, value) by node; no left child is a leaf."""

    fit: Fit
    base: float
    scale: float
    trees: list = field(default_factory=list)
    gains: np.ndarray | None = None
    best: int = 0
    loss: float = np.inf


def added(trees, bins):
    """Sum of the trees' values for binned rows."""
    out = np.zeros(len(bins))
    for tree in trees:
        out += tree[3][leaves(tree, bins)]
    return out


def leaves(tree, bins):
    """Leaf node of each row."""
    feature, cut, left, _ = tree
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while True:
        inner = left[node] > 0
        if not inner.any():
            return node
        node = np.where(inner, left[node] + (bins[rows, feature[node]] > cut[node]), node)


def link(loss, x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30))) if loss == "log" else x


def slopes(fit, y, score, scale):
    """First and second derivatives of the loss at the scores (of rows with weight 1)."""
    if fit.loss == "log":
        p = link("log", score)
        return p - y, np.maximum(p * (1 - p), 1e-6)
    if fit.loss == "huber":
        return np.clip(score - y, -scale, scale), np.ones(len(y))
    if fit.loss == "pinball":
        return np.where(y > score, -fit.q, 1 - fit.q), np.ones(len(y))
    return score - y, np.ones(len(y))


def rounded(fit, values, scale):
    """Values on a grid of a power of two: their sums are the same in any order, and equal gains stay equal."""
    grid = GRID * (2.0 ** np.floor(np.log2(scale)) if fit.loss in ("huber", "square") else 1.0)
    return np.rint(values / grid) * grid


def losses(fit, y, score, scale):
    if fit.loss == "log":
        x = np.clip(score, -30, 30)
        return np.log1p(np.exp(x)) - y * x
    gap = y - score
    if fit.loss == "huber":
        return np.where(np.abs(gap) <= scale, gap**2 / 2, scale * (np.abs(gap) - scale / 2))
    if fit.loss == "pinball":
        return np.maximum(fit.q * gap, (fit.q - 1) * gap)
    return gap**2 / 2


def bin_edges(df, columns, bins=BINS):
    """Inner edges per feature: distinct approximate quantiles, one small row."""
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(row[i] or [], float)) for i in range(len(columns))]


def binned(pdf, columns, edges):
    """uint8 bins of a batch; missing values count as 0."""
    out = np.empty((len(pdf), len(columns)), np.uint8)
    for i, c in enumerate(columns):
        out[:, i] = np.searchsorted(edges[i], pdf[c].fillna(0.0).to_numpy(np.float64), "left")
    return out


def _held(sessions, share, seed):
    """Rows of the sessions that stop the rounds: a hash share of them."""
    x = sessions.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE5AB + 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(float) / (1 << 24) < share


def roles(fit, y, session, folds):
    """(rows that the trees are grown on, rows that only measure the loss)."""
    known = np.isfinite(y)
    out = known & (folds[:, fit.split] == fit.fold) if fit.fold is not None else np.zeros(len(y), bool)
    if fit.hold:
        held = _held(session, fit.hold, fit.seed) & known & ~out
    else:
        held = out if fit.patience else np.zeros(len(y), bool)
    return known & ~out & ~held, held


def _roles(b, i, fit, y):
    if isinstance(b, Held):
        if i not in b.role:
            b.role[i] = roles(fit, y, b.session, b.folds)
        return b.role[i]
    return roles(fit, y, b.session, b.folds)


def _placed(b, i, tree, level):
    """Node of each row in a tree grown so far; a task that holds its rows goes on from the level before."""
    if not isinstance(b, Held):
        return leaves(tree, b.x)
    if not level:
        b.leaf[i] = np.zeros(b.n, np.int64)
        return b.leaf[i]
    feature, cut, left, _ = tree
    node = b.leaf[i]
    rows = np.flatnonzero(left[node] > 0)
    at = node[rows]
    node[rows] = left[at] + (b.x[rows, feature[at]] > cut[at])
    return node


def _binned_sums(place, x, values, nodes, bins):
    """(values, nodes, features, bins) sums of some row values; ``x`` is (features, rows)."""
    out = np.empty((len(values), nodes, len(x), bins))
    start = place * bins
    for f in range(len(x)):
        cell = start + x[f]
        for k, v in enumerate(values):
            out[k, :, f] = np.bincount(cell, v, nodes * bins).reshape(nodes, bins)
    return out


def _codes(x, group, bins):
    """(features / group, rows) joint bins of neighbouring features of ``x`` (features, rows)."""
    out = np.zeros((-(-len(x) // group), x.shape[1]), np.uint16)
    for f, column in enumerate(x):
        out[f // group] += column.astype(np.uint16) * np.uint16(bins ** (f % group))
    return out


def _joint_sums(place, codes, group, width, values, nodes, bins):
    """``_binned_sums`` from the joint bins of two or three features, whose sums over the others are theirs."""
    out = np.empty((len(values), nodes, width, bins))
    start = place * bins**group
    for j, code in enumerate(codes):
        cell = start + code
        for k, v in enumerate(values):
            both = np.bincount(cell, v, nodes * bins**group).reshape(nodes, -1, bins, bins).astype(float)
            if group == 3 and 3 * j + 2 < width:
                out[k, :, 3 * j + 2] = both.sum((2, 3))
            both = both.sum(1)
            out[k, :, group * j] = both.sum(1)
            if group * j + 1 < width:
                out[k, :, group * j + 1] = both.sum(2)
    return out


def _smaller(nodes, halves):
    """Nodes whose rows are added up for ``nodes``: of siblings the one with fewer rows."""
    return sorted({node if node not in halves or halves[node][1] else halves[node][0] for node in nodes})


def _both(cube, summed, nodes, halves, parents):
    """Sums of ``nodes`` from those of ``summed`` and of the nodes of the level before."""
    at = {node: i for i, node in enumerate(summed)}
    if nodes == summed:
        return cube
    out = np.empty((len(cube), len(nodes), *cube.shape[2:]))
    for i, node in enumerate(nodes):
        if node in at:
            out[:, i] = cube[:, at[node]]
        else:
            sibling, _, parent = halves[node]
            np.subtract(parents[:, parent], cube[:, at[sibling]], out=out[:, i])
    return out


@dataclass
class Rows:
    """A written table and the number of tasks that read it."""

    df: object
    tasks: int


def _written(df):
    out = cut_lineage(df)
    return Rows(out, out.rdd.getNumPartitions())


def _prepared(df, columns, edges, labels, weights):
    """(session, x: bins, y: labels, w: 1 and weights, folds) rows in partitions of about ROWS, and the number of rows."""
    names = ["session", *columns, *labels, *weights, "folds"]

    def work(batches):
        for pdf in batches:
            yield pd.DataFrame(
                {
                    "session": pdf["session"],
                    "x": [r.tobytes() for r in binned(pdf, columns, edges)],
                    "y": list(pdf[labels].to_numpy(float)),
                    "w": list(pdf.assign(_1=1.0)[["_1", *weights]].to_numpy(float)),
                    "folds": pdf["folds"],
                }
            )

    made = df.select(*names)
    n = made.count()
    made = made.repartition(1 + n // ROWS, "session")
    return made.mapInPandas(work, "session long, x binary, y array<double>, w array<double>, folds array<int>"), n


class Held:
    """Rows of one task that grows the trees of its own fits; ``_summed`` works on them in place.

    ``base`` has the first score of each of these fits, and ``weights`` the columns of weights they use.
    """

    tasks = 1

    def __init__(self, batches, width, base, weights=None):
        parts = [Batch(b, width) for b in batches if len(b)]
        keep = slice(None) if weights is None else sorted(weights)
        self.w = np.concatenate([b.w[:, keep] for b in parts])
        self.at = {c: i for i, c in enumerate(keep)} if weights is not None else None
        for name in ("session", "x", "y", "folds"):
            setattr(self, name, np.concatenate([getattr(b, name) for b in parts]))
        self.n = len(self.session)
        self.turned = {1: np.ascontiguousarray(self.x.T)}
        self.score = {i: np.full(self.n, v) for i, v in base.items()}
        self.role, self.leaf, self.cubes = {}, {}, {}

    def score_of(self, i):
        return self.score[i]

    def weight(self, c):
        return self.w[:, c if self.at is None else self.at[c]]

    def sums(self, place, rows, values, nodes, bins, joint):
        """Sums of ``rows``; if ``joint``, with many rows for each cell, two or three features share their cells."""
        group = next((g for g in (3, 2) if joint and bins**g < 1 << 16 and len(rows) > 2 * nodes * bins**g), 1)
        if group not in self.turned:
            self.turned[group] = _codes(self.turned[1], group, bins)
        codes = self.turned[group][:, rows] if len(rows) < self.n else self.turned[group]
        if group == 1:
            return _binned_sums(place, codes, values, nodes, bins)
        return _joint_sums(place, codes, group, self.x.shape[1], values, nodes, bins)


class Batch:
    """Columns of a record batch as arrays."""

    def __init__(self, batch, width):
        n = len(batch)
        self.n = n
        self.session = batch.column("session").to_numpy()
        self.x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(n, width)
        # a missing label is NaN
        self.y, self.w, self.folds = (
            batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("y", "w", "folds")
        )
        self.score = batch.column("score").flatten().to_numpy().reshape(n, -1) if "score" in batch.schema.names else None

    def score_of(self, i):
        return self.score[:, i]

    def weight(self, c):
        return self.w[:, c]

    def sums(self, place, rows, values, nodes, bins, joint):
        return _binned_sums(place, self.x[rows].T, values, nodes, bins)


def _packed(sums):
    return pa.record_batch({"k": pa.array(list(sums), pa.int64()), "m": pa.array([v.tobytes() for v in sums.values()], pa.binary())})


def _merged(sums, rows, add):
    for k, m in rows:
        v = np.frombuffer(m, np.float64)
        sums[k] = add(sums[k], v) if k in sums else v
    return sums


def _summed(rows, width, work, add=np.add):
    """{key: combined array} of what ``work`` yields for each batch.

    Arrays of up to DIRECT tasks are combined by the driver; those of more tasks meet by key and
    salt first, so that the driver gets SALTS rows of a key whatever the number of tasks.
    """

    if isinstance(rows, Held):
        return dict(work(rows))

    def partial(batches):
        sums = {}
        for batch in batches:
            if len(batch):
                for k, v in work(Batch(batch, width)):
                    sums[k] = add(sums[k], v) if k in sums else v
        yield _packed(sums)

    def merge(batches):
        sums = {}
        for batch in batches:
            _merged(sums, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), add)
        yield _packed(sums)

    parts = rows.df.mapInArrow(partial, "k long, m binary")
    if rows.tasks > DIRECT:
        salt = F.pmod(F.xxhash64("m"), F.lit(SALTS))
        parts = parts.repartition(rows.tasks, "k", salt).mapInArrow(merge, "k long, m binary")
    got = parts.toArrow()
    return _merged({}, zip(got.column(0).to_pylist(), got.column(1).to_pylist()), add)


class Booster:
    """Fits all ``fits`` on rows (session, columns, labels, weight, folds: array of fold numbers)."""

    def __init__(self, columns, fits, rate=0.05, depth=5, bins=BINS, min_rows=1.0, penalty=1.0):
        self.columns, self.fits, self.rate, self.depth = list(columns), list(fits), rate, depth
        self.bins, self.min_rows, self.penalty = bins, min_rows, penalty
        self.labels = sorted({f.label for f in self.fits})
        self.weights = sorted({f.weight for f in self.fits if f.weight})
        self.label_of = [self.labels.index(f.label) for f in self.fits]
        self.weight_of = [1 + self.weights.index(f.weight) if f.weight else 0 for f in self.fits]

    def _starts(self, rows):
        """Starting scores and label spreads: means from one pass, quantiles from sketches."""
        fits, label_of, weight_of = self.fits, self.label_of, self.weight_of

        def work(b):
            for i, fit in enumerate(fits):
                y, w = b.y[:, label_of[i]], b.weight(weight_of[i])
                own, _ = roles(fit, y, b.session, b.folds)
                yield i, np.array([w[own].sum(), (w * y)[own].sum(), (w * y * y)[own].sum()])

        sums = _summed(rows, len(self.columns), work)
        models = []
        for i, fit in enumerate(fits):
            n, s, s2 = sums.get(i, np.zeros(3))
            mean = s / n if n else 0.0
            base = mean
            if fit.loss == "log":
                p = min(max(mean, 1e-6), 1 - 1e-6)
                base = np.log(p / (1 - p))
            elif fit.loss in ("pinball", "huber"):
                y = F.col("y")[label_of[i]]
                own = y.isNotNull() & ~F.isnan(y)
                if fit.fold is not None:
                    own = own & (F.col("folds")[fit.split] != fit.fold)
                base = rows.df.where(own).agg(F.percentile_approx(y, fit.q if fit.loss == "pinball" else 0.5, 10_000)).first()[0] or 0.0
            spread = np.sqrt(max(s2 / n - mean * mean, 0.0)) if n else 1.0
            models.append(Model(fit, float(base), float(spread) or 1.0, gains=np.zeros(len(self.columns))))
        return models

    def fit(self, df):
        self.edges = bin_edges(df, self.columns, self.bins)
        made, n = _prepared(df, self.columns, self.edges, self.labels, self.weights)
        rows = _written(made)
        self.large = n > ROWS
        self.models = self._starts(rows)
        if n <= HELD:
            self._grow_dealt(rows)
        else:
            self._grow(rows)
        for m in self.models:
            m.trees = m.trees[: m.best]
        return self

    def _grow_dealt(self, rows):
        """Every task reads all rows and makes all rounds of some of the fits."""
        spark = rows.df.sparkSession
        own = [i for i, f in enumerate(self.fits) if f.rounds]
        if not own:
            return
        tasks = min(len(own), spark.sparkContext.defaultParallelism)
        dealt = [own[i::tasks] for i in range(tasks)]

        def run(key, table):
            step, live = 0, dealt[key[0].as_py()]
            weights = {0, *(self.weight_of[i] for i in live)}
            held = Held(table.to_batches(), len(self.columns), {i: self.models[i].base for i in live}, weights)
            while live:
                loss = self._round(held, live, step)
                for i in live:
                    held.score[i] += self.models[i].trees[-1][3][held.leaf[i]]
                step += 1
                live = [i for i in live if self._goes_on(i, loss.get(i), step)]
            found = {i: self.models[i] for i in dealt[key[0].as_py()]}
            return pa.table({"m": pa.array([pickle.dumps(found)], pa.binary())})

        copies = rows.df.crossJoin(F.broadcast(spark.range(tasks).withColumnRenamed("id", "task")))
        spread = copies.repartitionByRange(tasks, "task").groupBy("task").applyInArrow(run, "m binary")
        for part in spread.toArrow().column("m").to_pylist():
            for i, m in pickle.loads(part).items():
                self.models[i] = m
        for i in own:
            # without rows no task has worked, and no round changes anything
            self.models[i].best = self.models[i].best or self.fits[i].rounds

    def _grow(self, rows):
        scored = Rows(rows.df.withColumn("score", F.array(*[F.lit(m.base) for m in self.models])), rows.tasks)
        written = step = 0
        live = [i for i, f in enumerate(self.fits) if f.rounds]
        while live:
            if step - written >= WRITTEN:
                scored = _written(self._advanced(scored.df, written))
                written = step
            held = self._round(scored, live, written)
            step += 1
            live = [i for i in live if self._goes_on(i, held.get(i), step)]

    def _goes_on(self, i, loss, step):
        m, fit = self.models[i], self.fits[i]
        if not fit.patience or (loss is None and m.loss == np.inf):
            m.best = step
        elif loss is not None and loss < m.loss - 1e-12:
            # the loss is that of the trees before the one just grown
            m.loss, m.best = loss, max(step - 1, 1)
        return step < fit.rounds and not (fit.patience and step - m.best > fit.patience)

    def _advanced(self, scored, first):
        width, pending = len(self.columns), [m.trees[first:] for m in self.models]

        def work(batches):
            for batch in batches:
                b = Batch(batch, width)
                score = b.score + np.stack([added(trees, b.x) for trees in pending], axis=1)
                offsets = pa.array(np.arange(b.n + 1) * score.shape[1], pa.int32())
                yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.ListArray.from_arrays(offsets, pa.array(score.ravel())))

        return scored.mapInArrow(work, scored.schema)

    def _round(self, scored, live, written):
        """Grows one tree for each live fit, a pass per level; returns the held rows' loss before it."""
        width, bins, size = len(self.columns), self.bins, 2 ** (self.depth + 1)
        fits, label_of, weight_of, large = self.fits, self.label_of, self.weight_of, self.large
        known = {i: (self.models[i].scale, self.models[i].trees[written:]) for i in live}
        trees = {i: (np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)) for i in live}
        used, held_loss = {i: 1 for i in live}, {}
        asked, halves = {i: [0] for i in live}, {i: {} for i in live}
        for level in range(self.depth):
            if not asked:
                break

            def work(b, asked=asked, level=level):
                for i, nodes in asked.items():
                    fit, (scale, pending) = fits[i], known[i]
                    y, w = b.y[:, label_of[i]], b.weight(weight_of[i])
                    own, held = _roles(b, i, fit, y)
                    s = b.score_of(i) + added(pending, b.x) if pending else b.score_of(i)
                    if level == 0 and held.any():
                        yield 2 * i + 1, np.array([(w * losses(fit, y, s, scale))[held].sum(), w[held].sum()])
                    # a task that holds its rows adds up the smaller child and knows the larger from their parent
                    halved = large and isinstance(b, Held)
                    summed = _smaller(nodes, halves[i]) if halved else nodes
                    place = np.full(size, -1)
                    place[summed] = np.arange(len(summed))
                    place = place[_placed(b, i, trees[i], level)]
                    rows = np.flatnonzero(own & (place >= 0))
                    g, h = slopes(fit, y[rows], s[rows], scale)
                    values = (g * w[rows], h * w[rows], None)
                    if large:
                        values = (rounded(fit, values[0], scale), rounded(fit, values[1], 1.0), None)
                    cube = b.sums(place[rows], rows, values, len(summed), bins, large)
                    if halved:
                        cube = b.cubes[i] = _both(cube, summed, nodes, halves[i], b.cubes.get(i))
                    yield 2 * i, cube.ravel()

            found = _summed(scored, width, work)
            following = {}
            for i, nodes in asked.items():
                if level == 0 and 2 * i + 1 in found:
                    held_loss[i] = found[2 * i + 1][0] / max(found[2 * i + 1][1], 1e-300)
                if 2 * i in found:
                    halves[i], children = self._split(trees[i], nodes, found[2 * i].reshape(3, len(nodes), width, bins), i, used)
                    if children:
                        following[i] = children
            asked = following
        trees = {i: tuple(part[: used[i]].copy() for part in tree) for i, tree in trees.items()}
        if isinstance(scored, Held):
            for i in live:
                scored.leaf[i] = _placed(scored, i, trees[i], self.depth)
        self._renewed(scored, trees, known)
        for i in live:
            self.models[i].trees.append(trees[i])
        return held_loss

    def _split(self, tree, nodes, cube, i, used):
        """Best split of each node from its sums.

        Returns {child: (its sibling, whether it has fewer rows, place of the parent)} and the children
        that are large enough to split.
        """
        feature, cut, left, value = tree
        g, h, n = (np.cumsum(c, axis=2) for c in cube)
        g_all, h_all, n_all = (c[:, :1, -1:] for c in (g, h, n))
        gain = g**2 / (h + self.penalty) + (g_all - g) ** 2 / (h_all - h + self.penalty) - g_all**2 / (h_all + self.penalty)
        good = (n >= self.min_rows) & (n_all - n >= self.min_rows)
        gain = np.where(good, gain, -np.inf).reshape(len(nodes), -1)
        best, halves, out = gain.argmax(axis=1), {}, []
        for p, node in enumerate(nodes):
            if node == 0:
                value[0] = -self.rate * g_all[p, 0, 0] / (h_all[p, 0, 0] + self.penalty)
            if not gain[p, best[p]] > 1e-12:
                continue
            f, b = divmod(int(best[p]), self.bins)
            child = used[i]
            used[i] += 2
            feature[node], cut[node], left[node] = f, b, child
            self.models[i].gains[f] += gain[p, best[p]]
            sides = ((g[p, f, b], h[p, f, b], n[p, f, b]), (g_all[p, 0, 0] - g[p, f, b], h_all[p, 0, 0] - h[p, f, b], n_all[p, 0, 0] - n[p, f, b]))
            fewer = int(sides[1][2] < sides[0][2])
            for k, (gs, hs, ns) in enumerate(sides):
                value[child + k] = -self.rate * gs / (hs + self.penalty)
                halves[child + k] = (child + 1 - k, k == fewer, p)
                if ns >= 2 * self.min_rows:
                    out.append(child + k)
        return halves, out

    def _renewed(self, scored, trees, known):
        """Leaves of pinball fits get the quantile of their rows' residuals, exactly.

        Counts in STEPS equal steps between a leaf's smallest and largest residual leave one step
        that holds the quantile; it is cut again until at most EXACT of its rows are left, whose
        residuals are then listed. Small leaves are listed at once.
        """
        fits, label_of, weight_of = self.fits, self.label_of, self.weight_of
        wanted = [i for i in trees if fits[i].loss == "pinball"]
        if not wanted:
            return
        width, steps = len(self.columns), STEPS

        def residuals(b, i):
            y, w = b.y[:, label_of[i]], b.weight(weight_of[i])
            own, _ = _roles(b, i, fits[i], y)
            r = (y - b.score_of(i) - added(known[i][1], b.x))[own]
            leaf = b.leaf[i][own] if isinstance(b, Held) else leaves(trees[i], b.x[own])
            return leaf, r, w[own]

        size = max(len(trees[i][0]) for i in wanted)
        # per leaf: smallest and largest residual (negated), rows with a weight
        def spans(b):
            for i in wanted:
                leaf, r, _ = residuals(b, i)
                low, high = np.full(size, np.inf), np.full(size, np.inf)
                np.minimum.at(low, leaf, r)
                np.minimum.at(high, leaf, -r)
                yield i, np.concatenate([low, high])

        large = scored.tasks > 1
        if large:
            bounds = {i: v.reshape(2, size) * [[1], [-1]] for i, v in _summed(scored, width, spans, np.minimum).items()}
        else:
            bounds = {i: np.stack([np.full(size, -np.inf), np.full(size, np.inf)]) for i in wanted}
        below = {i: np.zeros(size) for i in bounds}
        total = {}
        while large:

            def counts(b, bounds=bounds):
                for i, (low, high) in bounds.items():
                    leaf, r, w = residuals(b, i)
                    inside = (r >= low[leaf]) & (r <= high[leaf])
                    cell = leaf[inside] * steps + _step(r[inside], low[leaf[inside]], high[leaf[inside]], steps)
                    n = size * steps
                    yield i, np.concatenate([np.bincount(cell, w[inside], n), np.bincount(cell, minlength=n)])

            found, most = _summed(scored, width, counts), 0
            for i, (low, high) in bounds.items():
                weight, rows = found[i].reshape(2, size, steps)
                total.setdefault(i, weight.sum(axis=1))
                run = below[i][:, None] + np.cumsum(weight, axis=1)
                step = np.minimum((run < fits[i].q * total[i][:, None] - 1e-12).sum(axis=1), steps - 1)
                leaf = np.arange(size)
                wide = (high > low) & (rows.sum(axis=1) > EXACT)
                below[i] = np.where(wide, run[leaf, step] - weight[leaf, step], below[i])
                gap = np.where(wide, high - low, 0.0) / steps
                low, high = np.where(wide, low + step * gap, low), np.where(wide, low + (step + 1) * gap, high)
                bounds[i] = np.stack([low, high])
                most = max(most, rows[leaf, step][wide].max(initial=0))
            large = most > EXACT

        def listed(b):
            for i, (low, high) in bounds.items():
                leaf, r, w = residuals(b, i)
                inside = (r >= low[leaf]) & (r <= high[leaf])
                yield i, np.concatenate([leaf[inside], r[inside], w[inside]]).reshape(3, -1).T.ravel()

        join = lambda a, b: np.concatenate([a, b])
        for i, rows in _summed(scored, width, listed, join).items():
            leaf, r, w = rows.reshape(-1, 3).T
            value = trees[i][3]
            value[:] = 0.0
            for k in np.unique(leaf.astype(int)):
                own = np.flatnonzero(leaf == k)
                own = own[np.argsort(r[own], kind="stable")]
                run = np.cumsum(w[own]) + below[i][k]
                goal = fits[i].q * (total[i][k] if i in total else run[-1])
                value[k] = self.rate * r[own[min(np.searchsorted(run, goal - 1e-12), len(own) - 1)]]

    # --- results -------------------------------------------------------------------------

    def predict(self, df, keep=("session",), only=None):
        """``keep`` and p<i> for each fit (or each of ``only``): probabilities for the log loss."""
        chosen = list(range(len(self.fits)) if only is None else only)
        columns, edges, models, keep = self.columns, self.edges, {i: self.models[i] for i in chosen}, list(keep)

        def work(batches):
            for pdf in batches:
                x = binned(pdf, columns, edges)
                out = {c: pdf[c] for c in keep}
                for i, m in models.items():
                    out[f"p{i}"] = link(m.fit.loss, m.base + added(m.trees, x))
                yield pd.DataFrame(out)

        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"p{i} double" for i in chosen])
        return df.select(*dict.fromkeys([*keep, *columns])).mapInPandas(work, schema)

    def importance(self, i):
        """Share of the split gains by feature."""
        gains = self.models[i].gains
        return gains / gains.sum() if gains.sum() else gains


def _step(r, low, high, steps):
    """Number of the step of each residual between its leaf's bounds."""
    gap = np.maximum(high - low, 1e-300)
    return np.minimum(((r - low) / gap * steps).astype(np.int64), steps - 1)
