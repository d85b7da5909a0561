"""Gaussian state models over bar sequences, fitted from summed statistics.

A pass runs forward-backward on blocks of sequences inside the tasks and exchanges only
sums of the size of the model. Several models (restarts, folds, clusters) share each pass, and those
of one size and the same sequences are worked on as one stack.
The sequences are written once as blocks of numbers. Where they are no larger than one partition,
the models are dealt over the tasks instead, and each task makes all passes of its models. Larger
ones are kept on the executors' disks while the passes run over them, a job for each.
"""

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import functions as F

from barsight.schemas import EMISSION_COLUMNS
from barsight.session import cut_lineage

# Fixed value: weight of the unit-free variance prior added to each state's scatter.
VARIANCE_PRIOR = 1e-2
BLOCK = 1024  # sequences that are worked on at once
PARTITION = 64 << 20  # bytes of sequences that one task may read for models of its own
SLOTS = 16  # tasks that add the sums of many tasks
DIRECT = 64  # tasks whose sums go to the driver as they are
CELLS = 1 << 21  # densities of a stack of models that are worked on at once
STEPS = 10  # bars whose densities are taken together
TIE = 1e-12  # share of a likelihood that rounding may change
RESCALE = 4  # bars between two scalings; each bar lowers the forward sums by 1e-20 at most


@dataclass
class StateModel:
    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    cov: np.ndarray
    kind: str = "diag"
    log_likelihood: float = -np.inf
    n_obs: float = 0.0
    converged: bool = False
    iterations: int = 0
    history: list = field(default_factory=list)

    @property
    def k(self):
        return len(self.start)

    def free_parameters(self):
        k, f = self.means.shape
        cov = {"diag": k * f, "full": k * f * (f + 1) // 2, "spherical": k, "tied": f * (f + 1) // 2}
        return (k - 1) + k * (k - 1) + k * f + cov[self.kind]

    def aic(self):
        return 2.0 * self.free_parameters() - 2.0 * self.log_likelihood

    def bic(self):
        return self.free_parameters() * np.log(max(self.n_obs, 2)) - 2.0 * self.log_likelihood

    def return_scale(self, ix=0):
        if self.kind in ("full", "tied"):
            var = self.cov[:, ix, ix]
        else:
            var = self.cov[:, ix]
        return self.means[:, ix], np.sqrt(np.maximum(var, 1e-16))


@dataclass(frozen=True)
class Job:
    """One model to fit: ``only`` keeps sequences of a tag, ``skip`` leaves a tag out.

    Where sequences carry a list of tags, ``group`` says which one is meant. A sequence with a
    negative tag belongs to no set that something is left out of.
    """

    k: int = 3
    kind: str = "diag"
    seed: int = 0
    only: int | None = None
    skip: int | None = None
    group: int | None = None

    def part(self):
        """Jobs with equal parts use the same sequences; ranks parts, without meaning."""
        return tuple(-1 if v is None else v for v in (self.group, self.only, self.skip))

    def uses(self, tags):
        if self.group is not None:
            tags = tags[:, self.group]
        if self.only is not None:
            return tags == self.only
        if self.skip is not None:
            return (tags != self.skip) & (tags >= 0)
        return np.ones(len(tags), bool)


def log_density(x, model):
    """(..., K) log densities of observations (..., F)."""
    f = x.shape[-1]
    if model.kind in ("diag", "spherical"):
        d = x[..., None, :] - model.means
        return -0.5 * (f * np.log(2 * np.pi) + np.log(model.cov).sum(-1) + (d * d / model.cov).sum(-1))
    out = []
    for k in range(model.k):
        root = np.linalg.cholesky(model.cov[k])
        z = np.linalg.solve(root, (x - model.means[k]).reshape(-1, f).T)
        logdet = 2.0 * np.log(np.diag(root)).sum()
        out.append((-0.5 * (f * np.log(2 * np.pi) + logdet + (z * z).sum(0))).reshape(x.shape[:-1]))
    return np.stack(out, axis=-1)


def forward_backward(x, model):
    """Posteriors (B, T, K), pair sums (B, K, K) and log-likelihood (B) of equally long sequences."""
    logs = log_density(x, model)
    top = logs.max(-1, keepdims=True)
    b = np.exp(logs - top)
    n, t, k = b.shape
    alpha, scale = np.empty_like(b), np.empty((n, t))
    for i in range(t):
        a = model.start * b[:, 0] if i == 0 else (alpha[:, i - 1] @ model.trans) * b[:, i]
        scale[:, i] = np.maximum(a.sum(1), 1e-300)
        alpha[:, i] = a / scale[:, i, None]
    beta = np.ones((n, k))
    post = np.empty_like(b)
    pairs = np.zeros((n, k, k))
    post[:, -1] = alpha[:, -1]
    for i in range(t - 2, -1, -1):
        right = b[:, i + 1] * beta / scale[:, i + 1, None]
        pairs += alpha[:, i, :, None] * model.trans * right[:, None, :]
        beta = right @ model.trans.T
        post[:, i] = alpha[:, i] * beta
    post /= np.maximum(post.sum(-1, keepdims=True), 1e-300)
    return post, pairs, np.log(scale).sum(1) + top[..., 0].sum(1)


def _steps(seq):
    """Lengths, ends and steps (all bars of all sequences, F) of a column of sequences; a missing value is NaN."""
    lengths = seq.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = seq.flatten().flatten()
    steps = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(max(lengths.sum(), 1), -1)
    return lengths, np.cumsum(lengths), steps, flat.null_count


def _stacks(seq, seen_bars=None):
    """Equally long sequences of a column, BLOCK at most: (row positions, array (B, T, F))."""
    lengths, ends, steps, _ = _steps(seq)
    starts = ends - lengths
    if seen_bars is not None:
        lengths = np.minimum(lengths, seen_bars)
    for t in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == t)
        for own in np.split(rows, range(BLOCK, len(rows), BLOCK)):
            yield own, steps[starts[own][:, None] + np.arange(t)]


def _sizes(k, f, kind):
    second = k * f * f if kind in ("full", "tied") else k * f
    return [k, k * k, k, k * f, second, 1]


def _blocks(batches):
    """Rows (t, n, tags, x) of at most BLOCK equally long sequences; x is (T, F, B), as bytes."""
    found = {}
    for batch in batches:
        seq, tags = batch.column("seq"), batch.column("tag")
        if pa.types.is_list(tags.type):
            tags = tags.flatten()
        tags = tags.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)
        lengths, ends, steps, missing = _steps(seq)
        if missing:
            raise ValueError("a sequence has missing values")
        for t in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == t)
            parts = found.setdefault(t, [])
            parts.append((steps[(ends[rows] - t)[:, None] + np.arange(t)], tags[rows]))
            if sum(len(x) for x, _ in parts) >= BLOCK:
                yield from _cut(t, found.pop(t))
    for t, parts in found.items():
        yield from _cut(t, parts)


def _cut(t, parts):
    x, tags = (np.concatenate(p) for p in zip(*parts))
    for i in range(0, len(x), BLOCK):
        own = tags[i : i + BLOCK]
        block = np.ascontiguousarray(x[i : i + BLOCK].transpose(1, 2, 0))
        yield pa.RecordBatch.from_pydict(
            {"t": [t], "n": [len(own)], "tags": [own.tobytes()], "x": [block.tobytes()]},
            pa.schema([("t", pa.int32()), ("n", pa.int32()), ("tags", pa.binary()), ("x", pa.binary())]),
        )


def _read_blocks(batches):
    """(x, tags) of written blocks; one tag a sequence is an array (B), several are (B, G)."""
    for batch in batches:
        for t, n, tags, x in zip(*(batch.column(c).to_pylist() for c in ("t", "n", "tags", "x"))):
            yield _block(t, n, tags, x)


def _block(t, n, tags, x):
    tags = np.frombuffer(tags, np.int64).reshape(n, -1)
    return np.frombuffer(x).reshape(t, -1, n), tags[:, 0] if tags.shape[1] == 1 else tags


def _statistics(x, model):
    """Summed statistics of a block (T, F, B): starts, pairs, occupancy, first and second moments, likelihood."""
    t, f, n = x.shape
    k = model.k
    b = np.ascontiguousarray(log_density(x.transpose(0, 2, 1), model).transpose(0, 2, 1))
    top = b.max(1)
    b -= top[:, None]
    np.exp(b, out=b)
    alpha, scale = np.empty_like(b), np.empty((t, n))
    turn = np.ascontiguousarray(model.trans.T)
    for i in range(t):
        a = model.start[:, None] * b[0] if i == 0 else np.dot(turn, alpha[i - 1]) * b[i]
        scale[i] = np.maximum(a.sum(0), 1e-300)
        np.divide(a, scale[i], out=alpha[i])
    b /= scale[:, None]
    post, pairs = alpha.copy(), np.zeros((k, k))
    beta = np.ones((k, n))
    for i in range(t - 2, -1, -1):
        right = b[i + 1] * beta
        pairs += np.dot(alpha[i], right.T)
        beta = np.dot(model.trans, right)
        post[i] *= beta
    post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
    turned = x.transpose(0, 2, 1)
    second = np.stack([np.matmul(x * post[:, j, None], turned).sum(0) for j in range(k)])
    ll = np.log(scale).sum() + top.sum()
    return np.concatenate(
        [post[0].sum(1), (pairs * model.trans).ravel(), post.sum((0, 2)), np.matmul(post, turned).sum(0).ravel(), second.ravel(), [ll]]
    )


def _design(x):
    """(T, 1 + 2F, B): ones, the block around its mean, and the squares of that; and the mean (F)."""
    t, f, n = x.shape
    centre = x.mean((0, 2))
    z = np.empty((t, 1 + 2 * f, n))
    z[:, 0] = 1.0
    np.subtract(x, centre[:, None], out=z[:, 1 : f + 1])
    np.multiply(z[:, 1 : f + 1], z[:, 1 : f + 1], out=z[:, f + 1 :])
    return z, centre


def _stack_statistics(z, centre, models):
    """``_statistics`` of several models of one size with variances only, a row each.

    Densities and moments are products with the design of the block; the recursions run over all
    models at once and are scaled every RESCALE bars, and at the last one.
    """
    t, _, n = z.shape
    k, f = models[0].means.shape
    most = max(1, CELLS // (t * k * n))
    if len(models) > most:
        return np.concatenate([_stack_statistics(z, centre, models[i : i + most]) for i in range(0, len(models), most)])
    m = len(models)
    means = np.stack([q.means for q in models]) - centre
    cov = np.broadcast_to(np.stack([q.cov for q in models]), means.shape)
    level = -0.5 * (f * np.log(2 * np.pi) + (np.log(cov) + means * means / cov).sum(2))
    weights = np.concatenate([level[:, :, None], means / cov, -0.5 / cov], axis=2).reshape(m * k, -1)
    start, trans = np.stack([q.start for q in models]), np.stack([q.trans for q in models])
    turn = np.ascontiguousarray(trans.transpose(0, 2, 1))
    b, alpha = np.empty((t, m, k, n)), np.empty((t, m, k, n))
    scales, ll = {}, np.zeros(m)
    for low in range(0, t, STEPS):
        part = b[low : low + STEPS]
        np.matmul(weights, z[low : low + STEPS], out=part.reshape(-1, m * k, n))
        # the exponential of an exact zero is slow, so the largest is -1
        top = part.max(2) + 1.0
        ll += top.sum((0, 2))
        part -= top[:, :, None]
        np.exp(part, out=part)
        for i in range(low, min(low + STEPS, t)):
            if i:
                np.matmul(turn, alpha[i - 1], out=alpha[i])
                alpha[i] *= b[i]
            else:
                np.multiply(b[0], start[:, :, None], out=alpha[0])
            if i % RESCALE == RESCALE - 1 or i == t - 1:
                scales[i] = np.maximum(alpha[i].sum(1, keepdims=True), 1e-300)
                alpha[i] /= scales[i]
                ll += np.log(scales[i]).sum((1, 2))
    beta, post = np.ones((m, k, n)), np.empty((min(STEPS, t), m, k, n))
    pairs, moments = np.zeros((m, k, k)), np.zeros((m * k, z.shape[1]))
    for low in reversed(range(0, t, STEPS)):
        high = min(low + STEPS, t)
        for i in range(high - 1, low - 1, -1):
            if i < t - 1:
                right = b[i + 1]
                right *= beta
                if i + 1 in scales:
                    right /= scales[i + 1]
                np.matmul(trans, right, out=beta)
            np.multiply(alpha[i], beta, out=post[i - low])
        last = min(high, t - 1)
        pairs += np.matmul(alpha[low:last], b[low + 1 : last + 1].transpose(0, 1, 3, 2)).sum(0)
        own = post[: high - low].reshape(high - low, m * k, n)
        moments += np.matmul(own, z[low:high].transpose(0, 2, 1)).sum(0)
    moments = moments.reshape(m, k, -1)
    occupancy, first = moments[..., :1], moments[..., 1 : f + 1]
    second = moments[..., f + 1 :] + centre * (2 * first + occupancy * centre)
    first = first + occupancy * centre
    parts = [post[0].sum(2), pairs * trans, occupancy, first, second, ll]
    return np.concatenate([p.reshape(m, -1) for p in parts], axis=1)


def _maximise(model, sums, floor):
    k, f = model.means.shape
    parts = np.split(sums, np.cumsum(_sizes(k, f, model.kind))[:-1])
    start, pairs, n, s1, s2 = parts[0], parts[1].reshape(k, k), parts[2], parts[3].reshape(k, f), parts[4]
    n = np.maximum(n, 1e-10)
    means = s1 / n[:, None]
    if model.kind in ("full", "tied"):
        scatter = s2.reshape(k, f, f) - n[:, None, None] * means[:, :, None] * means[:, None, :]
        prior = VARIANCE_PRIOR * np.eye(f)
        if model.kind == "tied":
            cov = np.repeat(((scatter.sum(0) + prior) / n.sum())[None], k, axis=0)
        else:
            cov = (scatter + prior) / n[:, None, None]
        ix = np.arange(f)
        cov[:, ix, ix] = np.maximum(cov[:, ix, ix], floor)
    else:
        scatter = np.maximum(s2.reshape(k, f) - n[:, None] * means**2, 0.0)
        cov = (scatter + VARIANCE_PRIOR) / n[:, None]
        if model.kind == "spherical":
            cov = np.repeat(cov.mean(1, keepdims=True), f, axis=1)
        cov = np.maximum(cov, floor)
    trans = pairs + 1e-12
    return StateModel(
        (start + 1e-12) / (start + 1e-12).sum(), trans / trans.sum(1, keepdims=True), means, cov, model.kind,
        history=model.history, iterations=model.iterations + 1,
    )


def _first_model(job, mean, var, restart):
    """Start: states spread over the return axis, or random around the mean on restarts."""
    rng = np.random.default_rng([job.seed, restart])
    f = len(mean)
    spread = np.linspace(-1.0, 1.0, job.k)[:, None] * np.sqrt(var) if job.k > 1 else np.zeros((1, f))
    means = mean + (spread if restart == 0 else rng.standard_normal((job.k, f)) * np.sqrt(var))
    trans = np.full((job.k, job.k), 0.2 / max(job.k - 1, 1)) if job.k > 1 else np.ones((1, 1))
    if job.k > 1:
        np.fill_diagonal(trans, 0.8)
    if job.kind in ("full", "tied"):
        cov = np.repeat(np.diag(var)[None], job.k, axis=0)
    else:
        cov = np.repeat(var[None], job.k, axis=0)
        if job.kind == "spherical":
            cov = np.repeat(cov.mean(1, keepdims=True), f, axis=1)
    return StateModel(np.full(job.k, 1.0 / job.k), trans, means, cov, job.kind)


def _added(blocks, work):
    sums = {}
    for x, tags in blocks:
        for k, v in work(x, tags).items():
            sums[k] = sums.get(k, 0.0) + v
    return sums


def _kept(blocks):
    """(t, n, tags, x) of written blocks on the executors' disks; a lost one is read again."""
    return blocks.rdd.map(lambda r: (r.t, r.n, bytes(r.tags), bytes(r.x))).persist(StorageLevel.DISK_ONLY)


def _sums(kept, work):
    """Sum ``work(x, tags) -> {id: array}`` over all kept blocks."""
    parts = kept.mapPartitions(lambda rows: _added((_block(*r) for r in rows), work).items())
    if kept.getNumPartitions() > DIRECT:
        parts = parts.reduceByKey(np.add, SLOTS)
    out = {}
    for k, m in parts.collect():
        out[k] = out.get(k, 0.0) + m
    return out


def _joined(blocks):
    """Equally long blocks put together up to BLOCK sequences."""
    found = {}
    for x, tags in blocks:
        parts = found.setdefault(x.shape[0], [])
        parts.append((x, tags))
        if sum(p.shape[2] for p, _ in parts) >= BLOCK:
            yield _one(found.pop(x.shape[0]))
    for parts in found.values():
        yield _one(parts)


def _one(parts):
    xs, tags = zip(*parts)
    return np.concatenate(xs, axis=2), np.concatenate(tags)


def _dealt(blocks, jobs, keys, fit):
    """``fit(total, keys)`` of all keys, dealt over the tasks; each task reads all blocks."""
    spark = blocks.sparkSession
    tasks = min(len(keys), spark.sparkContext.defaultParallelism)
    # models of the same sequences meet in a task, where they make a stack
    near = sorted(keys, key=lambda key: (jobs[key[0]].part(), key[1], key[0]))
    own = [near[len(near) * i // tasks : len(near) * (i + 1) // tasks] for i in range(tasks)]

    def run(key, table):
        held = list(_joined(_read_blocks(table.to_batches())))
        runs = fit(lambda work: _added(held, work), own[key[0].as_py()])
        return pa.table({"m": pa.array([pickle.dumps(runs)], pa.binary())})

    copies = blocks.crossJoin(F.broadcast(spark.range(tasks).withColumnRenamed("id", "task")))
    spread = copies.repartitionByRange(tasks, "task").groupBy("task").applyInArrow(run, "m binary")
    return {k: v for m in spread.toArrow().column("m").to_pylist() for k, v in pickle.loads(m).items()}


def fit_models(seqs, jobs, n_iter=200, tol=1e-4, n_starts=5, min_covar=1e-4, columns=EMISSION_COLUMNS):
    """Fit every job with restarts; all of them advance in the same passes.

    ``seqs``: session, seq (array of vectors), tag (integer). Converged fits win over
    others, then the higher likelihood. States are ordered by their mean return.

    Sequences of more than PARTITION bytes are read by one job for each pass; smaller ones by each
    task that fits some of the models.
    """
    if "tag" not in seqs.columns:
        seqs = seqs.withColumn("tag", F.lit(0))
    f = len(columns)
    cores = seqs.sparkSession.sparkContext.defaultParallelism
    made = seqs.where(F.size("seq") > 0).select("seq", "tag").repartition(cores, F.xxhash64("session"))
    blocks = cut_lineage(made.mapInArrow(_blocks, "t int, n int, tags binary, x binary"))
    cells = blocks.agg(F.sum(F.col("t").cast("long") * F.col("n"))).first()[0] or 0
    keys = [(j, s) for j in range(len(jobs)) for s in range(max(1, n_starts))]
    fit = lambda total, keys: _em(total, jobs, keys, f, n_iter, tol, min_covar)
    if cells * f * 8 <= PARTITION:
        runs = _dealt(blocks, jobs, keys, fit)
    else:
        kept = _kept(blocks)
        runs = fit(lambda work: _sums(kept, work), keys)
        kept.unpersist()
    for j, job in enumerate(jobs):
        if (j, 0) not in runs:
            raise ValueError(f"no sequences for {job}")
    return [_ordered(_best([runs[key] for key in keys if key[0] == j])) for j in range(len(jobs))]


def _best(runs):
    """Converged fits win, then the higher likelihood, then the earlier restart."""
    able = [m for m in runs if m.converged] or runs
    most = max(m.log_likelihood for m in able)
    return next((m for m in able if m.log_likelihood >= most - TIE * abs(most)), able[0])


def _em(total, jobs, keys, f, n_iter, tol, min_covar):
    """{(job, restart): model} of the keys whose job has sequences.

    ``total(work)`` adds ``work(x, tags) -> {id: array}`` over all blocks.
    """

    def first_moments(x, tags):
        out = {}
        for j in {j for j, _ in keys}:
            part = x[..., jobs[j].uses(tags)]
            if part.shape[2]:
                out[j] = np.concatenate([[part.shape[0] * part.shape[2]], part.sum((0, 2)), (part * part).sum((0, 2))])
        return out

    base = total(first_moments)
    runs, floors, sizes = {}, {}, {}
    for j, s in keys:
        if j in base:
            n = base[j][0]
            mean = base[j][1 : f + 1] / n
            var = np.maximum(base[j][f + 1 :] / n - mean**2, 1e-8)
            floors[j], sizes[j] = np.maximum(var * min_covar, 1e-8), n
            runs[j, s] = _first_model(jobs[j], mean, var, s)
    active = list(runs)
    for step in range(n_iter + 1):
        if not active:
            break
        # restarts, sizes and kinds of a part use the same sequences
        now = {}
        for i, key in enumerate(active):
            now.setdefault(jobs[key[0]].part(), (jobs[key[0]], {}))[1].setdefault((runs[key].k, runs[key].kind), []).append((i, runs[key]))

        def work(x, tags, now=now):
            out, whole = {}, None
            for job, groups in now.values():
                own = job.uses(tags)
                if not own.any():
                    continue
                rows = None if own.all() else np.flatnonzero(own)
                z = None
                for (_, kind), members in groups.items():
                    if kind in ("full", "tied"):
                        part = x if rows is None else x.take(rows, axis=2)
                        out.update((i, _statistics(part, model)) for i, model in members)
                        continue
                    whole = _design(x) if whole is None else whole
                    if z is None:
                        z = whole[0] if rows is None else whole[0].take(rows, axis=2)
                    out.update(zip((i for i, _ in members), _stack_statistics(z, whole[1], [model for _, model in members])))
            return out

        found = total(work)
        following = []
        for i, key in enumerate(active):
            model = runs[key]
            ll = float(found[i][-1])
            previous = model.history[-1] if model.history else -np.inf
            model.history.append(ll)
            model.log_likelihood, model.n_obs = ll, sizes[key[0]]
            # a gain that rounding could make is none
            if ll - previous < max(tol, 0.1 * TIE * abs(ll)):
                model.converged = True
            elif step < n_iter:
                runs[key] = _maximise(model, found[i], floors[key[0]])
                following.append(key)
        active = following
    return runs


def _ordered(m):
    order = np.argsort(m.means[:, 0], kind="stable")
    m.start, m.trans = m.start[order], m.trans[np.ix_(order, order)]
    m.means, m.cov = m.means[order], m.cov[order]
    return m


def posteriors(seqs, models, seen_bars=None, of=None):
    """Per session and model: final posterior, occupancy, next-state mix, log-likelihood, entropy.

    ``of`` gives a tag for each model, which then reads sequences of that tag only.
    """

    def lists(values):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))

    def run(batches):
        for batch in batches:
            sessions, seq = batch.column("session"), batch.column("seq")
            tags = None if of is None else batch.column("tag").to_numpy(zero_copy_only=False)
            for rows, x in _stacks(seq, seen_bars):
                for j, m in enumerate(models):
                    own = slice(None) if of is None else tags[rows] == of[j]
                    if not len(rows[own]):
                        continue
                    post, _, ll = forward_backward(x[own], m)
                    final = post[:, -1]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "session": sessions.take(pa.array(rows[own])).cast(pa.int64()),
                            "model": pa.array(np.full(len(ll), j), pa.int32()),
                            "final": lists(final),
                            "occupancy": lists(post.mean(1)),
                            "following": lists(final @ m.trans),
                            "loglik": ll,
                            "entropy": -(final * np.log(np.clip(final, 1e-12, 1.0))).sum(1),
                        }
                    )

    schema = (
        "session long, model int, final array<double>, occupancy array<double>, "
        "following array<double>, loglik double, entropy double"
    )
    return seqs.select("session", "seq", *(["tag"] if of is not None else [])).mapInArrow(run, schema)


def posterior_features(seqs, model, seen_bars=None, prefix="hmm"):
    """3K + 2 columns per session."""
    p = posteriors(seqs, [model], seen_bars)
    cols = []
    for name, source in (("pfinal", "final"), ("pocc", "occupancy"), ("pnext", "following")):
        cols += [F.col(source)[k].alias(f"{prefix}_{name}_{k}") for k in range(model.k)]
    return p.select(
        "session", *cols, F.col("loglik").alias(f"{prefix}_loglik"), F.col("entropy").alias(f"{prefix}_entropy")
    )


# --- forward distribution ----------------------------------------------------------------


def forward_table(model, horizon=50, points=513, return_ix=0, noise=True):
    """Exact forward distribution of the summed return from every state.

    Returns mean of R, P(R > 0), the grid of summed log returns and the distribution function
    per state (characteristic function of the state chain, inverted numerically).
    """
    mu, sigma = model.return_scale(return_ix)
    if not noise:
        sigma = np.full_like(sigma, 1e-6)
    step = model.trans * np.exp(mu + sigma**2 / 2)
    mean = np.linalg.matrix_power(step, horizon) @ np.ones(model.k) - 1.0
    # moments of the sum bound the grid
    m1, m2 = np.zeros(model.k), np.zeros(model.k)
    for _ in range(horizon):
        m2 = model.trans @ (mu**2 + sigma**2 + 2 * mu * m1 + m2)
        m1 = model.trans @ (mu + m1)
    sd = np.sqrt(np.maximum(m2 - m1**2, 1e-16))
    low, high = (m1 - 8 * sd).min(), (m1 + 8 * sd).max()
    grid = np.linspace(low, high, points)
    reach = 9.0 / max(sigma.min() * np.sqrt(horizon), sd.min() / 50)
    n_t = int(min(max(4096, 4 * reach * (high - low)), 1 << 15))
    dt = reach / n_t
    t = (np.arange(n_t) + 0.5) * dt
    phi = np.ones((n_t, model.k), complex)
    emit = np.exp(1j * t[:, None] * mu - 0.5 * (t[:, None] * sigma) ** 2)
    for _ in range(horizon):
        phi = (emit * phi) @ model.trans.T

    def cdf(x):
        turn = np.exp(-1j * np.outer(x, t)) / t
        return np.clip(0.5 - (turn @ phi).imag.T * dt / np.pi, 0.0, 1.0)

    table = np.maximum.accumulate(np.concatenate([cdf(g) for g in np.array_split(grid, 16)], axis=1), axis=1)
    return {"mean": mean, "p_up": 1.0 - cdf(np.zeros(1))[:, 0], "grid": grid, "cdf": table}


def state_rows(spark, table):
    """The forward table as a small DataFrame."""
    rows = [(k, float(table["mean"][k]), float(table["p_up"][k])) for k in range(len(table["mean"]))]
    return spark.createDataFrame(rows, "state int, mean_return double, p_up double")


def dot(array_column, values):
    out = F.lit(0.0)
    for k, v in enumerate(values):
        out = out + F.col(array_column)[k] * float(v)
    return out


def forecast(weights, tables, qs=(0.1, 0.5, 0.9)):
    """Prediction contract from (session, w): w weighs the states of all tables in order.

    mu and p_up are dot products; quantiles invert the weighted distribution function.
    """
    mean = np.concatenate([t["mean"] for t in tables])
    p_up = np.concatenate([t["p_up"] for t in tables])
    low = min(t["grid"][0] for t in tables)
    high = max(t["grid"][-1] for t in tables)
    grid = np.linspace(low, high, 1025)
    cdf = np.vstack([[np.interp(grid, t["grid"], row, 0.0, 1.0) for row in t["cdf"]] for t in tables])

    def invert(batches):
        for pdf in batches:
            mix = np.stack(pdf["w"].to_numpy()) @ cdf
            out = {"session": pdf["session"], "mu": pdf["mu"], "p_up": pdf["p_up"]}
            for name, q in zip(("q_lower", "q_median", "q_upper"), qs):
                at = np.clip((mix < q).sum(1), 1, len(grid) - 1)
                rows = np.arange(len(mix))
                f0, f1 = mix[rows, at - 1], mix[rows, at]
                share = np.clip((q - f0) / np.maximum(f1 - f0, 1e-300), 0.0, 1.0)
                out[name] = np.exp(grid[at - 1] + share * (grid[at] - grid[at - 1])) - 1.0
            out["u"] = np.maximum(out["q_upper"] - out["q_lower"], 1e-6)
            yield pd.DataFrame(out)

    rows = weights.select("session", dot("w", mean).alias("mu"), dot("w", p_up).alias("p_up"), "w")
    schema = "session long, mu double, p_up double, q_lower double, q_median double, q_upper double, u double"
    return rows.mapInPandas(invert, schema)


def forecast_sessions(seqs, model, horizon=50, seen_bars=50):
    post = posteriors(seqs, [model], seen_bars).select("session", F.col("final").alias("w"))
    return forecast(post, [forward_table(model, horizon)])


def responsibilities(scores, temperature=1.0, by=("session",)):
    """Softmax of per-model log-likelihoods: (session, resp array, best model), models in order within ``by``."""
    logs = F.transform(
        F.sort_array(F.collect_list(F.struct("model", "loglik"))), lambda s: s["loglik"]
    )
    wide = scores.groupBy(*by).agg(logs.alias("ll"))
    scaled = F.transform("ll", lambda x: F.exp((x - F.array_max("ll")) / max(temperature, 1e-6)))
    wide = wide.withColumn("_e", scaled)
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    best = F.array_position("ll", F.array_max("ll")) - 1
    return wide.select(
        *by, "ll", F.transform("_e", lambda x: x / total).alias("resp"), best.cast("int").alias("best")
    )


def mixture_forecast(seqs, models, horizon=50, seen_bars=50, temperature=1.0):
    """Forecast of the cluster mixture: state weights are responsibility times posterior."""
    post = posteriors(seqs, models, seen_bars)
    resp = responsibilities(post, temperature).select("session", "resp")
    states = F.flatten(
        F.transform(F.sort_array(F.collect_list(F.struct("model", "final"))), lambda s: s["final"])
    )
    wide = post.groupBy("session").agg(states.alias("s")).join(resp, "session")
    owner = np.repeat(np.arange(len(models)), [m.k for m in models])
    weight = F.array(*[F.col("resp")[int(j)] * F.col("s")[i] for i, j in enumerate(owner)])
    return forecast(wide.select("session", weight.alias("w")), [forward_table(m, horizon) for m in models])
