"""Text quality by a convolution over bytes, in numpy."""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barsight.llm.words import slices, small_batches

WIDTH = 8  # bytes under a filter
STRIDE = 2
HALF = 128  # bytes; a chunk is two halves, chunks overlap by one
FILTERS = 24
SAMPLE = 3000  # labelled rows that the network is fitted on, at most
WINDOW = 40_000  # characters of a drawn text that the network is fitted on, from a place given by its id
BLOCK = 1 << 13  # halves whose filter outputs are held at once
PART = 1 << 18  # bytes of a batch whose gradients are taken at once
STEPS = 600  # of 64 texts each


def laid_out(data, offsets):
    """Texts on a zeroed buffer, each from a multiple of HALF with WIDTH zeros behind it at least."""
    sizes = np.diff(offsets)
    halves = (sizes + WIDTH + HALF - 1) // HALF
    at = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(at[-1] * HALF + WIDTH, np.uint8)
    shift = np.repeat(at[:-1] * HALF - offsets[:-1], sizes)
    out[np.arange(len(data)) + shift] = data
    return out, at


def responses(buffer, table, bias, last):
    """Filter outputs at every STRIDE-th byte: (halves, places of a half, filters).

    In the ``last`` half of a text the places whose filters would reach into the next text are left
    out; the filter before them saw only zeros too, so a text's outputs do not depend on what follows.
    """
    n = (len(buffer) - WIDTH) // STRIDE
    out = np.repeat(bias[None, :], n, axis=0)
    for j in range(WIDTH):
        out += table[j].take(buffer[j : j + n * STRIDE : STRIDE], axis=0)
    out = out.reshape(-1, HALF // STRIDE, len(bias))
    out[last, 1 - WIDTH // STRIDE :] = -np.inf
    return out


def chunk_rows(at):
    """(first half, second half, text) of the chunks that cover each text."""
    halves = np.diff(at)
    chunks = np.maximum(halves - 1, 1)
    text = np.repeat(np.arange(len(halves)), chunks)
    starts = np.concatenate([[0], np.cumsum(chunks)])
    first = np.arange(starts[-1]) - starts[text] + at[text]
    return first, np.minimum(first + 1, at[text + 1] - 1), text, starts


def features(buffer, at, net):
    """Mean and maximum over a text's chunks of each filter's largest output in the chunk."""
    last = at[1:] - 1
    half = []
    for a in range(0, at[-1], BLOCK):
        inside = last[(last >= a) & (last < a + BLOCK)] - a
        out = responses(buffer[a * HALF : (a + BLOCK) * HALF + WIDTH], net["table"], net["bias"], inside)
        half.append(np.maximum(out.max(axis=1), 0))
    half = np.concatenate(half)
    first, second, _, starts = chunk_rows(at)
    chunk = np.maximum(half[first], half[second])
    mean = np.add.reduceat(chunk, starts[:-1], axis=0) / np.diff(starts)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(chunk, starts[:-1], axis=0)], axis=1)


def probability(x, net):
    return 1 / (1 + np.exp(-np.clip(x @ net["weight"] + net["offset"], -30, 30)))


def _gradients(raw, label, net):
    """Gradients of the mean loss of a batch, summed over parts of it that keep filter outputs small."""
    parts, size = [[]], 0
    for i, text in enumerate(raw):
        if size and size + len(text) > PART:
            parts.append([])
            size = 0
        parts[-1].append(i)
        size += len(text)
    total = None
    for part in parts:
        offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in part])])
        data = np.frombuffer(b"".join(raw[i] for i in part), np.uint8)
        grad = _part_gradients(*laid_out(data, offsets), label[part], len(raw), net)
        total = grad if total is None else {k: total[k] + grad[k] for k in grad}
    return total


def _part_gradients(buffer, at, label, rows, net):
    out = responses(buffer, net["table"], net["bias"], at[1:] - 1)
    where = out.argmax(axis=1)
    half = np.take_along_axis(out, where[:, None, :], axis=1)[:, 0, :]
    live = half > 0
    half = np.maximum(half, 0)
    first, second, text, starts = chunk_rows(at)
    left = half[first] >= half[second]
    chunk = np.where(left, half[first], half[second])
    counts = np.diff(starts)
    mean = np.add.reduceat(chunk, starts[:-1], axis=0) / counts[:, None]
    top = np.maximum.reduceat(chunk, starts[:-1], axis=0)
    x = np.concatenate([mean, top], axis=1)
    error = (probability(x, net) - label) / rows
    back = error[:, None] * net["weight"][None, :]
    f = half.shape[1]
    at_top = (chunk == top[text]).astype(np.float32)  # neighbours share a half, so several chunks may be at the top
    at_top /= np.add.reduceat(at_top, starts[:-1], axis=0)[text]
    to_chunk = back[text, :f] / counts[text][:, None] + at_top * back[text, f:]
    to_half = np.zeros_like(half)
    source = np.where(left, first[:, None], second[:, None])
    column = np.broadcast_to(np.arange(f), source.shape)
    np.add.at(to_half, (source, column), to_chunk)
    to_half *= live
    grad = {"weight": x.T @ error, "offset": error.sum(), "bias": to_half.sum(axis=0), "table": np.zeros_like(net["table"])}
    place = np.arange(len(half))[:, None] * HALF + where * STRIDE
    column = np.broadcast_to(np.arange(f), place.shape)
    for j in range(WIDTH):
        np.add.at(grad["table"][j], (buffer[place + j], column), to_half)
    return grad


def fit(texts, labels, steps=STEPS, filters=FILTERS, batch=64, rate=0.01, seed=3):
    """Adam on the log loss of whole texts, or their UTF-8 bytes. Without both labels the net gives their share."""
    rng = np.random.default_rng(seed)
    net = {
        "table": rng.normal(0, 0.3, (WIDTH, 256, filters)).astype(np.float32),
        "bias": np.zeros(filters, np.float32),
        "weight": rng.normal(0, 0.1, 2 * filters).astype(np.float32),
        "offset": np.float32(0),
    }
    y = np.asarray(labels, np.float32)
    share = (y.sum() + 1) / (len(y) + 2)
    net["offset"] = np.float32(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        net["weight"][:] = 0
        return net
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    while step < steps:
        order = rng.permutation(len(y))
        # neighbours of like length share a batch, batches come in random order
        groups = [order[i : i + 8 * batch] for i in range(0, len(order), 8 * batch)]
        for group in groups:
            group = group[np.argsort([len(raw[i]) for i in group], kind="stable")]
            parts = [group[i : i + batch] for i in range(0, len(group), batch)]
            for p in rng.permutation(len(parts)):
                chosen = parts[p]
                grad = _gradients([raw[i] for i in chosen], y[chosen], net)
                step += 1
                pace = rate * (0.5 if 2 * step >= steps else 1) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k in net:
                    first[k] = 0.9 * first[k] + 0.1 * grad[k]
                    second[k] = 0.999 * second[k] + 0.001 * np.square(grad[k])
                    net[k] = (net[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


def _scored(batches, net):
    for batch in batches:
        for first, data, offsets in slices(batch.column(1), 1 << 18):
            score = probability(features(*laid_out(data, offsets), net.value), net.value)
            n = len(offsets) - 1
            yield pa.record_batch({"id": batch.column(0).slice(first, n), "held": batch.column(2).slice(first, n), "score": pa.array(score.astype(np.float64))})


def held_out(id_column, folds=5):
    """crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == 0, F.lit(False))


def fitted(docs, labels, id_col, text_col, label_col, sample):
    """The network fitted on the sample, as a broadcast."""
    small_batches(docs.sparkSession)
    rows = sample_rows(docs, labels, id_col, text_col, label_col, sample).toArrow()
    texts, marks = rows["text"].cast(pa.binary()), rows["label"].to_pylist()
    # views on the Arrow buffers: the driver holds the drawn texts once
    return docs.sparkSession.sparkContext.broadcast(fit([memoryview(t.as_buffer()) for t in texts], marks))


def sample_rows(docs, labels, id_col, text_col, label_col, rows=SAMPLE):
    """At most ``rows`` labelled training texts, those with the smallest id hashes; of longer ones a window."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    texts = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.pmod(F.xxhash64(F.col(id_col)), F.greatest(F.length(text) - WINDOW + 1, F.lit(1))).cast("int")
    texts = texts.select(F.col(id_col).alias("id"), F.substring(text, start + 1, F.lit(WINDOW)).alias("text"))
    # ids first, so that only the drawn rows carry their text through the sort
    ids = texts.select("id").distinct().join(marks, "id").orderBy(F.xxhash64("id"), "id").limit(rows)
    return texts.join(F.broadcast(ids), "id").select("text", "label")


def quality_scores(docs, labels, id_col="doc_id", text_col="text", label_col="quality", threshold=0.3, sample=SAMPLE):
    """One row per input row: id, held_out, score, predicted.

    Learned byte filters slide over overlapping chunks that cover the whole text; each chunk keeps
    a filter's largest output, and their mean and maximum over the chunks give one probability.
    The network is fitted on at most ``sample`` labelled rows whose crc32(id) mod 5 is not 0, on
    at most WINDOW characters of each; every row is scored, on its whole text. Only the text is an input.

    Null and empty texts are scored as a text without bytes. Without labels, or with one kind only,
    the score is the smoothed share of label 1. Conflicting labels of an id count as the larger.
    Null ids are scored. Repeated rows score alike. Other columns are not read.
    """
    net = fitted(docs, labels, id_col, text_col, label_col, sample)
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held"))
    out = out.mapInArrow(partial(_scored, net=net), "id long, held boolean, score double")
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def good_texts(docs, labels, id_col="doc_id", text_col="text", **settings):
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    Rows of one id are judged one by one; texts travel through the scoring once, with their row.
    """
    threshold = settings.pop("threshold", 0.3)
    net = fitted(docs, labels, id_col, text_col, settings.pop("label_col", "quality"), settings.pop("sample", SAMPLE))
    return docs.mapInArrow(partial(_accepted, net=net, at=docs.columns.index(text_col), threshold=threshold), docs.schema)


def _accepted(batches, net, at, threshold):
    for batch in batches:
        score = [probability(features(*laid_out(d, o), net.value), net.value) for _, d, o in slices(batch.column(at), 1 << 18)]
        yield batch.filter(pa.array(np.concatenate(score) >= threshold)) if score else batch
