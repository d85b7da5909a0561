"""Words of a column of texts as numpy arrays, hashed without a Python loop over words.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Texts are handled in slices of about a megabyte, cut
between texts, so memory follows the slice (or the longest single text), not the batch.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)

_RANDOM = np.random.default_rng(20240501)
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xD6E8FEB86659FD93)


def mix(x):
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def small_batches(spark, size="8m"):
    """Rows go to Python workers in batches of at most ``size``, however long their texts are.

    A setting of the session, as the batches are cut when the returned table is computed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices(column, size=1 << 20):
    """(first row, bytes, text offsets) for slices of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


class Words:
    """starts, ends: byte places of the words; bounds: the words of text i are bounds[i]:bounds[i+1]."""

    def __init__(self, data, offsets, lower=False):
        self.data = (LOWER if lower else KEEP)[data]
        inside = ~SPACE[data]
        n = len(data)
        if n:
            edges = offsets[:-1][offsets[:-1] < n]
            begin = inside.copy()
            begin[1:] &= ~inside[:-1]
            begin[edges] = inside[edges]
            finish = inside.copy()
            finish[:-1] &= ~inside[1:]
            lasts = edges[edges > 0] - 1
            finish[lasts] = inside[lasts]
            self.starts = np.flatnonzero(begin)
            self.ends = np.flatnonzero(finish) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.inside = inside
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self):
        return len(self.starts)

    def counts(self):
        return np.diff(self.bounds)

    def hashes(self):
        """64-bit polynomial hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        power = np.full(int(lengths.max()), STEP, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        packed = self.data[self.inside]
        heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(len(packed)) - np.repeat(heads, lengths)
        return mix(np.add.reduceat(BYTE[packed] * power[place], heads) ^ lengths.astype(np.uint64))


def grams(hashes, bounds, k, step=STEP):
    """(hash, place of its first word, text) of every run of k words inside one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.flatnonzero(text[:n] == text[k - 1 :])
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= step
        h += hashes[j : n + j]
    return mix(h[place]), place, text[place]


def runs(text, count):
    """Offsets of the rows of each text in a table sorted by text."""
    return np.searchsorted(text, np.arange(count + 1))


def large_list(values, offsets, kind):
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
