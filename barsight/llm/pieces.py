"""SentencePiece segmentation, its N-best list, and decoding, over a piece lattice."""

import heapq
import re
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barsight.llm.class_lm import Lookup
from barsight.llm.words import STEP, mix

BLANK = "▁"  # stands for a space inside pieces
SPACES = re.compile(" +[^ ]*|[^ ]+")
BEST = 4
UNUSABLE = -1e8  # scores below mark pieces that are all but barred
PENALTY = 10.0  # below the worst piece, for a character without one


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces of a model file with their scores, found by hash."""

    def __init__(self, path):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(self.text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        # what each piece adds to a text
        self.spoken = [bytes([byte_of[i]]) if i in byte_of else t.replace(BLANK, " ").encode() for i, t in enumerate(self.text)]
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        # pieces that go over a word's start can't be used when words are segmented one by one
        plain = [i for i in plain if BLANK not in self.text[i].lstrip(BLANK)]
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.id = {self.text[i]: i for i in plain}
        self.longest = max(map(len, self.score))
        self.unknown = min(s for s in self.score.values() if s > UNUSABLE) - PENALTY
        self.places = np.array(plain)
        self.scores = np.array([self.score[self.text[i]] for i in plain] + [-np.inf])
        self.find = Lookup(np.array([self.hash_of(self.text[i]) for i in plain], np.uint64), 18)

    @staticmethod
    def hash_of(text):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in text:
                h = h * STEP + np.uint64(ord(c) + 1)
        return mix(np.array([h + np.uint64(len(text))]))[0]

    def spelled(self, text):
        """Ids of a character without a piece of its own: its bytes."""
        return [self.bytes[b] for b in text.encode()]


@lru_cache(maxsize=1)
def load(path):
    return Pieces(path)


def marked(text):
    """Words of a text as the lattice sees them: spaces become blanks, with one before the text."""
    return SPACES.findall(" " + text) if text else []


def inner(word):
    """Characters of the lattice; a blank that the text itself holds is no space."""
    return [BLANK if c == " " else ("\0" + c if c == BLANK else c) for c in word]


def edges(p, chars, end):
    """(start, score, ids) of the pieces that end at ``end``."""
    for start in range(max(0, end - p.longest), end):
        name = "".join(chars[start:end])
        if name in p.score:
            yield start, p.score[name], [p.id[name]]
        elif start == end - 1:
            yield start, p.unknown, p.spelled(chars[start][-1])


def n_best(p, word, n):
    """The n best segmentations of a word, best first: [(score, ids)].

    Forward Viterbi scores are exact for what is left of a backward search, so the A-star
    search pops complete paths in order.
    """
    chars = inner(word)
    best = [0.0] + [-np.inf] * len(chars)
    into = [[]] + [list(edges(p, chars, end)) for end in range(1, len(chars) + 1)]
    for end in range(1, len(chars) + 1):
        best[end] = max(best[s] + w for s, w, _ in into[end])
    queue, count, out = [(-best[-1], 0, len(chars), 0.0, None)], 0, []
    while queue and len(out) < n:
        _, _, at, behind, path = heapq.heappop(queue)
        if at == 0:
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((behind, ids))
            continue
        for start, score, ids in into[at]:
            count += 1
            heapq.heappush(queue, (-(best[start] + score + behind), count, start, score + behind, (ids, path)))
    return out


def segmented(p, words):
    """Best segmentation of many distinct words: (scores, gap to the second best, ids, offsets)."""
    n = len(words)
    score, gap = np.zeros(n), np.full(n, np.inf)
    ids = [None] * n
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        codes = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), length).astype(np.uint64)
        # the text's own blanks have no piece
        codes = np.where(codes == ord(BLANK), np.uint64(1 << 40), np.where(codes == 32, np.uint64(ord(BLANK)), codes))
        ahead = np.full((length + 1, len(rows)), -np.inf)
        ahead[0] = 0
        # start and piece of the best edge into each place
        origin = np.zeros((length + 1, len(rows)), np.int32)
        piece = np.zeros((length + 1, len(rows)), np.int32)
        edge = {}
        for start in range(length):
            h = np.zeros(len(rows), np.uint64)
            for end in range(start + 1, min(length, start + p.longest) + 1):
                h = h * STEP + (codes[:, end - 1] + np.uint64(1))
                at = p.find(mix(h + np.uint64(end - start)))
                w = p.scores[at]
                if end == start + 1:
                    w = np.where(np.isinf(w), p.unknown, w)
                elif np.isinf(w).all():
                    continue
                edge[start, end] = w
                total = ahead[start] + w
                better = np.flatnonzero(total > ahead[end])
                ahead[end][better] = total[better]
                origin[end][better] = start
                piece[end][better] = at[better]
        score[rows] = ahead[length]
        on = np.zeros((length + 1, len(rows)), bool)
        live, place = np.arange(len(rows)), np.full(len(rows), length)
        path = []
        while len(live):
            on[place, live] = True
            before = origin[place, live]
            path.append((live, before, piece[place, live]))
            live, place = live[before > 0], before[before > 0]
        behind = np.full((length + 1, len(rows)), -np.inf)
        behind[length] = 0
        for start in range(length - 1, -1, -1):
            for end in range(start + 1, min(length, start + p.longest) + 1):
                if (start, end) in edge:
                    np.maximum(behind[start], edge[start, end] + behind[end], out=behind[start])
        second = np.full(len(rows), -np.inf)
        for (start, end), w in edge.items():
            through = ahead[start] + w + behind[end]
            through[on[end] & (origin[end] == start)] = -np.inf
            np.maximum(second, through, out=second)
        gap[rows] = ahead[length] - second
        # the paths run from the end of a word to its start
        own, start, at = (np.concatenate(x[::-1]) for x in zip(*path))
        order = np.argsort(own, kind="stable")
        start, at = start[order], at[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(rows)))]).tolist()
        listed = at < len(p.places)
        places = p.places[np.where(listed, at, 0)].tolist()
        for r, a, b in zip(rows.tolist(), bounds, bounds[1:]):
            ids[r] = places[a:b]
        strange = np.flatnonzero(~listed)
        for r in np.unique(np.searchsorted(bounds, strange, side="right") - 1).tolist():
            a, b, word = bounds[r], bounds[r + 1], words[rows[r]]
            found = zip(listed[a:b].tolist(), places[a:b], start[a:b].tolist())
            ids[rows[r]] = [i for known, x, s in found for i in ([x] if known else p.spelled(word[s]))]
    return score, gap, ids


def combined(best, lists, n):
    """The n largest sums of one entry from each list (falling scores), as choices per list."""
    queue, seen, out = [(0.0, (0,) * len(lists))], {(0,) * len(lists)}, []
    while queue and len(out) < n:
        lost, choice = heapq.heappop(queue)
        out.append((best - lost, choice))
        for j, c in enumerate(choice):
            if c + 1 < len(lists[j]):
                after = (*choice[:j], c + 1, *choice[j + 1 :])
                if after not in seen:
                    seen.add(after)
                    heapq.heappush(queue, (lost + lists[j][c][0] - lists[j][c + 1][0], after))
    return out


def decode(p, ids):
    """Text of the ids: blanks are spaces, byte pieces are bytes, the blank before the text goes."""
    return b"".join(map(p.spoken.__getitem__, ids)).decode(errors="replace")[1:]


def _nested(rows):
    """Lists of arrays of ids as one Arrow column."""
    flat = [x for row in rows for x in row]
    inner = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in flat])]), pa.int32())
    outer = pa.array(np.concatenate([[0], np.cumsum([len(row) for row in rows])]), pa.int32())
    ids = pa.array(np.concatenate([*flat, np.zeros(0, "<u4")]).astype(np.int32))
    return pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, ids))


PART = 8 << 20  # characters that are encoded at once
KEPT = 20_000  # words whose n-best lists a task keeps


def _parts(batches):
    """The batches, cut between texts so that a part holds no more than PART characters or one text."""
    for batch in batches:
        sizes = np.array([len(t or "") for t in batch.column(1).to_pylist()], np.int64)
        start = size = 0
        for at, n in enumerate(sizes.tolist()):
            if at > start and size + n > PART:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += n
        yield batch.slice(start)


def _encoded(batches, path, best):
    p = load(path)
    lists = {}
    for batch in _parts(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        number = {}
        places = [np.array([number.setdefault(w, len(number)) for w in marked(t)], np.int64) for t in texts]
        words = list(number)
        score, gap, ids = segmented(p, words)
        sizes = np.array([len(x) for x in ids], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(at[-1]))
        rows = []
        for text, place in zip(texts, places):
            spread = np.repeat(at[place] - np.concatenate([[0], np.cumsum(sizes[place])[:-1]]), sizes[place]) if len(place) else np.zeros(0, np.int64)
            own = flat[spread + np.arange(len(spread))]
            # n - 1 words with the closest second choice are all that can change among the n best
            loose = place[np.argsort(gap[place], kind="stable")[: best - 1]]
            where = np.argsort(gap[place], kind="stable")[: best - 1]
            options = []
            for w in loose.tolist():
                word = words[w]
                if word not in lists:
                    if len(lists) >= KEPT:
                        lists.clear()
                    lists[word] = n_best(p, word, best)
                options.append(lists[word])
            found = combined(float(score[place].sum()), options, best)
            lists_of_ids = []
            starts = np.concatenate([[0], np.cumsum(sizes[place])])
            for _, choice in found:
                changed = sorted((int(where[j]), options[j][c][1]) for j, c in enumerate(choice) if c)
                parts, last = [], 0
                for word, new in changed:
                    parts += [own[last : starts[word]], np.array(new, np.uint32)]
                    last = starts[word + 1]
                lists_of_ids.append(np.concatenate([*parts, own[last:]]).astype("<u4"))
            digests = [zlib.crc32(x.tobytes()) for x in lists_of_ids]
            rows.append((len(own), own, [s for s, _ in found], lists_of_ids, digests))
        n, own, scores, kept, digests = zip(*rows) if rows else ((), (), (), (), ())
        yield pa.record_batch(
            {
                "id": batch.column(0),
                "n_pieces": pa.array(n, pa.int64()),
                "round_trip": pa.array([decode(p, x.tolist()) == t for x, t in zip(own, texts)], pa.bool_()),
                "scores": pa.array(scores, pa.list_(pa.float64())),
                "ids": _nested(kept),
                "ids_crc32": pa.array(digests, pa.list_(pa.int64())),
            }
        )


def encode(docs, id_col="doc_id", text_col="text", path=None, best=BEST):
    """One row per input row: id, n_pieces, round_trip, scores, ids, ids_crc32.

    ``scores``, ``ids`` (lists of piece ids) and ``ids_crc32`` are those of the ``best`` best segmentations of the whole text,
    best first (fewer if there are fewer); ``n_pieces`` counts the best one's pieces and
    ``round_trip`` tells whether decoding it gives the text back.

    No piece goes over a word's start, so a text's lattice is a chain of its words' lattices. The
    best path and the gap to the second best of a task's distinct words come from forward and
    backward Viterbi passes over all words of one length at once. The n best of a text can only
    differ in the n - 1 words with the smallest gaps; their lists come from the backward A-star
    search and are combined. Characters without a piece are spelled in bytes.

    Null and empty texts have no pieces: one segmentation of score 0. A null id is returned as null;
    repeated rows give repeated results. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        partial(_encoded, path=path or model_path(), best=best),
        "id long, n_pieces long, round_trip boolean, scores array<double>, ids array<array<int>>, ids_crc32 array<long>",
    ).withColumnRenamed("id", id_col)


def _decoded(batches, path):
    p = load(path)
    for batch in batches:
        texts = [None if x is None else decode(p, x) for x in batch.column(1).to_pylist()]
        yield pa.record_batch({"id": batch.column(0), "text": pa.array(texts, pa.string())})


def decode_table(encoded, id_col="doc_id", ids_col="ids", path=None):
    """(id, text): one row per input row, the text of a column of piece ids. Null ids give null."""
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(partial(_decoded, path=path or model_path()), "id long, text string").withColumnRenamed("id", id_col)
