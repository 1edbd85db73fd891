"""Problem 6: evaluation passages that leak into a corpus.

Method: latent semantic retrieval. Passages are cut into segments; their TF-IDF matrix, with document
frequencies of the whole corpus, gets a randomised SVD whose products run over the segments in tasks.
Every document is read in overlapping windows of words and each is projected into the latent space.
Segments whose cosine with a window reaches `least_cosine` are candidates; they are found through an
inverted file (spherical k-means of the segments, `probes` of 2 sqrt(n) lists a window), so a window's
cost grows with the root of the number of segments. Of each candidate the bit-parallel longest common
subsequence of the window with its surroundings and 64 words of the passage is taken; where it could hold a stretch,
a local alignment of passage and surroundings gives the stretch itself, whatever words were changed,
left out or put in, and the passage's answers (its names and numbers, the words that tell it from
others of the same mould) are checked.

A sentence that very many distinct texts carry is stock and counts for nothing, if most of these
texts carry no other sentence of the passage. A passage copied widely is found as often as it stands.

The evaluation table is held by every task and is bounded (`most_words`, checked). Documents stay
where they are: no stage shuffles text, and the check needs no join because a task that finds a
candidate holds the document.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmesh.llm.textnorm import WHOLE
from litmesh.session import stage

WORD = re.compile(r"[a-z0-9]+|[^\W_a-z0-9]+")
FOREIGN = re.compile(r"[^\W\x00-\x7f]")  # letters and digits that are not ASCII
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
BROKEN = re.compile(r"(?<=\w)[-­‐]\s*\n\s*(?=\w)")
MARKS = re.compile("[̀-ͯ]")
BLOCK = 16  # words; a window is two blocks, so any 17 words in a row lie within one
SHINGLE = 5
WIDE = 8  # words of a stretch shared by passages that may be a statement of its own
SIDE, NEAR = 64, 48  # words of the passage and of the document in the longest common subsequence
PIECE = 1024  # words of a passage aligned at a time
MATCH, OTHER, OPEN, MORE, DENSITY = 4, -9, -6, -4, 0.7  # scores of an alignment: a word kept, changed, the first and each further one put in or left out; and the least share of words kept on either side
SENTENCE = re.compile(r"(?<=[.!?])\s+")
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words without accents; a word broken at a line's end is one word."""
    if not text:
        return []
    if "\n" in text:
        text = BROKEN.sub("", text)
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text.translate(WHOLE)))
        if FOREIGN.search(text):
            return [w.encode() for w in WORD.findall(text.lower())]
    return text.encode("ascii", "replace").translate(PLAIN).split()


def _shingles(ids: np.ndarray) -> np.ndarray:
    """Hashes of SHINGLE ids in a row, 0 where a word is unknown."""
    n = len(ids) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    u, out, known = ids.astype(np.uint64), np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(SHINGLE):
        out = (out ^ (u[k : k + n] * MIX[k])) * np.uint64(0x2545F4914F6CDD1D)
        out ^= out >> np.uint64(29)
        known &= ids[k : k + n] > 0
    return np.where(known, out, 0)


class Passages:
    """The evaluation side: vocabulary, ids, sentences and their stock marks, segments."""

    def __init__(self, rows: list[tuple[int, str]]):
        parts = {key: [w for w in map(tokens, SENTENCE.split(text)) if w] for key, text in rows}
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ps in parts.values() for ws in ps for w in ws}), 1)}
        self.keys = sorted(parts)
        sentences = self._cut([[np.array([self.vocabulary[w] for w in ws], np.int32) for ws in parts[k]] for k in self.keys])
        known: dict[bytes, int] = {}
        self.sentences = [[known.setdefault(x.tobytes(), len(known)) for x in ss] for ss in sentences]  # numbers of distinct sentences
        self.lengths = [[len(x) for x in ss] for ss in sentences]
        self.ids = [np.concatenate(ss) if ss else np.zeros(0, np.int32) for ss in sentences]
        runs = [np.unique(h[h > 0]) for h in (_shingles(np.frombuffer(x, np.int32)) for x in known)]
        self.shingles = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)
        self.n_runs = np.array([len(r) for r in runs], np.int64)
        pairs = sorted((int(np.searchsorted(self.shingles, h)), u) for u, r in enumerate(runs) for h in r)
        self.run_starts = np.searchsorted([a for a, _ in pairs], np.arange(len(self.shingles) + 1))
        self.run_sentences = np.array([u for _, u in pairs], np.int64)
        self.holders: list[list[int]] = [[] for _ in known]  # of each distinct sentence its passages
        for p, us in enumerate(self.sentences):
            for u in set(us):
                self.holders[u].append(p)
        self.answers = [frozenset(self.vocabulary[w] for w in ws if w in self.vocabulary) for ws in (self._answers(t) for _, t in sorted(rows))]

    @staticmethod
    def _cut(passages: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        """Sentences cut further where a stretch of WIDE words and more begins or ends that another passage holds too."""
        own = [np.unique(np.concatenate([_shingles(x) for x in ss])) for ss in passages if ss]
        values, uses = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        several, out = values[(uses > 1) & (values > 0)], []
        for ss in passages:
            out.append([])
            for x in ss:
                shared = np.zeros(len(x) + 2, np.int8)
                for i in np.flatnonzero(np.isin(_shingles(x), several)):
                    shared[i + 1 : i + 1 + SHINGLE] = 1
                edges = np.flatnonzero(np.diff(shared)).reshape(-1, 2)
                out[-1] += np.split(x, sorted({int(e) for a, b in edges if b - a >= WIDE for e in (a, b)} - {0, len(x)}))
        return out

    @staticmethod
    def _answers(text: str) -> set[bytes]:
        """Numbers, and words with a capital that do not open a sentence."""
        found = re.findall(r"(?<![.!?:]\s)(?<!^)\b[^\W\d_a-z][^\W_]*|\b\d+\b", text or "")
        return {w for x in found for w in tokens(x)}

    def carried(self, places: np.ndarray) -> list[tuple[int, bool]]:
        """(sentence, whether another sentence of a passage of it is there) of a text that holds these runs; a sentence is there with half of its runs."""
        counts: dict[int, int] = {}
        for i in places.tolist():
            for u in self.run_sentences[self.run_starts[i] : self.run_starts[i + 1]].tolist():
                counts[u] = counts.get(u, 0) + 1
        there = {u for u, n in counts.items() if 2 * n >= self.n_runs[u]}
        return [(u, any(v in there for p in self.holders[u] for v in self.sentences[p] if v != u)) for u in there]

    def mark_stock(self, alone: np.ndarray, beside: np.ndarray, n_texts: int, share: float, least: int) -> None:
        """Of each passage the words that are not stock; a passage of stock only keeps all its words."""
        common = (alone + beside >= max(share * n_texts, least)) & (beside < alone)
        self.own = []
        for ids, us, ns in zip(self.ids, self.sentences, self.lengths):
            stock = np.repeat([bool(common[u]) for u in us], ns) if us else np.zeros(0, bool)
            self.own.append(ids if stock.all() else ids[~stock])

    def segments(self) -> list[tuple[int, int, list[int]]]:
        """(passage number, place, ids) of BLOCK words each, half overlapping, without stock."""
        return [(p, i, own[i : i + BLOCK].tolist()) for p, own in enumerate(self.own) if len(own) for i in range(0, max(1, len(own) - BLOCK // 2), BLOCK // 2)]


class Lists:
    """An inverted file of unit vectors: lists by spherical k-means, of which a vector's nearest are searched."""

    def __init__(self, vectors: np.ndarray, probes: int, *, rounds: int = 8, seed: int = 5):
        n = len(vectors)
        k = max(1, min(n, int(2 * np.sqrt(n))))
        self.centres = vectors[np.random.default_rng(seed).choice(n, k, replace=False)].copy()
        for _ in range(rounds):
            of = np.concatenate([(vectors[i : i + 4096] @ self.centres.T).argmax(axis=1) for i in range(0, n, 4096)])
            total = np.zeros_like(self.centres)
            np.add.at(total, of, vectors)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            self.centres = np.where(size > 1e-9, total / np.maximum(size, 1e-9), self.centres)
        of = np.concatenate([(vectors[i : i + 4096] @ self.centres.T).argmax(axis=1) for i in range(0, n, 4096)])
        self.order = np.argsort(of, kind="stable")
        self.starts = np.searchsorted(of[self.order], np.arange(k + 1))
        self.vectors, self.probes = np.ascontiguousarray(vectors[self.order]), min(probes, k)

    def search(self, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, vector) whose product reaches `least`."""
        near = np.argpartition(x @ self.centres.T, -self.probes, axis=1)[:, -self.probes :]
        flat = near.ravel()
        order = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[order], np.arange(len(self.centres) + 1))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for c in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(self.starts) > 0)):
            rows, own = order[cuts[c] : cuts[c + 1]] // self.probes, self.vectors[self.starts[c] : self.starts[c + 1]].T
            step = max(1, 2_000_000 // own.shape[1])
            for i in range(0, len(rows), step):
                r, v = np.nonzero(x[rows[i : i + step]] @ own >= least)
                out.append((rows[i : i + step][r], self.order[self.starts[c] + v]))
        return np.concatenate([r for r, _ in out]), np.concatenate([v for _, v in out])


def _weights(ids: np.ndarray, idf: np.ndarray, size: int) -> np.ndarray:
    row = np.bincount(ids, minlength=size).astype(np.float64) * idf
    norm = np.linalg.norm(row)
    return row / norm if norm else row


def randomised_svd(segments: DataFrame, idf: np.ndarray, rank: int, *, rounds: int = 3, seed: int = 11) -> np.ndarray:
    """Right singular vectors (terms x rank) of the segments' TF-IDF rows.

    Each round multiplies A'A with a thin matrix: a task gives the sum over its segments, one matrix
    of terms x rank, and the driver adds the few of them and orthonormalises. The number of tasks is
    bounded, and so is the vocabulary, which is the evaluation side's.
    """
    size = len(idf)
    rank = min(rank, size)
    q = np.random.default_rng(seed).standard_normal((size, min(size, rank + 16)))
    context = segments.sparkSession.sparkContext
    parts = segments.coalesce(8)
    for _ in range(rounds):
        q, _ = np.linalg.qr(q)
        shared = context.broadcast((q.astype(np.float32), idf))

        def product(batches, shared=shared):
            q, idf = shared.value
            total = np.zeros_like(q, np.float64)
            for batch in batches:
                for ids in batch.column(0).to_pylist():
                    row = _weights(np.array(ids, np.int64), idf, len(idf))
                    at = np.flatnonzero(row)
                    total[at] += np.outer(row[at], row[at] @ q[at])
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["m"])

        q = sum((np.frombuffer(r[0], np.float32).reshape(q.shape).astype(np.float64) for r in parts.mapInArrow(product, "m binary").collect()), np.zeros(q.shape))
        shared.unpersist()
    u, _, _ = np.linalg.svd(q, full_matrices=False)
    return u[:, :rank]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of a and b, SIDE words in b; 0 in a and -1 in b are no words.

    Bit-parallel (Hyyrö 2004): a row's bits stand for the words of b, and each word of a is one step."""
    hits = np.packbits(a[:, :, None] == b[:, None, :], axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    v = np.full(len(a), ~np.uint64(0))
    for i in range(a.shape[1]):
        u = v & hits[:, i]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def aligned(docs: list[np.ndarray], passages: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """Of each pair the best local alignment: (words in common, first and last place in the document's words, the same in the passage's).

    A word in common scores MATCH; changed words, and words put in or left out with affine gaps, cost, so
    that sentences of one mould, which share many words in order, fall apart and an edited copy does
    not. All pairs are aligned together, row by row; a cell packs score, common words and start."""
    if not docs:
        return []
    n, width, height = len(docs), max(map(len, passages)), max(map(len, docs))
    d, p = np.zeros((n, height), np.int32), np.full((n, width), -1, np.int32)
    for k, (x, y) in enumerate(zip(docs, passages)):
        d[k, : len(x)], p[k, : len(y)] = x, y
    one, at = np.int64(1) << 40, np.arange(width, dtype=np.int64)
    start = at[None, :] + 1  # where a stretch begins that begins in this column
    h, gap = np.zeros((n, width + 1), np.int64), np.full((n, width), -one * 1000)
    best, where = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
    for i in range(height):
        equal = d[:, i : i + 1] == p
        before = h[:, :-1]
        fresh = (np.int64(i) << 13) | (start - 1)
        diagonal = np.where(equal, np.where(before > 0, before, fresh) + MATCH * one + (1 << 26), before + OTHER * one)
        gap = np.maximum(h[:, 1:] + OPEN * one, gap + MORE * one)
        row = np.maximum(diagonal, gap)
        side = np.maximum.accumulate(row - MORE * one * at, axis=1)
        row[:, 1:] = np.maximum(row[:, 1:], side[:, :-1] + (OPEN - MORE) * one + MORE * one * at[1:])
        h[:, 1:] = np.where(row >= one, row, 0)
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = value > best
        best = np.where(better, value, best)
        where[better] = np.column_stack([np.full(n, i), top])[better]
    low = lambda k, bits: (best >> k) & ((1 << bits) - 1)
    return list(zip(low(26, 14).tolist(), low(13, 13).tolist(), where[:, 0].tolist(), low(0, 13).tolist(), where[:, 1].tolist()))


def _windows(ids: np.ndarray, offsets: np.ndarray, embed: np.ndarray, norm2: np.ndarray):
    """Batches of (document, start, projection, length) of overlapping windows of two blocks.

    Words outside the vocabulary have no place in the latent space: they are left out of the sums and
    count for a window's length only.
    """
    lengths = np.diff(offsets)
    n_blocks = (lengths + BLOCK - 1) // BLOCK
    doc_of = np.repeat(np.arange(len(lengths)), n_blocks)
    first = np.cumsum(n_blocks) - n_blocks
    starts = offsets[:-1][doc_of] + (np.arange(len(doc_of)) - first[doc_of]) * BLOCK
    ends = np.minimum(starts + BLOCK, offsets[1:][doc_of])
    for at in range(0, len(starts), 4096):
        stop = min(at + 4097, len(starts))  # one block more, for the last window
        piece, cuts = ids[starts[at] : ends[stop - 1]], starts[at:stop] - starts[at]
        energy = np.add.reduceat(norm2[piece], cuts)
        known = np.flatnonzero(piece)
        vectors = np.zeros((stop - at, embed.shape[1]), np.float32)
        if len(known):
            places = np.searchsorted(known, np.r_[cuts, len(piece)])
            full = np.flatnonzero(places[1:] > places[:-1])
            vectors[full] = np.add.reduceat(embed[piece[known]], places[full], axis=0)
        same = np.flatnonzero(doc_of[at : stop - 1] == doc_of[at + 1 : stop])
        x, e = vectors.copy(), energy.copy()
        x[same] += vectors[same + 1]
        e[same] += energy[same + 1]
        rows = np.arange(min(4096, stop - at))
        yield doc_of[at + rows], starts[at + rows], x[rows], np.sqrt(np.maximum(e[rows], 1e-9))


def _around(flat: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int, fill: int) -> np.ndarray:
    """`size` values of `flat` from each start; `fill` outside of lo <= place < hi."""
    at = starts[:, None] + np.arange(size)
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(inside, flat[np.clip(at, 0, len(flat) - 1)], fill)


def _regions(places: list[int], span: int, most: int = 4096) -> list[tuple[int, int]]:
    """Stretches of a document around windows that lie within `span` of each other, and `span` on both sides."""
    out: list[tuple[int, int]] = []
    for s in places:
        if out and s - span <= out[-1][1] and s - out[-1][0] < most:
            out[-1] = (out[-1][0], s + 2 * BLOCK + span)
        else:
            out.append((s - span, s + 2 * BLOCK + span))
    return out


def _searcher(shared, least_cosine: float, least_words: int):
    def search(batches):
        passages, embed, norm2, lists, of, place = shared.value
        flat = np.concatenate(passages.own)
        sizes = np.array([len(x) for x in passages.own])
        first = np.cumsum(sizes) - sizes  # an empty passage starts where the next does and has no segments
        for batch in batches:
            out: list[tuple] = []
            column = batch.column(1)
            offsets = column.offsets.to_numpy().astype(np.int64)
            ids = column.values.to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).to_pylist()
            found: dict[tuple[int, int], set[int]] = {}
            for docs, starts, x, length in _windows(ids, offsets, embed, norm2) if len(ids) else ():
                # |projection| / |window| bounds every cosine, so windows below the least are out.
                near = np.flatnonzero(np.linalg.norm(x, axis=1) >= least_cosine * length)
                if not len(near):
                    continue
                rows, segments = lists.search(x[near] / length[near, None], least_cosine)
                # Neighbouring segments that meet one window are looked at together.
                met = np.unique(rows * len(flat) + first[of[segments]] + place[segments] // BLOCK * BLOCK)
                for i in range(0, len(met), 2048):
                    w, at = near[met[i : i + 2048] // len(flat)], met[i : i + 2048] % len(flat)
                    p = np.searchsorted(first, at, "right") - 1
                    a = _around(ids, starts[w] - (NEAR - 2 * BLOCK) // 2, offsets[docs[w]], offsets[docs[w] + 1], NEAR, 0)
                    b = _around(flat, at - (SIDE - BLOCK) // 2, first[p], first[p] + sizes[p], SIDE, -1)
                    for k in np.flatnonzero(common_subsequence(a, b) >= least_words).tolist():
                        found.setdefault((int(docs[w[k]]), int(p[k])), set()).add(int(starts[w[k]]))
            tasks = [(d, p, max(int(offsets[d]), a), min(int(offsets[d + 1]), b), j) for (d, p), places in found.items() for a, b in _regions(sorted(places), min(int(sizes[p]), SIDE)) for j in range(0, max(1, int(sizes[p]) - PIECE // 2), PIECE // 2)]
            tasks.sort(key=lambda t: t[3] - t[2])
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for i in range(0, len(tasks), 64):
                part = tasks[i : i + 64]
                sides = [passages.own[p][j : j + PIECE] for _, p, _, _, j in part]
                for (d, p, a, b, _), side, (words, x, y, u, v) in zip(part, sides, aligned([ids[a:b] for _, _, a, b, _ in part], sides)):
                    if words < max(least_words, DENSITY * (y - x + 1), DENSITY * (v - u + 1)) or words <= best.get((d, p), (0, 0))[0]:
                        continue
                    stretch = ids[a + x : a + y + 1]
                    run = SequenceMatcher(None, stretch.tolist(), side[u : v + 1].tolist(), autojunk=False).find_longest_match().size
                    answers = passages.answers[p] & set(passages.own[p].tolist())
                    if not answers or run >= least_words or answers & set(stretch.tolist()):
                        best[d, p] = (words, run)
            out = [(doc_ids[d], passages.keys[p], words, run, words / max(1, int(sizes[p]))) for (d, p), (words, run) in best.items()]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "eval_id", "words", "longest_run", "share"])

    return search


def leaks(documents: DataFrame, eval_items: DataFrame, *, rank: int = 64, least_cosine: float = 0.35, least_words: int = 15, probes: int = 16, stock_share: float = 0.015, stock_least: int = 5, most_words: int = 2_000_000) -> DataFrame:
    """(doc_id, eval_id, words, longest_run, share): documents that carry a passage or a stretch of it.

    words counts the passage's words in the best stretch, in order, stock ones left out; share relates
    them to the passage. Rows with a null id, text or passage leak nothing, neither do empty texts.
    A doc_id or eval_id that stands in several rows is judged by each row and reported once, with
    the most words. Whole texts are read, in windows, whatever their length.
    """
    spark = documents.sparkSession
    rows = eval_items.where("eval_id is not null and passage is not null").select("eval_id", "passage")
    n_words = rows.select(F.coalesce(F.sum(F.size(F.split("passage", r"\s+"))), F.lit(0))).first()[0]
    if n_words > most_words:
        raise ValueError(f"the evaluation side has {n_words} words, more than {most_words}: search it in parts, or raise most_words with the executors' memory in mind")
    passages = Passages([tuple(r) for r in rows.collect()])
    size = len(passages.vocabulary) + 1
    shared_words = spark.sparkContext.broadcast(passages.vocabulary)

    def encode(batches):
        get = shared_words.value.get
        for batch in batches:
            words = [tokens(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(words) + 1, np.int32)
            np.cumsum([len(x) for x in words], out=offsets[1:])
            ids = np.fromiter(map(get, chain.from_iterable(words), repeat(0)), np.int32, int(offsets[-1]))
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            hashed = np.array([xxhash.xxh64_intdigest(b" ".join(x)) for x in words], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(hashed)], ["doc_id", "ids", "hash"])

    coded = stage(documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>, hash long"))
    shared_passages = spark.sparkContext.broadcast(passages)

    def frequencies(batches):
        sentences = shared_passages.value
        words, n, known = np.zeros(size, np.int64), 0, sentences.shingles
        texts = lambda kind, keys, hashes: pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(hashes), pa.array(np.ones(len(keys), np.int64))], ["kind", "k", "hash", "n"])
        for batch in batches:
            column = batch.column(1)
            offsets, ids = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
            n += len(offsets) - 1
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            hashes = batch.column(2).to_numpy()
            yield texts(3, np.zeros(len(hashes), np.int64), hashes)
            own = ids[offsets[0] : offsets[-1]]
            there = np.flatnonzero(own)  # words of the evaluation side
            words += np.bincount(np.unique(doc[there] * size + own[there]) % size, minlength=size)
            if len(own) >= SHINGLE and len(known):
                h = _shingles(own)
                at = np.flatnonzero((h > 0) & (doc[: len(h)] == doc[SHINGLE - 1 :]))
                place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
                hit = known[place] == h[at]
                carried = np.unique(doc[at[hit]] * len(known) + place[hit])
                of = carried // len(known)
                cuts = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)] if len(of) else np.zeros(1, np.int64)
                rows = [(2 * u + beside, hashes[of[i]]) for i, j in zip(cuts, cuts[1:]) for u, beside in sentences.carried(carried[i:j] % len(known))]
                if rows:
                    yield texts(2, np.array([k for k, _ in rows], np.int64), np.array([x for _, x in rows], np.int64))
        kinds, keys, counts = [0], [0], [n]
        at = np.flatnonzero(words)
        kinds += [1] * len(at)
        keys += at.tolist()
        counts += words[at].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(np.zeros(len(keys), np.int64)), pa.array(counts, pa.int64())], ["kind", "k", "hash", "n"])

    # Kinds: 0 documents, 1 a word's documents; 2 a sentence's distinct texts without and with another of its passage, 3 distinct texts, one row each for a text's hash.
    n_docs, n_texts, df, carried = 0, 0, np.zeros(size), np.zeros(2 * len(passages.holders))
    counted = coded.mapInArrow(frequencies, "kind int, k long, hash long, n long").groupBy("kind", "k", "hash").agg(F.sum("n").alias("n"))
    for kind, k, n in counted.groupBy("kind", "k").agg(F.sum(F.when(F.col("kind") < 2, F.col("n")).otherwise(1)).alias("n")).collect():  # bounded by the evaluation side's words
        if kind == 0:
            n_docs = n
        elif kind == 3:
            n_texts = n
        else:
            (df if kind == 1 else carried)[k] = n
    passages.mark_stock(carried[::2], carried[1::2], n_texts, stock_share, stock_least)
    idf = np.log((n_docs + 1) / (df + 0.5))
    idf[0] = np.median(idf[1:]) if size > 1 else 0.0
    idf = np.maximum(idf, 0.05)
    segments = passages.segments()
    empty = spark.createDataFrame([], "doc_id long, eval_id long, words int, longest_run int, share double")
    if not segments or not n_docs:
        return empty
    terms = np.r_[0.0, idf[1:]]  # unknown words weigh on a window's length only
    space = randomised_svd(spark.createDataFrame([(s,) for _, _, s in segments], "ids array<int>"), terms, rank)
    queries = np.stack([_weights(np.array(s), terms, size) @ space for _, _, s in segments])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    embed = (terms[:, None] * space).astype(np.float32)
    shared = spark.sparkContext.broadcast((passages, embed, (idf**2).astype(np.float32), Lists(queries.astype(np.float32), probes), np.array([p for p, _, _ in segments]), np.array([i for _, i, _ in segments])))
    found = coded.mapInArrow(_searcher(shared, least_cosine, least_words), "doc_id long, eval_id long, words int, longest_run int, share double")
    best = found.groupBy("doc_id", "eval_id").agg(F.max(F.struct("words", "longest_run", "share")).alias("m"))
    return best.select("doc_id", "eval_id", "m.*")
