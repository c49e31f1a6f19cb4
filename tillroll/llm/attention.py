"""Language-model scoring with causal self-attention models in numpy.

A text's words are cut into subword ids by the first merges of a public
vocabulary.  The outer model predicts a word's first id by attention over the
words before it (a word stands as the mean of its ids' vectors).  What follows in
the word is a mixture: the word's count among the training words with that first
id, and the inner model, which predicts the other ids and the word's end by
attention over the ids before them in the word; the inner model's share is that
of words seen once.  The product is a distribution over texts.
Positions are scored in blocks that see the block before them: overlapping
windows in which each position is scored once, many windows in one masked
attention.  An id's probability is that of its class times that of the id within
the class.  Rare words are scored by the inner model where equal ones meet, once.

Learning is spread over tasks.  In each round tasks start from common weights, take
steps on their own rows and give back weights, which are averaged.  The outer model
learns every window of all training documents, each document in one of the rounds, or
more often in tasks with few windows.  What the inner model says depends on the word
alone, so it learns the distinct training words, each by its count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.bpe import Merges, Vocabulary, default_vocabulary
from tillroll.llm.common import bounded, fold_of, most_frequent, released, table
from tillroll.session import write_table

FOLDS, HELD_OUT = 7, 2
#: Merges of the vocabulary that make subwords; with bytes and the end these are 64 classes of 64.
MERGES, CLASSES = 3839, 64
VOCAB = 256 + MERGES + 1
END = VOCAB - 1
WIDTH = 32
#: Positions of a block of the outer and the inner model; a position sees its block and the one before.
OUTER, INNER = 16, 4
#: Ids of a position where positions are a grid of ids; words of a text have all theirs (``Bags``).
WORD_IDS = 6
#: One training document in so many has its windows learned: all of them.
LEARN_EVERY = 1
#: Least windows of a task, rounds, least steps of a task in a round, windows of a step up to these and after them, rate.
TASK_WINDOWS, ROUNDS, STEPS, STEP_WINDOWS, LATE_WINDOWS, RATE = 16_384, 4, 48, 128, 1024, 0.02
#: Windows that stand one after the other in a step: most have the block before them there.
RUN = 4
#: A word seen so often is learned in each round by a share of its count, others in one round.
OFTEN = 16
#: Frequent words that every task knows; the counts of others are joined.
KNOWN_WORDS = 1 << 17
#: Words whose ids or counts a task keeps, and words that one batch of distinct words holds.
CACHE, BATCH_WORDS = 150_000, 1 << 16
TINY = np.float32(-1e9)
#: Rows of a slice of matrix work: what it makes stays in a core's cache.
ROWS = 1024
#: Rows of a sum that are added in step with other sums.
LONG_RUN = 64
#: Bytes of the pieces in which weights are averaged.
PIECE = 1 << 16


class Subwords:
    """Words -> ids: bytes are 0..255, merges follow, the last id ends a text."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.merges = Merges(np.array(merges, np.int32).reshape(-1, 3))
        self.known: dict[bytes, tuple[int, ...]] = {}

    def ids(self, items: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word with a blank before it; the empty word is the end of a text."""
        known = self.known
        new = [w for w in dict.fromkeys(items) if w not in known]
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list(dict.fromkeys(items))
        known.update(zip(new, self.merges.merge([list(b" " + w) if w else [] for w in new])))
        known[b""] = (END,)
        return [known[w] for w in items]


    def bags(self, items: list[bytes]) -> Bags:
        """The ids of words, not kept; no word is empty."""
        raw = np.frombuffer(b" ".join([b"", *items]), np.uint8).astype(np.int32)
        size = np.fromiter(map(len, items), np.int64, len(items)) + 1
        return Bags(*self.merges.merge_flat(raw, size)) if items else Bags.of([])


def first_merges(vocabulary: Vocabulary) -> list[tuple[int, int, int]]:
    """The first merges, renumbered: a byte is itself, merge i is 256 + i."""
    number = {int(i): b for b, i in enumerate(vocabulary.byte_ids)}
    out = []
    for i, (a, b, new) in enumerate(vocabulary.merges[:MERGES].tolist()):
        out.append((number[a], number[b], number.setdefault(new, 256 + i)))
    return out


def blocks_of(line: np.ndarray, block: int) -> np.ndarray:
    """(blocks, 2 * block + 1, ...) of a line of positions: a block, the one before, and the next position; -1 for none."""
    n = len(line) - 1                                        # the first position is only seen
    count = -(-n // block)
    wide = np.full(((count + 1) * block + 1, *line.shape[1:]), -1, np.int32)
    wide[block:block + len(line)] = line
    return wide[np.arange(count)[:, None] * block + np.arange(2 * block + 1)]


def padded(words_ids: list[tuple[int, ...]], width: int) -> np.ndarray:
    """(words, width): the first ids of each word, -1 where there are none."""
    out = np.full((len(words_ids), width), -1, np.int32)
    size = np.minimum(np.fromiter(map(len, words_ids), np.int64, len(words_ids)), width)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = np.fromiter(
        chain.from_iterable(w[:width] for w in words_ids), np.int32, int(size.sum()))
    return out


def inner_windows(words_ids: list[tuple[int, ...]] | Bags) -> tuple[np.ndarray, np.ndarray]:
    """(windows over ids and the end after them, number of the word) for each word."""
    bags = words_ids if isinstance(words_ids, Bags) else Bags.of(words_ids)
    count = -(-bags.size // INNER)
    owner = np.repeat(np.arange(len(bags)), count)
    block = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (block * INNER)[:, None] + np.arange(-INNER, INNER + 1)
    size = bags.size[owner][:, None]
    ids = bags.flat[np.clip(bags.start[owner][:, None] + at, 0, max(0, len(bags.flat) - 1))] if len(owner) else at
    return np.where((at >= 0) & (at < size), ids, np.where(at == size, END, -1)).astype(np.int32), owner


class Bags:
    """All ids of words, one word after the other; each has at least one."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size
        self.start = np.cumsum(size) - size

    @staticmethod
    def of(words_ids: list[tuple[int, ...]]) -> Bags:
        size = np.fromiter(map(len, words_ids), np.int64, len(words_ids))
        return Bags(np.fromiter(chain.from_iterable(words_ids), np.int32, int(size.sum())), size)

    def __len__(self) -> int:
        return len(self.size)

    def __add__(self, other: Bags) -> Bags:
        return Bags(np.concatenate([self.flat, other.flat]), np.concatenate([self.size, other.size]))

    def first(self) -> np.ndarray:
        return self.flat[self.start].astype(np.int64)

    def take(self, at: np.ndarray) -> Bags:
        size = self.size[at]
        return Bags(self.flat[np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())], size)

    def mean(self, vectors: np.ndarray) -> np.ndarray:
        """Mean vector of each word's ids."""
        if not len(self):
            return np.zeros((0, vectors.shape[1]), vectors.dtype)
        return run_sums(vectors, self.flat, self.start, self.size) / self.size[:, None].astype(vectors.dtype)

    def spread(self, rows: np.ndarray, n: int) -> np.ndarray:
        """What gradients of the means are for the n vectors."""
        order, start, size, place = places(self.flat, n)
        out = np.zeros((n, rows.shape[1]), rows.dtype)
        if len(place):
            owner = np.repeat(np.arange(len(self)), self.size)[order]
            out[place] = run_sums(rows / self.size[:, None].astype(rows.dtype), owner, start, size)
        return out


def run_sums(rows: np.ndarray, order: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``order``, numbers of rows: the second of each run is added to the first, and so on,
    the longest runs in front; long runs are summed one by one."""
    kind = np.minimum(size, LONG_RUN + 1).astype(np.int16)
    big = np.argsort(-kind, kind="stable")
    first, longer = start[big], len(kind) - np.cumsum(np.bincount(kind, minlength=LONG_RUN + 2))    # runs longer than 0, 1, ..
    long_ = int(longer[LONG_RUN])
    sums = rows.take(order[first], axis=0)
    for i in range(1, LONG_RUN):
        n = int(longer[i])
        if n == long_:
            break
        sums[long_:n] += rows.take(order[first[long_:n] + i], axis=0)
    for i in range(long_):
        s = first[i]
        sums[i] = np.ones(size[big[i]], rows.dtype) @ rows.take(order[s:s + size[big[i]]], axis=0)
    out = np.empty_like(sums)
    out[big] = sums
    return out


def places(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, sizes, places) of the rows that go to the same of n places."""
    at = at.astype(np.min_scalar_type(n))                    # small numbers are sorted by their bytes
    order = np.argsort(at, kind="stable")
    sorted_ = at[order]
    start = np.flatnonzero(np.concatenate([[len(at) > 0], sorted_[1:] != sorted_[:-1]]))
    return order, start, np.diff(start, append=len(at)), sorted_[start]


def sum_rows(at: np.ndarray, rows: np.ndarray, n: int, sorted_: tuple | None = None) -> np.ndarray:
    """(n, width): sums of the rows that go to the same place."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(at):
        order, start, size, place = sorted_ or places(at, n)
        out[place] = run_sums(rows, order, start, size)
    return out


class Attention:
    """One layer of causal self-attention over 2 * block positions with learned offsets, and a class-factored output.

    A position is the mean of the vectors of one or more ids.
    """

    def __init__(self, block: int, counts: np.ndarray, seed: int = 11):
        r = np.random.default_rng(seed)
        self.block = block
        order = np.argsort(-counts, kind="stable")
        self.slot = np.empty(VOCAB, np.int64)                 # id -> class * members + place
        self.slot[order] = np.arange(VOCAB)
        members = VOCAB // CLASSES
        share = (counts[order] + 0.01) / (counts + 0.01).sum()
        draw = lambda *s: r.normal(0, 0.5 / np.sqrt(s[-1]), s).astype(np.float32)         # noqa: E731
        self.p = {"E": 2 * draw(VOCAB, WIDTH), "Wq": draw(WIDTH, WIDTH), "Wk": draw(WIDTH, WIDTH), "Wv": draw(WIDTH, WIDTH),
                  "Wr": draw(WIDTH, WIDTH), "Wo": draw(WIDTH, WIDTH), "b": np.zeros(WIDTH, np.float32),
                  "rel": np.zeros(2 * block, np.float32), "Wc": np.zeros((WIDTH, CLASSES), np.float32),
                  "bc": np.log(share.reshape(CLASSES, members).sum(1)).astype(np.float32),
                  "M": np.zeros((CLASSES, members, WIDTH), np.float32),
                  "bm": np.log(share).astype(np.float32).reshape(CLASSES, members)}
        at = np.arange(block, 2 * block)[:, None] - np.arange(2 * block)
        self.offset = np.maximum(at, 0)
        self.causal = np.where(at >= 0, np.float32(0), TINY)
        self.chunk = max(1, ROWS // block)

    def dump(self) -> bytes:
        return b"".join(self.p[k].astype(np.float32).tobytes() for k in sorted(self.p))

    def load(self, raw: bytes) -> Attention:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size * 4
            self.p[k] = np.frombuffer(raw[at:at + n], np.float32).reshape(self.p[k].shape).copy()
            at += n
        return self

    def embed(self, x: np.ndarray) -> np.ndarray:
        """Mean vector of each row of ids; -1 is no id."""
        real = (x >= 0).astype(np.float32)
        weight = real / np.maximum(real.sum(-1, keepdims=True), 1)
        return np.einsum("...p,...pd->...d", weight, self.p["E"][np.maximum(x, 0)], optimize=False)

    def tables(self, e: np.ndarray) -> tuple:
        """Query, key, value and residual of each vector."""
        p = self.p
        return e @ (p["Wq"] / np.float32(np.sqrt(WIDTH))), e @ p["Wk"], e @ p["Wv"], e @ p["Wr"] + p["b"]

    def attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, r: np.ndarray, none: np.ndarray) -> tuple:
        """(attention, mixed values, hidden state) of the last block; ``none`` marks positions that are not there."""
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += self.causal + self.p["rel"][self.offset]
        some = np.flatnonzero(none.any(1))
        if len(some):
            a[some] = np.where(none[some][:, None], TINY, a[some])
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= (a.reshape(-1, a.shape[2]) @ np.ones(a.shape[2], a.dtype)).reshape(*a.shape[:2], 1)
        o = np.matmul(a, v)
        h = r + (o.reshape(-1, WIDTH) @ self.p["Wo"]).reshape(r.shape)
        return a, o, np.maximum(h, 0, out=h)

    def _output(self, h: np.ndarray, target: np.ndarray, back: bool, times: np.ndarray | None = None) -> tuple:
        """Log probability of each target; with ``back`` also the gradients of the mean loss, each target counted so many times.

        Rows are taken in slices that stay in a core's cache.
        """
        p, members = self.p, VOCAB // CLASSES
        slot = self.slot[target]
        cls, member = slot // members, slot % members
        g = {k: np.zeros_like(p[k]) for k in ("Wc", "bc", "M", "bm")} if back else {}
        scale = (np.full(len(target), 1 / max(1, len(target))) if times is None else times / max(1, times.sum())).astype(np.float32)
        found, dh = np.zeros(len(target), h.dtype), np.empty_like(h) if back else None

        def one(h: np.ndarray, w: np.ndarray, b: np.ndarray, hit: np.ndarray, scale: np.ndarray, found: np.ndarray,
                dw: np.ndarray | None, db: np.ndarray | None, dh: np.ndarray | None) -> None:
            """Adds the log probability of each row's hit among the columns of ``w``; sets ``dh``, adds to ``dw`` and ``db``."""
            every, ones = np.arange(min(len(h), ROWS)), np.ones(len(b), h.dtype)
            for s in range(0, len(h), ROWS):
                e = min(len(h), s + ROWS)
                at = every[:e - s]
                z = h[s:e] @ w
                z += b
                if not -60 < z.min() <= z.max() < 60:        # else no exponential is too large or too small
                    z -= z.max(1, keepdims=True)
                picked = z[at, hit[s:e]]
                np.exp(z, out=z)
                total = z @ ones
                found[s:e] += picked - np.log(total)
                if back:
                    z *= (scale[s:e] / total)[:, None]
                    z[at, hit[s:e]] -= scale[s:e]
                    dw += h[s:e].T @ z
                    db += np.ones(e - s, z.dtype) @ z
                    np.matmul(z, w.T, out=dh[s:e])

        one(h, p["Wc"], p["bc"], cls, scale, found, g.get("Wc"), g.get("bc"), dh)
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        ends = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        h, member, scale = h.take(order, axis=0), member[order], scale[order]
        more, dm = np.zeros_like(found), np.empty_like(h) if back else None
        for c in np.flatnonzero(np.diff(ends)):
            at = slice(ends[c], ends[c + 1])
            one(h[at], p["M"][c].T, p["bm"][c], member[at], scale[at], more[at], g["M"][c].T if back else None,
                g["bm"][c] if back else None, dm[at] if back else None)
        found[order] += more
        if back:
            dh[order] += dm
        return found.astype(np.float64), g, dh

    def log_probs(self, tables: tuple, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """(windows, block) natural log probabilities; ``x`` are rows of the tables, -1 for none; 0 where no target is."""
        q, k, v, r = tables
        hidden = np.empty((len(x), self.block, WIDTH), r.dtype)
        for s in range(0, len(x), self.chunk):
            w = x[s:s + self.chunk]
            at = np.maximum(w, 0)
            late = at[:, self.block:]
            hidden[s:s + self.chunk] = self.attend(q.take(late, axis=0), k.take(at, axis=0), v.take(at, axis=0), r.take(late, axis=0), w < 0)[-1]
        hidden, target = hidden.reshape(-1, WIDTH), target.ravel()
        out, real = np.zeros(target.size), np.flatnonzero(target >= 0)
        if len(real):
            out[real] = self._output(hidden if len(real) == len(hidden) else hidden.take(real, axis=0), target[real], False)[0]
        return out.reshape(-1, self.block)

    def gradient(self, x: np.ndarray, target: np.ndarray, times: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradients of the mean loss of windows of ids (windows, 2 * block, ids of a position), each counted so many times."""
        if x.shape[2] == 1:                                  # a position's vector is that of its id
            g, g["E"] = self._back(self.p["E"], x[:, :, 0], target, times)
            return g
        at = np.where(x[:, :, 0] >= 0, np.arange(x[:, :, 0].size).reshape(x.shape[:2]), -1)
        g, de = self._back(self.embed(x).reshape(-1, WIDTH), at, target, times)
        there = x >= 0
        share = de.reshape(*x.shape[:2], WIDTH) / np.maximum(there.sum(-1, keepdims=True), 1)
        g["E"] = sum_rows(x[there], np.broadcast_to(share[:, :, None], (*x.shape, WIDTH))[there], VOCAB)
        return g

    def word_gradient(self, bags: Bags, x: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean loss of windows of words (windows, 2 * block); ``x`` are numbers of bags, -1 for none."""
        g, de = self._back(bags.mean(self.p["E"]), x, target)
        g["E"] = bags.spread(de, VOCAB)
        return g

    def _back(self, vectors: np.ndarray, x: np.ndarray, target: np.ndarray, times: np.ndarray | None = None) -> tuple:
        """Gradients of the mean loss for the weights but E, and for each vector; ``x`` are numbers of vectors, -1 for none.

        What a vector's query, key, value and residual are is found once for all its positions,
        and their gradients are summed before they go back to the vector.
        """
        p, b, n = self.p, self.block, len(vectors)
        flat = lambda m: m.reshape(-1, m.shape[-1])                      # noqa: E731
        kind, zero = vectors.dtype, np.zeros((1, WIDTH), vectors.dtype)
        q, k, v, r = (np.concatenate([t, zero]) for t in self.tables(vectors))
        at = np.where(x < 0, n, x)
        parts = [(s, min(len(x), s + self.chunk)) for s in range(0, len(x), self.chunk)]
        a, o, h = np.empty((len(x), b, 2 * b), kind), np.empty((len(x), b, WIDTH), kind), np.empty((len(x), b, WIDTH), kind)
        for s, e in parts:
            late = at[s:e, b:]
            a[s:e], o[s:e], h[s:e] = self.attend(q.take(late, axis=0), k.take(at[s:e], axis=0), v.take(at[s:e], axis=0),
                                                 r.take(late, axis=0), x[s:e] < 0)
        target, hidden = target.ravel(), flat(h)
        real = np.flatnonzero(target >= 0)
        times = None if times is None else np.repeat(times, b)[real]
        if len(real) == len(hidden):
            _, g, du = self._output(hidden, target, True, times)
        else:
            _, g, dh = self._output(hidden.take(real, axis=0), target[real], True, times)
            du = np.zeros_like(hidden)
            du[real] = dh
        du *= hidden > 0
        g["Wo"], g["b"] = flat(o).T @ du, np.ones(len(du), du.dtype) @ du
        du = du.reshape(h.shape)
        # gradients of query, key, value and residual of the last block's positions; those of the block before
        # go to the window that has it as its last, if that stands in front of this one
        back = np.empty((len(x), b, 4 * WIDTH), kind)
        follows = np.zeros(len(x), bool)
        follows[1:] = (x[1:, :b] == x[:-1, b:]).all(1)
        alone = np.flatnonzero(~follows & (x[:, :b] >= 0).any(1))
        before = np.empty((len(alone), b, 2 * WIDTH), kind)
        rel = np.zeros((b, 2 * b))
        for s, e in parts:
            do = (flat(du[s:e]) @ p["Wo"].T).reshape(du[s:e].shape)
            ds = np.matmul(do, v.take(at[s:e], axis=0).transpose(0, 2, 1))
            ds -= np.einsum("wpd,wpd->wp", o[s:e], do)[:, :, None]
            ds *= a[s:e]
            rel += ds.sum(0)
            own = back[s:e]
            own[:, :, :WIDTH] = np.matmul(ds, k.take(at[s:e], axis=0))
            own[:, :, 3 * WIDTH:] = du[s:e]
            lone, next_ = slice(*np.searchsorted(alone, (s, e))), np.flatnonzero(follows[s:e])
            for i, d in ((1, np.matmul(ds.transpose(0, 2, 1), q.take(at[s:e, b:], axis=0))),
                         (2, np.matmul(a[s:e].transpose(0, 2, 1), do))):
                own[:, :, i * WIDTH:(i + 1) * WIDTH] = d[:, b:]
                back[s + next_ - 1, :, i * WIDTH:(i + 1) * WIDTH] += d[next_, :b]
                before[lone, :, (i - 1) * WIDTH:i * WIDTH] = d[alone[lone] - s, :b]
        g["rel"] = np.bincount(self.offset.ravel(), weights=(rel * (self.causal == 0)).ravel(), minlength=2 * b).astype(np.float32)
        total = sum_rows(at[:, b:].ravel(), flat(back), n + 1)[:n]
        if len(alone):
            total[:, WIDTH:3 * WIDTH] += sum_rows(at[alone, :b].ravel(), flat(before), n + 1)[:n]
        total[:, :WIDTH] /= kind.type(np.sqrt(WIDTH))
        names = ("Wq", "Wk", "Wv", "Wr")
        g |= zip(names, np.split(vectors.T @ total, 4, axis=1))
        return g, total @ np.concatenate([p[k] for k in names], 1).T


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.step = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.two = np.empty((2, 1 << 14), np.float32)

    def take(self, gradient: dict[str, np.ndarray]) -> None:
        self.step += 1
        rate, late = np.float32(self.rate / (1 - 0.9 ** self.step)), np.float32(1 / (1 - 0.99 ** self.step))
        size = self.two.shape[1]
        for k, g in gradient.items():
            lines = [x.reshape(-1) for x in (g, self.m[k], self.v[k], self.p[k])]
            for s in range(0, lines[0].size, size):          # slices that stay in a core's cache
                g, m, v, p = (x[s:s + size] for x in lines)
                x, y = (t[:len(g)] for t in self.two)
                np.subtract(g, m, out=x)
                x *= np.float32(0.1)
                m += x
                np.multiply(g, g, out=x)
                x -= v
                x *= np.float32(0.01)
                v += x
                np.multiply(v, late, out=x)
                np.sqrt(x, out=x)
                x += np.float32(1e-7)
                np.multiply(m, rate, out=y)
                y /= x
                p -= y


def dealt(items: np.ndarray, taken: int, steps: int, times: int) -> Iterator[np.ndarray]:
    """The items of each step: STEP_WINDOWS (times so many) up to the first ``steps`` steps, then LATE_WINDOWS; about equal ones."""
    few = min(len(items), max(0, steps - taken) * STEP_WINDOWS * times)
    for part, size in ((items[:few], STEP_WINDOWS * times), (items[few:], LATE_WINDOWS * times)):
        if len(part):
            yield from np.array_split(part, -(-len(part) // size))


def taken_all(parts: Iterable[tuple], cut: Callable, steps: int, seed: int) -> int:
    """Takes the steps into which ``cut`` divides each part, and those of the first parts again if there were too few;
    the windows or words of all parts."""
    r, taken, total, few = np.random.default_rng(seed), 0, 0, []
    for part in parts:
        total += len(part[1])
        if taken < steps:
            few.append(part)                                     # to be used again if there are no more
        for step in cut(part, taken, r):
            step()
            taken += 1
    while few and taken < steps:
        for part in few:
            for step in cut(part, taken, r):
                step()
                taken += 1
    return total


class Language:
    """The outer and the inner model."""

    def __init__(self, first: np.ndarray, rest: np.ndarray):
        self.outer, self.inner = Attention(OUTER, first), Attention(INNER, rest)

    def train(self, parts: Iterable[tuple[Bags, np.ndarray]], steps: int, rate: float, seed: int) -> int:
        """Both models learn all windows (2 * OUTER + 1 numbers of bags) of the parts, the inner one the words of a
        window's own block whole and as often as they stand there; the number of windows."""
        spelt: Counter[tuple[int, ...]] = Counter()

        def noted() -> Iterator[tuple[Bags, np.ndarray]]:
            for bags, windows in parts:
                late = windows[:, OUTER + 1:]
                times = np.bincount(late[late >= 0], minlength=len(bags))
                for i in np.flatnonzero(times):
                    spelt[tuple(bags.flat[bags.start[i]:bags.start[i] + bags.size[i]].tolist())] += int(times[i])
                yield bags, windows
        total = self.train_outer(noted(), steps, rate, seed)
        del spelt[(END,)]
        if spelt:
            self.train_inner([(Bags.of(list(spelt)), np.array([*spelt.values()]))], steps, rate, seed)
        return total

    def train_outer(self, parts: Iterable[tuple[Bags, np.ndarray]], steps: int, rate: float, seed: int) -> int:
        """Steps on all windows of the parts, each at least once, until there were so many steps; the number of windows."""
        outer = Adam(self.outer.p, rate)

        def cut(part: tuple[Bags, np.ndarray], taken: int, r: np.random.Generator) -> Iterator[Callable[[], None]]:
            bags, windows = part
            first = bags.first()
            place = np.full(len(bags) + 1, -1, np.int32)         # the last is that of -1
            runs = r.permutation(-(-len(windows) // RUN))[:, None] * RUN + np.arange(RUN)
            for at in dealt(runs[runs < len(windows)], taken, steps, 1):
                def step(w: np.ndarray = windows[at]) -> None:
                    there = np.zeros(len(bags) + 1, bool)
                    there[w] = True
                    there[-1] = False
                    used = np.flatnonzero(there)
                    place[used] = np.arange(len(used))
                    late = w[:, OUTER + 1:]
                    outer.take(self.outer.word_gradient(bags.take(used), place[w[:, :-1]], np.where(late >= 0, first[late], -1)))
                    place[used] = -1
                yield step
        return taken_all(parts, cut, steps, seed)

    def train_inner(self, parts: Iterable[tuple[Bags, np.ndarray]], steps: int, rate: float, seed: int) -> int:
        """Steps on all words of the parts (words, how often each counts), each at least once; the number of words.

        A word that is a large part of what the steps count is dealt over several of them.
        """
        inner = Adam(self.inner.p, rate)

        def cut(part: tuple[Bags, np.ndarray], taken: int, r: np.random.Generator) -> Iterator[Callable[[], None]]:
            bags, times = part
            windows, owner = inner_windows(bags)
            begin = np.searchsorted(owner, np.arange(len(bags) + 1))
            rough = [*dealt(r.permutation(len(bags)), taken, steps, OUTER // INNER)]
            often = np.minimum(len(rough), np.maximum(1, times * (64 * len(rough)) // max(1, times.sum()))).astype(np.int64)
            word = np.repeat(np.arange(len(bags)), often)
            for at in dealt(word[r.permutation(len(word))], taken, steps, OUTER // INNER):
                def step(at: np.ndarray = np.sort(at)) -> None:
                    size = begin[at + 1] - begin[at]
                    w = windows[np.repeat(begin[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    inner.take(self.inner.gradient(w[:, :-1, None], w[:, INNER + 1:], np.repeat(times[at] / often[at], size)))
                yield step
        return taken_all(parts, cut, steps, seed)

    def word_scores(self, ids: list[tuple[int, ...]] | Bags) -> np.ndarray:
        """Natural log probability of the ids after the first and of the end of each word."""
        out = np.zeros(len(ids))
        if len(ids):
            x, owner = inner_windows(ids)
            tables = self.inner.tables(self.inner.p["E"])
            for at in range(0, len(x), 8192):
                w = x[at:at + 8192]
                out += np.bincount(owner[at:at + 8192], weights=self.inner.log_probs(tables, w[:, :-1], w[:, INNER + 1:]).sum(1), minlength=len(out))
        return out

    def line_scores(self, lines: list[np.ndarray], bags: Bags) -> np.ndarray:
        """For each line of numbers of bags, with the last bag before and after it, the natural log probability of its
        first ids and the end."""
        used = np.zeros(len(bags), bool)
        used[-1] = True
        for line in lines:
            used[line] = True
        place = np.cumsum(used, dtype=np.int32) - 1
        end = place[-1:]
        return self.first_scores(bags.take(np.flatnonzero(used)), [np.concatenate([end, place[line], end]) for line in lines])

    def first_scores(self, bags: Bags, lines: list[np.ndarray]) -> np.ndarray:
        """For each line of numbers of bags the log probability of the first ids after its first word."""
        tables = self.outer.tables(bags.mean(self.outer.p["E"]))
        first = bags.first()
        parts = [blocks_of(line, OUTER) for line in lines]
        w, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        out = np.zeros(len(lines))
        for at in range(0, len(w), 1024):
            x = w[at:at + 1024]
            late = x[:, OUTER + 1:]
            target = np.where(late >= 0, first[late], -1)
            out += np.bincount(owner[at:at + 1024], weights=self.outer.log_probs(tables, x[:, :-1], target).sum(1), minlength=len(out))
        return out

    def dump(self) -> bytes:
        return self.outer.dump() + self.inner.dump()

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        return self.outer.slot, self.inner.slot

    @staticmethod
    def of(raw: bytes | None, slots: tuple[np.ndarray, np.ndarray]) -> Language:
        """The models of ``dump``, or ones with weights yet to be loaded."""
        out = Language(np.zeros(VOCAB), np.zeros(VOCAB))
        if raw is not None:
            out.outer.load(raw)
            out.inner.load(raw[len(out.outer.dump()):])
        out.outer.slot, out.inner.slot = slots
        return out


class Lexicon:
    """Frequent words with their training counts, ids, and log probability after the first id; bounded, sent to tasks.

    After first id f a word has (1 - m) * count / total + m * inner model, where
    total is the count of all training words with f and m the share of those
    seen once; m is one for a first id that no training word has.
    """

    def __init__(self, counts: dict[bytes, int], subwords: Subwords):
        self.number = {w: i for i, w in enumerate(counts)}
        self.counts = np.array([*counts.values()], np.float64)
        self.logs = np.log10(self.counts + 1)
        self.bags = Bags.of(subwords.ids(list(counts)))
        self.rest = np.zeros(len(counts))

    def finish(self, language: Language, total: np.ndarray, once: np.ndarray) -> Lexicon:
        """Sets the mixture from the counts of first ids among all training words and among words seen once."""
        share = np.where(total > 0, (once + 0.5) / (total + 1), 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.by_count = np.where(total > 0, np.log1p(-share) - np.log(total), -np.inf)     # and the log of a word's count
        self.by_model = np.log(share)                                                         # and the inner model
        self.rest = self.after_first(language, self.bags, self.counts)
        end = self.number.get(b"")
        if end is not None:
            self.rest[end] = 0.0                              # nothing follows an end
        return self

    def after_first(self, language: Language, bags: Bags, counts: np.ndarray) -> np.ndarray:
        """Log probability of what follows the first id of each word, by its training count (0: none) and the inner model."""
        first = bags.first()
        with np.errstate(divide="ignore"):
            return np.logaddexp(self.by_count[first] + np.log(counts), self.by_model[first] + language.word_scores(bags))

    def lines(self, texts: pa.Array, sub: Subwords) -> tuple[list[np.ndarray], list[bytes], Bags]:
        """For each text the numbers of its words; the words without a place in the lexicon, which are numbered on;
        the ids of all and, at the end, of the end of a text."""
        at, ends, distinct = split_words(texts)
        n = len(self.number)
        number = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int32, len(distinct))
        new = np.flatnonzero(number < 0)
        number[new] = n + np.arange(len(new))
        other = [distinct[i] for i in new]
        return np.split(number[at], ends[1:-1]), other, self.bags + sub.bags(other) + Bags.of([(END,)])


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of texts (``common.words``, null: none): the number of each among the distinct ones, where each
    text's begin and the last's end, and the distinct ones."""
    whole = pa.concat_arrays([texts.fill_null(""), pa.array([], texts.type)])     # a slice's offsets are lost in a cast
    parts = pc.ascii_split_whitespace(pc.ascii_lower(whole.cast(pa.large_string())))
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0)                 # blanks at either end leave an empty piece
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    found = flat.filter(real).dictionary_encode()
    return found.indices.to_numpy(), kept[parts.offsets.to_numpy()], found.dictionary.cast(pa.large_binary()).to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(w binary, c): words of all texts, and the empty word for the end of each text."""
    def given(c: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["w", "c"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[bytes] = Counter()
        for batch in bounded(batches):
            at, _, distinct = split_words(batch.column(0))
            for w, n in zip(distinct, np.bincount(at, minlength=len(distinct)).tolist()):
                c[w] += n
            c[b""] += batch.num_rows
            if len(c) > CACHE:
                yield given(c)
                c.clear()
        if c:
            yield given(c)
    return (docs.select("text").mapInArrow(lambda batches: released(counted(batches)), "w binary, c long")
            .groupBy("w").agg(F.sum("c").alias("c")))


def windows_of(texts: list[str] | pa.Array, sub: Subwords, turn: int, lexicon: Lexicon | None = None) -> tuple[Bags, np.ndarray]:
    """Words and the windows (2 * OUTER + 1 numbers of words) of all blocks of the documents that are learned in this round.

    A document's round is given by the hash of its text, as in ``of_round``.
    """
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.fill_null("")
    mine = [_signed(xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), 42)) % (LEARN_EVERY * ROUNDS) == turn * LEARN_EVERY
            for t in texts.to_pylist()]
    lines, _, bags = (lexicon or Lexicon({}, sub)).lines(texts.filter(pa.array(mine, pa.bool_())), sub)
    end = np.array([len(bags) - 1], np.int32)
    parts = [blocks_of(np.concatenate([end, line, end]), OUTER) for line in lines[:sum(mine)]]
    return bags, np.concatenate([np.zeros((0, 2 * OUTER + 1), np.int32), *parts])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def of_round(column: str, every: int, turn: int) -> Column:
    """Whether the hash of a column falls to a round."""
    return F.pmod(F.xxhash64(column), F.lit(every * ROUNDS)) == turn * every


def _rounds(rows: Callable[[int], DataFrame], learned: Callable[[Iterator[pa.RecordBatch], int, float, int], int], model: Attention) -> None:
    """Rounds of local steps of a model on rows, weights averaged by windows or words.

    ``learned`` takes (weights, batches, rate, round) in a task and gives (how much was learned, weights).
    """
    schema = "piece long, n long, weights binary"
    for turn in range(ROUNDS):
        raw, rate = model.dump(), RATE * (1 - turn / ROUNDS) + RATE / 20

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n_, done = learned(raw, batches, rate, turn)
            for at in range(0, len(done) if n_ else 0, PIECE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at // PIECE], pa.int64()), pa.array([n_], pa.int64()), pa.array([done[at:at + PIECE]], pa.binary())],
                    ["piece", "n", "weights"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            total: Counter[int] = Counter()
            for b in batches:
                for piece, n_, raw_ in zip(*(c.to_pylist() for c in b.columns)):
                    sums[piece] = sums.get(piece, 0) + n_ * np.frombuffer(raw_, np.float32).astype(np.float64)
                    total[piece] += n_
            for piece, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([total[piece]], pa.int64()),
                                                  pa.array([(s / total[piece]).astype(np.float32).tobytes()], pa.binary())],
                                                 ["piece", "n", "weights"])
        parts = rows(turn).mapInArrow(lambda batches, step=step: released(step(batches)), schema)
        # averaged in pieces of the weights, so no task holds all tasks' weights
        found = parts.repartition("piece").mapInArrow(mean, schema).collect()
        if found:
            model.load(b"".join(bytes(r.weights) for r in sorted(found, key=lambda r: r.piece)))


def _learn(docs: DataFrame, counts: DataFrame, n_words: int, n_distinct: int, merges: list, lexicon: Lexicon, start: Language) -> Language:
    """The outer model learns the windows of all documents, the inner one all distinct words by their counts."""
    if not n_words:
        return start
    slots, sent = start.slots(), docs.sparkSession.sparkContext.broadcast((lexicon, merges))
    tasks = lambda n: -(-n // (OUTER * TASK_WINDOWS))                    # noqa: E731
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text")).coalesce(tasks(n_words))
    words_ = counts.where(F.length("w") > 0).select("w", "c").coalesce(tasks(max(1, n_distinct)))

    def outer(raw: bytes, batches: Iterator[pa.RecordBatch], rate: float, turn: int) -> tuple[int, bytes]:
        lex, merges_ = sent.value
        sub, language = Subwords(merges_), Language.of(None, slots)
        language.outer.load(raw)
        parts = (windows_of(batch.column(0), sub, turn, lex) for batch in bounded(batches))
        return language.train_outer((p for p in parts if len(p[1])), STEPS, rate, turn), language.outer.dump()

    def inner(raw: bytes, batches: Iterator[pa.RecordBatch], rate: float, turn: int) -> tuple[int, bytes]:
        sub, language = Subwords(sent.value[1]), Language.of(None, slots)
        language.inner.load(raw)

        def cut() -> Iterator[tuple[Bags, np.ndarray]]:
            for table_ in gathered(batches, BATCH_WORDS):
                c = table_.column("c").to_numpy()
                yield sub.bags(table_.column("w").to_pylist()), np.where(c < OFTEN, c, c / ROUNDS)
        return language.train_inner(cut(), STEPS, rate, turn), language.inner.dump()
    _rounds(lambda turn: words_.where(of_round("w", 1, turn) | (F.col("c") >= OFTEN)), inner, start.inner)
    _rounds(lambda turn: docs.where(of_round("text", LEARN_EVERY, turn)), outer, start.outer)
    return start


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _first_ids(counts: DataFrame, merges: list) -> tuple[np.ndarray, np.ndarray]:
    """Counts of first ids over all training words, and over words seen once."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, once, sub = np.zeros(VOCAB, np.int64), np.zeros(VOCAB, np.int64), Subwords(merges)
        for b in gathered(batches, BATCH_WORDS):
            first, c = sub.bags(b.column("w").to_pylist()).first(), b.column("c").to_numpy()
            total += np.bincount(first, weights=c, minlength=VOCAB).astype(np.int64)
            once += np.bincount(first[c == 1], minlength=VOCAB)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(VOCAB)), pa.array(total), pa.array(once)], ["id", "total", "once"])
    out = np.zeros((2, VOCAB))
    ends = F.length("w") == 0
    for r in (counts.where(~ends).select("w", "c").mapInArrow(counted, "id long, total long, once long").groupBy("id")
              .agg(F.sum("total").alias("total"), F.sum("once").alias("once")).collect()):
        out[:, r.id] = r.total, r.once
    for r in counts.where(ends).collect():
        out[:, END] = r.c, r.c == 1
    return out[0], out[1]


def learn(docs: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, Lexicon, list, Language]:
    """(word counts, lexicon of frequent words, merges, model) of training documents."""
    counts = write_table(word_counts(docs), "counts")
    known = {bytes(r.w): r.c for r in most_frequent(counts, "c", KNOWN_WORDS).collect()}
    merges = first_merges(Vocabulary(vocabulary or default_vocabulary()))
    sub = Subwords(merges)
    lexicon = Lexicon(known, sub)
    first = np.bincount(lexicon.bags.first(), weights=lexicon.counts, minlength=VOCAB)
    rest = np.bincount(lexicon.bags.flat, weights=np.repeat(lexicon.counts, lexicon.bags.size), minlength=VOCAB) - first
    rest[END] = lexicon.counts.sum()
    n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    language = _learn(docs, counts, int(n), int(distinct), merges, lexicon, Language(first, rest))
    return counts, lexicon.finish(language, *_first_ids(counts, merges)), merges, language


def score(docs: DataFrame, train: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words and one end for each text.  ``base_score`` is the add-one
    unigram score by the counts of ``train``, ``score`` the model's log10
    probability of the whole text.  A null text is an empty one; without
    training rows nothing is known and the model keeps its first weights.
    """
    counts, lexicon, merges, model = learn(train, vocabulary)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(n), int(v)
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, model.dump(), model.slots(), merges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, raw, slots, merges_ = sent.value
        language, sub = Language.of(raw, slots), Subwords(merges_)
        end, known = lex.number.get(b""), len(lex.number)
        end_log = 0.0 if end is None else lex.logs[end]
        for batch in bounded(batches):
            lines, other, bags = lex.lines(batch.column(1), sub)
            lines = lines[:batch.num_rows]
            size = np.fromiter(map(len, lines), np.int64, len(lines))
            flat, owner = np.concatenate(lines), np.repeat(np.arange(len(lines)), size)
            total = language.line_scores(lines, bags)
            sure = flat < known
            of_line = lambda w: np.bincount(owner[sure], weights=w, minlength=len(lines))
            total += of_line(lex.rest[flat[sure]])
            pairs, times = np.unique(owner[~sure] * max(1, len(other)) + flat[~sure] - known, return_counts=True)
            line, word = np.divmod(pairs, max(1, len(other)))
            parts = pa.StructArray.from_arrays([pa.array(other, pa.binary()).take(pa.array(word)), pa.array(times, pa.int64())], ["w", "times"])
            ends = np.searchsorted(line, np.arange(len(lines) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size + 1), pa.array(of_line(None).astype(np.int64) + (end is not None)),
                 pa.array(of_line(lex.logs[flat[sure]]) + end_log), pa.array(total / np.log(10)),
                 pa.ListArray.from_arrays(pa.array(ends), parts)],
                ["doc_id", "n_tokens", "sure", "base", "score", "rare"])

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, raw, slots, merges_ = sent.value
        language, sub = Language.of(raw, slots), Subwords(merges_)
        for batch in gathered(batches, BATCH_WORDS):
            row, w, times, c = (batch.column(i).combine_chunks() for i in range(4))
            found = w.dictionary_encode()
            at, c, times = found.indices.to_numpy(), c.to_numpy(), times.to_numpy()
            count = np.zeros(len(found.dictionary))
            count[at] = c
            rest = lex.after_first(language, sub.bags(found.dictionary.to_pylist()), count) / np.log(10)
            yield pa.RecordBatch.from_arrays([row, pa.array(np.where(c > 0, times, 0)), pa.array(times * np.log10(c + 1)),
                                              pa.array(times * rest[at])], ["row", "more", "logs", "rest"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = write_table(
        docs.select("doc_id", "text").mapInArrow(
            lambda batches: released(run(batches)),
            f"doc_id {kind}, n_tokens long, sure long, base double, score double, rare array<struct<w: binary, times: long>>")
        .withColumn("row", F.monotonically_increasing_id()), "scored")
    # words that tasks don't know: their counts complete both scores; equal ones stand together, so each is spelt once
    others = (scored.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts.hint("merge"), "w", "left")
              .select("row", "w", "times", F.coalesce("c", F.lit(0)).alias("c"))
              .mapInArrow(lambda batches: released(spelt(batches)), "row long, more long, logs double, rest double").groupBy("row")
              .agg(F.sum("more").alias("more"), F.sum("logs").alias("logs"), F.sum("rest").alias("rest")))
    unit = float(np.log10(n + 1 * (v + 1)))
    return (scored.drop("rare").join(others, "row", "left")
            .select("doc_id", "n_tokens", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_known"),
                    F.lit(n).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
                    (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score")))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return score(docs, docs.where(~held)).withColumn("held_out", held).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
