"""Quality by attention-based multiple-instance learning.

A text is a bag of passages.  Every passage of the whole text is encoded into
numbers about its letters, words and repetition; an encoder, gated attention
weights and a classifier of the weighted mean are learned together from labels
of whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import fold_of, lists, map_batches, slices, table

#: Labelled rows that learning uses at most (lowest hash of the id); every passage of them is learned.
MAX_ROWS = 6_000
PASSAGE_WORDS = 64
THRESHOLD = 0.5
FOLDS, HELD_OUT = 3, 1
HIDDEN, GATE = 24, 12
EPOCHS, BAGS, RATE, DECAY = 30, 64, 0.01, 1e-4

# classes of characters below 128; all others are letters of other scripts
_SPACE, _LINE, _LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL, _OTHER = range(8)
N_FEATURES = 20


def _classes() -> np.ndarray:
    kind = np.full(128, _SYMBOL, np.uint8)
    kind[:33] = _SPACE
    kind[10] = _LINE
    kind[ord("a"):ord("z") + 1] = _LOWER
    kind[ord("A"):ord("Z") + 1] = _UPPER
    kind[ord("0"):ord("9") + 1] = _DIGIT
    kind[[ord(c) for c in ".,;:'?"]] = _STOP
    return kind


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features, number of the text) of every passage of so many words; a text without words has one empty passage."""
    texts = [t or "" for t in texts]
    parts = [t.split() for t in texts]
    count = np.array([len(p) for p in parts], np.int64)
    bags = np.maximum(1, -(-count // PASSAGE_WORDS))
    owner = np.repeat(np.arange(len(texts)), bags)
    offset = np.cumsum(bags) - bags
    n = int(bags.sum())
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    of_word = np.repeat(offset, count) + place // PASSAGE_WORDS
    words = [w for p in parts for w in p]
    size = np.bincount(of_word, minlength=n).astype(np.float64)
    base = np.maximum(size, 1)
    length = np.fromiter(map(len, words), np.int64, len(words))
    value = np.fromiter(map(hash, words), np.int64, len(words))

    kinds = _classes()
    points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    kind = np.where(points < 128, kinds[np.minimum(points, 127)], _OTHER)
    word_at = np.repeat(np.arange(len(words)), length)
    by_kind = np.bincount(of_word[word_at] * 8 + kind, minlength=8 * n).reshape(n, 8) if len(words) else np.zeros((n, 8))
    by_word = np.bincount(word_at * 8 + kind, minlength=8 * len(words)).reshape(-1, 8) if len(words) else np.zeros((0, 8))
    chars = np.maximum(by_kind.sum(1), 1)

    per = lambda flag: np.bincount(of_word, weights=flag, minlength=n) / base         # noqa: E731
    order = np.lexsort((value, of_word))
    fresh = np.ones(len(words))
    if len(words) > 1:
        fresh[1:] = (value[order][1:] != value[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    again = np.zeros(len(words))
    again[1:] = (value[1:] == value[:-1]) & (of_word[1:] == of_word[:-1])
    second = np.zeros(len(words))
    second[2:] = (value[2:] == value[:-2]) & (of_word[2:] == of_word[:-2])
    letters = by_word[:, _LOWER] + by_word[:, _UPPER] + by_word[:, _OTHER]
    odd = by_word[:, _SYMBOL]
    mean = per(length)
    features = np.column_stack([
        by_kind[:, _LOWER] / chars, by_kind[:, _UPPER] / chars, by_kind[:, _DIGIT] / chars, by_kind[:, _STOP] / chars,
        by_kind[:, _SYMBOL] / chars, by_kind[:, _OTHER] / chars,
        np.bincount(of_word[order], weights=fresh, minlength=n) / base, per(again), per(second),
        mean / 10, np.sqrt(np.maximum(per(length * length) - mean * mean, 0)) / 10,
        per((by_word[:, _UPPER] > 1) & (by_word[:, _LOWER] == 0)), per((odd > 0) & (letters > 0)), per((odd > 0) & (letters == 0)),
        per(letters == 0), per(by_word[:, _DIGIT] > 0), per(by_word[:, _STOP] > 0), per(length == 1),
        per((by_word[:, _UPPER] == 1) & (by_word[:, _LOWER] > 0)), np.log1p(size)])
    return features.astype(np.float32), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """h = tanh(x W + b); weights of a bag: softmax of (tanh(h V) * sigmoid(h U)) w; classifier of the weighted mean."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)              # noqa: E731
        self.p = {"W": draw(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
                  "w": draw(GATE, 1)[:, 0], "c": np.zeros(HIDDEN), "d": np.zeros(1)}
        self.mean, self.std = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> tuple:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, e)
        a = np.exp(e - top[owner])
        a /= np.bincount(owner, weights=a, minlength=n)[owner]
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, owner, a[:, None] * h)
        return h, t, s, a, z, _sigmoid(z @ p["c"] + p["d"])

    def gradient(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        h, t, s, a, z, out = self.forward(x, owner, n)
        g = (out - y) / n
        dz = g[:, None] * p["c"]
        da = (dz[owner] * h).sum(1)
        de = a * (da - np.bincount(owner, weights=a * da, minlength=n)[owner])
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (a[:, None] * dz[owner] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": g.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
        x = np.concatenate(bags).astype(np.float64)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        r, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for at in range(0, len(order), BAGS):
                pick = order[at:at + BAGS]
                part = np.concatenate([bags[i] for i in pick])
                owner = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
                step += 1
                for k, g in self.gradient((part - self.mean) / self.std, owner, y[pick]).items():
                    g = g + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, owner = encode_passages(texts)
        return self.forward((x - self.mean) / self.std, owner, len(texts))[-1]

    def scores(self, parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows = max(1, min(500, len(texts)))
            yield pd.Series(np.concatenate([self.score(texts.iloc[i:i + rows].tolist()) for i in range(0, len(texts), rows)])
                            if len(texts) else [], dtype="float64")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from ``labels`` (doc_id, quality) outside the held-out fold.

    At most ``max_rows`` labelled rows are read, each as a bag of all its passages
    (twenty numbers for 64 words); that bounds what is broadcast and what reaches
    the driver.  Without labels every text scores one half.
    """
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", FOLDS) != HELD_OUT))
             .groupBy("doc_id").agg(F.max("quality").cast("int").alias("__quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    train = (docs.where("text is not null").select("doc_id", "text")
             .join(F.broadcast(known), "doc_id").select("doc_id", "text", "__quality"))

    def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, owner = encode_passages(batch.column(1).to_pylist())
        out = np.split(x, np.flatnonzero(np.diff(owner)) + 1)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), lists([bag.ravel() for bag in out], pa.float32())], ["doc_id", "quality", "bag"])
    rows = map_batches(train, bags, "doc_id long, quality int, bag array<float>").toArrow().sort_by("doc_id")
    y = rows.column("quality").to_numpy().astype(np.float64)
    if not len(y):
        return Model()
    found = [v.reshape(-1, N_FEATURES) for c in rows.column("bag").chunks for v in slices(c)]
    return Model().fit(found, y)


def score(docs: DataFrame, model: Model, column: str = "quality") -> DataFrame:
    """``docs`` plus a score in 0..1 of each whole ``text``; null and empty texts are one empty passage."""
    udf = F.pandas_udf(model.scores, "double")
    return docs.withColumn(column, udf(F.col("text")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")), "score").select(
        "doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
