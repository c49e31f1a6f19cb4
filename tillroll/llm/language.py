"""Language of a text by hierarchical discrimination.

First the language family is predicted (linear support vector machines, one
family against the rest), then linear machines of one language against one
other vote among the languages of that family.  Features are the letter
n-grams of the whole text; learning uses a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import fold_of, lists, map_batches, slices, table

#: Labelled rows that learning uses, about: each language has an equal share (lowest hash of the id;
#: never more than twice this number in all); and the languages learned, the most frequent ones.
MAX_ROWS, MAX_LANGUAGES = 2_000, 200
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: n-grams of one to three letters; each length has its own range of hashed places.
ORDERS, PLACES = 3, 1 << 12
WIDTH = ORDERS * PLACES
#: Each learned row also gives a passage of a few words, so that short texts are learned too.
PASSAGE = 4, 12
EPOCHS, COST, SEED = 12, 4.0, 5
GROUP = 64

#: Families of languages by code; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "austronesian": "id ms jv tl",
}


def family_of(lang: str, families: dict[str, str] = FAMILIES) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in families.items() if code in codes.split()), lang)


# --- features --------------------------------------------------------------------------------
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(texts: list[str | None], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of square roots of shares of hashed n-grams, has a letter) for each text.

    Case does not count; a run of other characters is one boundary.  A text's row does not
    depend on the texts beside it; each length of n-gram has length 1 in it.
    """
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) + 2 for t in low])
    letter = is_letter[points]
    some = np.bincount(owner, weights=letter, minlength=len(low)) > 0
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    value = np.where(letter, points, 0)[keep].astype(np.uint64)
    owner = owner[keep]
    rows = np.zeros((len(low), WIDTH), np.float32)
    code = np.zeros(len(value), np.uint64)
    for k in range(ORDERS):
        if len(value) <= k:
            break
        code = code[:len(value) - k] * np.uint64(0x9E3779B97F4A7C15) + value[k:] + np.uint64(1)
        inside = owner[:len(code)] == owner[k:]
        if k == 0:
            inside = inside & (value > 0)
        mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        place = (mixed >> np.uint64(52)).astype(np.int64)
        count = np.bincount((owner[:len(code)] * PLACES + place)[inside], minlength=len(low) * PLACES).reshape(len(low), PLACES)
        rows[:, k * PLACES:(k + 1) * PLACES] = np.sqrt(count / np.maximum(count.sum(1, keepdims=True), 1))
        code = code[:len(value) - k]
    rows[~some] = 0
    return rows, some


# --- linear support vector machines ----------------------------------------------------------
def machine(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and offset of the squared-hinge machine for y of -1 and 1 by dual coordinate descent.

    Each side has the same total cost, however many rows it has.
    """
    rng = np.random.default_rng(SEED)
    side = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * len(y) / 2
    slack = 1 / (2 * cost * side)
    norm = np.einsum("ij,ij->i", x, x).astype(np.float64) + 1 + slack
    w, b, alpha = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(y))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slope = y[i] * (float(x[i] @ w) + b) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / norm[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w += np.float32(step * y[i]) * x[i]
                b += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


class Model:
    """Machines of families and of pairs of languages, as columns of one matrix."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES):
        self.langs = sorted(set(langs))
        family = {v: family_of(v, families) for v in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[i for i, v in enumerate(self.langs) if family[v] == f] for f in self.families]
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        lang = np.array([self.langs.index(v) for v in langs], np.int64)
        of = np.array([self.families.index(family[v]) for v in langs], np.int64)
        found = []
        if len(self.families) > 1:
            found += [machine(x, np.where(of == f, 1.0, -1.0)) for f in range(len(self.families))]
        for a, b in self.pairs:
            rows = np.flatnonzero((lang == a) | (lang == b))
            found.append(machine(x[rows], np.where(lang[rows] == a, 1.0, -1.0)))
        self.w = np.stack([w for w, _ in found], 1) if found else np.zeros((WIDTH, 0), np.float32)
        self.b = np.array([b for _, b in found])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``langs``, score) of each row.

        A duel is worth the logistic function of its margin.  The language that wins most
        duels is taken, of equal ones that with the higher sum, then the first by name; the
        score is the family's share times the language's closest duel.
        """
        margin = x @ self.w + self.b
        n, lead = len(x), len(self.families) if len(self.families) > 1 else 0
        worth = 1 / (1 + np.exp(-np.clip(4 * margin, -40, 40)))
        share = np.ones((n, 1))
        if lead:
            share = worth[:, :lead] / worth[:, :lead].sum(1, keepdims=True)
        family = share.argmax(1)
        wins, total = np.zeros((n, len(self.langs))), np.zeros((n, len(self.langs)))
        closest = np.ones((n, len(self.langs)))
        for j, (a, b) in enumerate(self.pairs):
            p = worth[:, lead + j]
            for lang, q in ((a, p), (b, 1 - p)):
                wins[:, lang] += q > 0.5
                total[:, lang] += q
                closest[:, lang] = np.minimum(closest[:, lang], q)
        rank = wins * (2 * len(self.langs) + 2) + total
        for f, members in enumerate(self.members):
            others = np.setdiff1d(np.arange(len(self.langs)), members)
            rank[np.ix_(family == f, others)] = -1
        best = rank.argmax(1)
        at = np.arange(n)
        return best, share[at, family] * closest[at, best]


def learn(docs: DataFrame, label: str = "lang", max_rows: int = MAX_ROWS, families: dict[str, str] = FAMILIES) -> Model | None:
    """A model from the rows with a text, a label and an id outside the held-out fold; None if there are none.

    ``max_rows`` bounds the rows that reach the driver; equal texts of one language are one row.
    """
    known = docs.where((fold_of("doc_id", FOLDS) != HELD_OUT) & F.col("text").isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("lang"), "doc_id", "text")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return None
    share = max(1, max_rows // len(counts))
    cuts = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 1.2 * share / r.n)) for r in counts], "lang string, cut double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    train = known.join(F.broadcast(cuts), "lang").where(draw < F.col("cut")).select("lang", "text", F.xxhash64("text").alias("print"))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        is_letter = letters()
        langs, texts, prints = (c.to_pylist() for c in batch.columns)
        held = []
        for i, (mark, text) in enumerate(zip(prints, texts)):
            held.append((i, text))
            words = text.split()
            size = PASSAGE[0] + mark % (PASSAGE[1] - PASSAGE[0] + 1)
            if len(words) > 2 * size:
                at = mark // 64 % (len(words) - size + 1)
                held.append((i, " ".join(words[at:at + size])))
        rows, some, cells = [], [], []
        for at in range(0, len(held), GROUP):
            x, ok = features([t for _, t in held[at:at + GROUP]], is_letter)
            some += ok.tolist()
            for row in x:
                rows.append(np.flatnonzero(row))
                cells.append(row[rows[-1]])
        source = [i for i, _ in held]
        out = pa.RecordBatch.from_arrays([
            pa.array([langs[i] for i in source]), pa.array([prints[i] for i in source], pa.int64()),
            pa.array([len(t) for _, t in held], pa.int64()), lists(rows, pa.int32()), lists(cells, pa.float32())],
            ["lang", "print", "size", "place", "value"])
        return out.filter(pa.array(some))
    found = (map_batches(train, encode, "lang string, print long, size long, place array<int>, value array<float>")
             .orderBy(F.xxhash64("print"), "lang", "size").limit(4 * max_rows).toArrow())
    first: dict[tuple, int] = {}
    for i, mark in enumerate(zip(*(found.column(c).to_pylist() for c in ("lang", "print", "size")))):
        first.setdefault(mark, i)
    found = found.take(list(first.values())).combine_chunks()
    if not found.num_rows:
        return None
    x = np.zeros((found.num_rows, WIDTH), np.float32)
    chunks = [(slices(p), slices(v)) for p, v in zip(found.column("place").chunks, found.column("value").chunks)]
    for i, (place, value) in enumerate((p, v) for ps, vs in chunks for p, v in zip(ps, vs)):
        x[i, place] = value
    return Model(x, found.column("lang").to_pylist(), families)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` of each whole ``text``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text when
    nothing could be learned.  Columns of these two names in ``docs`` are replaced.
    """
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        is_letter = letters()
        for texts in parts:
            lang, score, held = [UNKNOWN] * len(texts), np.zeros(len(texts)), texts.tolist()
            for at in range(0, len(held) if model else 0, GROUP):
                x, some = features(held[at:at + GROUP], is_letter)
                best, value = model.predict(x)
                for i in np.flatnonzero(some):
                    lang[at + i], score[at + i] = model.langs[best[i]], value[i]
            yield pd.DataFrame({"lang_pred": pd.Series(lang, dtype="object"), "score": score})
    udf = F.pandas_udf(run, "lang_pred string, score double")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(*kept, udf(F.col("text")).alias("__found"))
    return found.select(*kept, F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), learn(docs)).select(
        "doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
