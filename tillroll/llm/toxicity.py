"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon holds words and stems that labelled rows show to be toxic.  It is a
trie; the Levenshtein automaton of every entry is intersected with it in one
lazily built deterministic automaton, so a word is matched against all entries
and misspellings in one walk.  Each hit is judged in its context window: inside
quotation marks it counts as quotation.  Evidence (entry, edits, quoted) is
weighted by how often labelled rows of either kind show it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import fold_of, map_batches, released, table

#: Labelled rows that learning uses at most (those with the lowest hash of the id).
MAX_ROWS = 10_000
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Letters that a stem has; whole words are learned at any length.
STEM_MIN, STEM_MAX = 3, 12
#: Misspellings of an entry are expected this often, as a part of its exact hits, until seen.
MISSPELT = 0.02
#: A quoted hit has at most this part of the weight of the same hit unquoted.
QUOTED = 0.3
#: Characters to each side of a hit in which quotation marks are looked for.
WINDOW = 60
#: Contexts in toxic rows that a pattern has at least, and its log likelihood gain over chance
#: (one in 400,000 patterns passes by chance).
MIN_CONTEXTS, GAIN = 4, 13.0
#: Words whose matches a task keeps, and states of the automaton; beyond that they are made anew.
CACHE, STATES = 100_000, 20_000
#: Bytes of text whose words are collected with their neighbours at once.
SLICE_BYTES = 1 << 19

WORD = re.compile(r"[^\W\d_]+")
MARK = re.compile("[\"“”„«»‹›]")


def edits_for(letters: int) -> int:
    """Edits that an entry of so many letters forgives."""
    return 0 if letters < 5 else 1 if letters < 8 else 2


class Matcher:
    """Levenshtein automata of all entries, intersected with their trie.

    An entry ending in ``$`` is a whole word, others are stems.  A state is the
    set of (trie node, edits) that the letters read so far allow; states and
    steps are made when first needed.
    """

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.next: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.limit = [0]
        for number, entry in enumerate(entries):
            letters = entry.rstrip("$")
            node, path = 0, [0]
            for ch in letters:
                if ch not in self.next[node]:
                    self.next.append({})
                    self.limit.append(0)
                    self.next[node][ch] = len(self.next) - 1
                node = self.next[node][ch]
                path.append(node)
            for at in path:
                self.limit[at] = max(self.limit[at], edits_for(len(letters)))
            (self.whole if entry.endswith("$") else self.stem)[node] = number
        self.words: dict[str, tuple[int, int] | None] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set) -> int:
        """The number of a state, after skipped letters of the entries are added."""
        todo, seen = list(pairs), set(pairs)
        while todo:
            node, e = todo.pop()
            if node < 0:
                continue
            if node in self.stem and e <= edits_for(len(self.entries[self.stem[node]])):
                seen.add((-1 - self.stem[node], e))
            for child in self.next[node].values():
                if e < self.limit[child] and (child, e + 1) not in seen:
                    seen.add((child, e + 1))
                    todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in seen:
            best[node] = min(e, best.get(node, e))
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if node < 0:                                        # a stem that was read stays read
                out.add((node, e))
                continue
            for letter, child in self.next[node].items():
                if letter == ch:
                    out.add((child, e))
                elif e < self.limit[child]:
                    out.add((child, e + 1))
            if e < self.limit[node]:
                out.add((node, e + 1))
        found = self.steps[state, ch] = self._state(out)
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the nearest entry, the first of equals; None without any."""
        if word in self.words:
            return self.words[word]
        if len(self.sets) > STATES:
            self._restart()
        state, steps = self.start, self.steps
        for ch in word:
            found = steps.get((state, ch))
            state = self._step(state, ch) if found is None else found
            if not self.sets[state]:
                break
        ends = [(e, -1 - node) for node, e in self.sets[state] if node < 0]
        ends += [(e, self.whole[node]) for node, e in self.sets[state]
                 if node in self.whole and e <= edits_for(len(self.entries[self.whole[node]]) - 1)]
        if len(self.words) >= CACHE:
            self.words.clear()
        best = self.words[word] = min(ends)[::-1] if ends else None
        return best

    def evidence(self, text: str | None) -> set[tuple[int, int, bool]]:
        """Distinct (entry, edits, quoted) of a whole text."""
        low = (text or "").lower()
        hits = {w for w in set(WORD.findall(low)) if self.match(w)}
        found = set()
        if hits:
            for m in WORD.finditer(low):
                if m[0] in hits:
                    found.add((*self.match(m[0]), is_quoted(low, *m.span())))
        return found


def _opens(text: str, at: int) -> bool:
    """Whether the quotation mark at this place opens: it follows a blank, and a word or text follows it."""
    before = at == 0 or not text[at - 1].isalnum() and text[at - 1] not in ".,;:!?)]…"
    return before and (text[at] in "„«‹“" or at + 1 < len(text) and not text[at + 1].isspace())


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether a quotation is open at ``start`` and closes after ``end``, both within the window.

    The nearest mark to the left must be an opening one and the nearest to the right a closing
    one, so text between two quotations is not quoted.
    """
    last = None
    for m in MARK.finditer(text, max(0, start - WINDOW), start):
        last = m.start()
    if last is None or not _opens(text, last):
        return False
    after = MARK.search(text, end, min(len(text), end + WINDOW))
    return after is not None and not _opens(text, after.start())


class Model:
    """Entries with the weight of each kind of evidence; plain numbers, small, sent with the tasks."""

    def __init__(self, entries: list[str], weights: dict[tuple[int, int, bool], float], bias: float):
        self.entries, self.weights, self.bias = entries, weights, bias

    def scores(self, parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(self.entries)
        for texts in parts:
            yield pd.Series([
                1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(self.weights.get(e, 0.0) for e in matcher.evidence(t))))))
                for t in texts], dtype="float64")


def _significant(toxic: int, clean: int, base: float) -> bool:
    """Whether a share of toxic contexts this high is beyond chance among very many patterns."""
    n, p = toxic + clean, toxic / (toxic + clean)
    gain = toxic * math.log(p / base) + (clean * math.log((1 - p) / (1 - base)) if clean else 0.0)
    return p >= 0.8 and p > base and gain >= GAIN


def choose_entries(counts: dict[str, tuple[int, int]]) -> list[str]:
    """From candidate patterns to entries: the longest one that covers what its stem covers."""
    children: dict[str, list[str]] = {}
    for p in counts:
        children.setdefault(p[:-1], []).append(p)
    chosen, todo = [], sorted(p for p in counts if p[:-1] not in counts)
    while todo:
        p = todo.pop()
        best = max(children.get(p, []), key=lambda c: (counts[c][0], c), default=None)
        if best and counts[best][0] >= 0.9 * counts[p][0]:
            todo.append(best)
        else:
            chosen.append(p)
    return sorted(chosen)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Lexicon and weights from ``labels`` (doc_id, toxic) outside the held-out fold.

    At most ``max_rows`` labelled rows are read; that bound is what lets the ids
    be broadcast and the figures of the lexicon reach the driver.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", FOLDS) != HELD_OUT))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "__toxic")

    def contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[str, int], int] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = ["", *WORD.findall((text or "").lower()), ""]
            for before, word, after in zip(w, w[1:], w[2:]):
                key = word, xxhash.xxh3_64_intdigest(f"{before} {after}".encode()) >> 1
                found[key] = found.get(key, 0) | (1 if label else 2)
        columns = ([k[0] for k in found], [k[1] for k in found], list(found.values()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                                          ["word", "context", "kinds"])

    # copies of a text repeat its words with their neighbours: a word counts once for each pair of neighbours
    by_word = (map_batches(train, contexts, "word string, context long, kinds long", SLICE_BYTES)
               .groupBy("word", "context").agg(F.bit_or("kinds").alias("kinds"))
               .groupBy("word").agg(F.count_if(F.col("kinds") == 1).alias("toxic"), F.count_if(F.col("kinds") > 1).alias("clean")))
    marked = F.concat("word", F.lit("$"))
    # a word of one or two letters is only looked at whole: its "stem" of three places is the marked word
    stems = F.transform(F.sequence(F.lit(STEM_MIN), F.greatest(F.lit(STEM_MIN), F.least(F.length(marked), F.lit(STEM_MAX)))),
                        lambda n: F.substring(marked, F.lit(1), n))
    whole = F.when(F.length(marked) > STEM_MAX, F.array(marked)).otherwise(F.array().cast("array<string>"))
    by_stem = (by_word.select("toxic", "clean", F.explode(F.concat(stems, whole, F.array(F.lit("")))).alias("p"))
               .groupBy("p").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
               .where(F.expr(f"p = '' or toxic >= {MIN_CONTEXTS} and toxic >= clean")))
    counts = {r.p: (r.toxic, r.clean) for r in by_stem.collect()}
    all_toxic, all_clean = counts.pop("", (0, 0))
    entries = []
    if all_toxic and all_clean:
        base = all_toxic / (all_toxic + all_clean)
        entries = choose_entries({p: c for p, c in counts.items() if _significant(*c, base)})

    def evidence_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher, out = Matcher(entries), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out[-1, 0, False, bool(label)] += 1
            out.update((*e, bool(label)) for e in matcher.evidence(text))
        columns = list(zip(*((*k, n) for k, n in out.items())))
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["entry", "edits", "quoted", "toxic", "n"])
    seen: Counter = Counter()
    for r in (map_batches(train, evidence_counts, "entry long, edits long, quoted boolean, toxic boolean, n long")
              .groupBy("entry", "edits", "quoted", "toxic").agg(F.sum("n").alias("n")).collect()):
        seen[r.entry, r.edits, r.quoted, r.toxic] = r.n
    n_toxic, n_clean = seen[-1, 0, False, True], seen[-1, 0, False, False]
    weights = {}
    for i, entry in enumerate(entries):
        expected = MISSPELT * (seen[i, 0, False, True] + seen[i, 0, True, True])
        for edits in range(edits_for(len(entry.rstrip("$"))) + 1):
            for quoted in (False, True):
                t, c = seen[i, edits, quoted, True], seen[i, edits, quoted, False]
                more = expected if edits else 0.5
                weight = math.log((t + more) / (n_toxic + 1)) - math.log((c + (1 if edits else 0.5)) / (n_clean + 1))
                if edits and c > t:                              # as common in clean rows: an ordinary word
                    weight = 0.0
                if quoted and not t + c:
                    weight = QUOTED * weights[i, edits, False]
                weights[i, edits, quoted] = max(0.0, weight)
    return Model(entries, weights, math.log((n_toxic + 1) / (n_clean + 10)))


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``docs`` plus a score in 0..1 of each whole ``text``; null and empty texts get the score of no evidence."""
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return released(model.scores(parts))
    return docs.withColumn(column, F.pandas_udf(scores, "double")(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score stays below the threshold, in the columns of ``docs``."""
    scored = score(docs, learn(docs, labels), "__toxicity")
    return scored.where(F.col("__toxicity") < threshold).select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")), "score").select(
        "doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
