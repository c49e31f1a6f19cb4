"""Phrase collocations by dynamic itemset counting.

The documents are dealt into shards that are scanned in a cycle.  Words are
counted from the first shard on.  As soon as both subphrases of a longer phrase
(all but its last word, all but its first) have reached the threshold, the phrase
is active: it is counted from the next shard on, until it has seen each shard
once.  Phrases of two, three and four words are thus counted in the same scans,
each over one full cycle, whichever shard it started with.

Most active pairs of words are rare.  A pair that occurs ``least`` times in a cycle
of so many shards occurs ``least / shards`` times in one of them: its cycle starts
with the first shard that has so many, and pairs below that are not kept.

A scan holds the phrases of a bounded chunk of text in numpy, told apart by 64-bit
hashes; words are hashed where they stand, all at once.  What reached the threshold is known to it by one table for each length, which holds for a
hash of the phrase the last step after which a phrase of this hash had
reached it.  Two phrases with one hash can only start a count early or keep it
longer; what counts is decided by the counts table, which adds no scan beyond a
phrase's full cycle.  Pairs are kept as the hashes (64 bits, by language) of their
words, other phrases as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillroll.llm.common import WordHashes, bounded, mix, released, table
from tillroll.session import write_table

UNKNOWN = "und"
LEAST, MOST_WORDS, FIRST = 30, 4, 2000
#: A longer phrase that makes up this percentage of a shorter one replaces it.
COVERED = 80
SHARDS = 2
#: Slots of the table of a length: 16 for each phrase that reached the threshold, within these bounds.
#: Beyond the larger bound more phrases are counted than need be.
SLOTS = 1 << 16, 1 << 26
SLOTS_EACH = 16
#: Slots that one row of the table carries to the driver.
ROW_SLOTS = 1 << 14
#: Bytes of text that are hashed at once, and words that are counted at once, but for a single text that has more.
HASH_BYTES, CHUNK_WORDS = 1 << 18, 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK, _STOP = 1, 2
_KIND = np.array([_STOP if chr(c) in ".,;:!?\n\x0b\x0c\r" else _BLANK if chr(c) in " \t" else 0 for c in range(256)], np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(WordHashes):
    """Start, length and hash of each word, and the number of the piece that it stands in."""

    def __init__(self):
        super().__init__(_KIND > 0)

    def of(self, lowered: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        start, length, found = super().of(lowered)
        return start, length, found, np.cumsum(_KIND[np.frombuffer(lowered, np.uint8)] == _STOP)[start]


def seed_of(lang: str) -> int:
    """What tells the hashes of a language's words from those of the same words in another."""
    return xxhash.xxh3_64_intdigest(lang) | 1


def joined(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and the word after it."""
    return mix(phrase * _ODD + word)


def _distinct(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place, number, hash) of each distinct phrase among the places ``at``, whose hashes are ``key``."""
    order = np.argsort(key)
    found = key[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(found)), bool), found[1:] != found[:-1]]))
    return at[order[new]], np.diff(new, append=len(order)), found[new]


class Step:
    """What the scan of a step counts: its number, the lengths, and the tables of what has reached the threshold or begun."""

    def __init__(self, number: int, shards: int, lengths: set[int], reached: dict[int, np.ndarray], begun: np.ndarray | None):
        self.number, self.shards, self.lengths, self.reached, self.begun = number, shards, lengths, reached, begun

    def active(self, k: int, key: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether phrases of ``k`` words (hash, last step in which a subphrase reached the threshold, 255 for never) are counted."""
        here = (reach != 255) & (self.number <= reach.astype(np.int64) + self.shards)
        if k == 2 and self.begun is not None:
            begun = _look_up(self.begun, key)
            here |= (begun != 255) & (self.number < begun.astype(np.int64) + self.shards)
        return here


def _look_up(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    return known[(key & np.uint64(len(known) - 1)).astype(np.int64)]


def count_chunk(hashes: np.ndarray, piece: np.ndarray, step: Step) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, places, numbers, hashes) of the phrases active in this step, length by length; words of one piece can make phrases."""
    key, ok = hashes, np.ones(len(hashes), bool)
    for k in range(1, max(step.lengths) + 1):
        if k > 1:
            if len(key) < 2:
                return
            reach = np.where(ok, _look_up(step.reached[k - 1], key), 255)
            reach = np.maximum(reach[:-1], reach[1:])
            key = joined(key[:-1], hashes[k - 1:])
            ok = piece[:-k + 1] == piece[k - 1:]
        if k in step.lengths:
            at = np.flatnonzero(ok if k == 1 else ok & step.active(k, key, reach))
            yield k, *_distinct(key[at], at)


_COUNTS = "k int, lang string, phrase string, a long, b long, n long"


class _Chunk:
    """Words of texts that are counted together."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.langs: list[tuple[str, int]] = []
        self.size = self.pieces = 0

    def add(self, lowered: bytes, found: tuple[np.ndarray, ...], langs: list[tuple[str, int]]) -> None:
        start, length, hashes, piece = found
        self.parts.append((start, length, hashes, piece + self.pieces, np.full(len(start), len(self.texts), np.int32)))
        self.texts.append(lowered)
        self.langs += langs
        self.size += len(start)
        self.pieces += (int(piece[-1]) if len(piece) else 0) + 1        # a part starts a piece

    def counts(self, step: Step) -> Iterator[pa.RecordBatch]:
        start, length, plain, piece, part = (np.concatenate(c) for c in zip(*self.parts))
        names = sorted({lang for lang, _ in self.langs})
        size = [n for _, n in self.langs]
        seed = {lang: seed_of(lang) for lang in names}
        hashes = mix(plain ^ np.repeat(np.array([seed[lang] for lang, _ in self.langs], np.uint64), size))
        place = {lang: i for i, lang in enumerate(names)}
        of = np.repeat(np.array([place[lang] for lang, _ in self.langs], np.int32), size)
        signed, end, texts = hashes.view(np.int64), start + length, self.texts
        for k, first, n, key in count_chunk(hashes, piece, step):
            for at in range(0, len(first), 100_000):
                here = first[at:at + 100_000]
                lang = phrase = pa.nulls(len(here), pa.string())
                if k != 2:
                    columns = [[texts[t][a:b] for t, a, b in zip(part[here + j].tolist(), start[here + j].tolist(), end[here + j].tolist())]
                               for j in range(k)]
                    phrase = pa.array(columns[0] if k == 1 else [b" ".join(p) for p in zip(*columns)], pa.binary()).cast(pa.string())
                    lang = pa.DictionaryArray.from_arrays(pa.array(of[here]), pa.array(names)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(here), k, np.int32)), lang, phrase,
                    pa.array(signed[here] if k == 2 else key[at:at + 100_000].view(np.int64)),
                    pa.array(signed[here + 1]) if k == 2 else pa.nulls(len(here), pa.int64()),
                    pa.array(n[at:at + 100_000], pa.int64())], ["k", "lang", "phrase", "a", "b", "n"])


def scan(docs: DataFrame, step: Step) -> DataFrame:
    """(k, lang, phrase, a, b, n) of the active phrases in ``docs`` (lang, text as bytes), added up within chunks.

    ``a`` is the hash of the phrase; pairs have the hashes ``a`` and ``b`` of their words and no lang and phrase.
    """
    sent = docs.sparkSession.sparkContext.broadcast(step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk, step = Words(), _Chunk(), sent.value
        for part in bounded(batches, HASH_BYTES):
            texts = part.column(1).to_pylist()
            # the line break between two texts ends a piece
            lowered = b"\n".join(texts).translate(_LOWER)
            found = words.of(lowered)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
            per_text = np.diff(np.searchsorted(found[0], begins)).tolist()
            chunk.add(lowered, found, list(zip(part.column(0).to_pylist(), per_text)))
            if chunk.size >= CHUNK_WORDS:
                yield from chunk.counts(step)
                chunk = _Chunk()
        if chunk.size:
            yield from chunk.counts(step)
    return docs.mapInArrow(lambda batches: released(run(batches)), _COUNTS)


def _tables(marks: DataFrame, slots: dict[int, int]) -> dict[int, np.ndarray]:
    """For each table the last step of a phrase of each slot, 255 for none.

    ``marks``: table, k, a, b, step.  Tasks make pieces of the tables; the driver puts them together.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded([batch]):
                size = np.array([slots.get(t, 1) for t in part.column("table").to_pylist()], np.uint64)
                first, second = (part.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("a", "b"))
                key = np.where(part.column("k").to_numpy() == 2, joined(first, second), first)
                slot = (key & (size - np.uint64(1))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("table"), pa.array(slot // ROW_SLOTS), pa.array((slot % ROW_SLOTS).astype(np.int32)),
                                                  part.column("step").cast(pa.int32())], ["table", "row", "slot", "step"])
    cells = (marks.select("table", "k", "a", "b", "step").mapInArrow(hashed, "table int, row long, slot int, step int")
             .groupBy("table", "row", "slot").agg(F.max("step").alias("step"))
             .groupBy("table", "row").agg(F.collect_list(F.struct("slot", "step")).alias("cells")))     # at most ROW_SLOTS cells

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.column(2).slice(i, 1).flatten()
                out = np.full(ROW_SLOTS, 255, np.uint8)
                out[cell.field("slot").to_numpy()] = cell.field("step").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([out.tobytes()])],
                                                 ["table", "row", "cells"])
    found = cells.mapInArrow(packed, "table int, row long, cells binary").toArrow()
    out = {t: np.full(n, 255, np.uint8) for t, n in slots.items()}
    for t, row, cell in zip(*(found.column(c).to_pylist() for c in ("table", "row", "cells"))):
        end = min((row + 1) * ROW_SLOTS, slots[t])
        out[t][row * ROW_SLOTS:end] = np.frombuffer(cell, np.uint8)[:end - row * ROW_SLOTS]
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, n) of all phrases with n >= ``least``, (lang, n) words of each language).

    ``docs`` has text and lang; null texts are empty, null languages ``und``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    rows = write_table(rows.where("text is not null and length(text) > 0")
                       .withColumn("shard", F.pmod(F.xxhash64("lang", "text", F.spark_partition_id()), F.lit(shards)).cast("int")),
                       "collocation-shards", "shard")
    state = spark.createDataFrame([], f"{_COUNTS}, start int, reached int")
    words, number = state.select("lang", "n"), 0
    last = {k: -1 for k in range(1, most_words)}       # the last step after which a phrase of k words reached the threshold
    begun = -1                                         # the last step in which a pair began
    tables: dict[int, np.ndarray] = {}                 # of what reached the threshold, by length; 0: of pairs that began
    while True:
        # words are counted for one cycle; k words as long as a shorter phrase became frequent less than a cycle ago
        lengths = ({1} if number < shards else set()) | {
            k for k in range(2, most_words + 1) if last[k - 1] >= 0 and number <= last[k - 1] + shards}
        if begun >= 0 and number < begun + shards:
            lengths.add(2)
        if not lengths:
            break
        step = Step(number, shards, lengths, {k: tables[k] for k in range(1, max(lengths))}, tables.get(0) if 2 in lengths else None)
        new = scan(rows.where(F.col("shard") == number % shards).select("lang", "text"), step)
        seen = Observation()
        state = write_table(_merge(state, new, number, shards, least).observe(seen, *[
            f(F.when(test, value)).alias(f"{name}{k}") for k in range(1, most_words)
            for test in [(F.col("k") == k) & F.col("reached").isNotNull()]
            for name, f, value in (("rows", F.count, F.lit(1)), ("last", F.max, F.col("reached")))],
            F.max(F.when(F.col("k") == 2, F.col("start"))).alias("begun"), F.count(F.when(F.col("k") == 2, F.lit(1))).alias("rows0")),
            f"collocation-counts-{number}")
        if number == shards - 1:
            words = state.where("k = 1").groupBy("lang").agg(F.sum("n").alias("n"))
        found, fresh = seen.get, {}
        for k in range(1, most_words):
            if found[f"last{k}"] == number:
                last[k], fresh[k] = number, found[f"rows{k}"]
        if found["begun"] == number and shards > 1:
            begun, fresh[0] = number, found["rows0"]
        if fresh:
            marks = F.explode(F.array_compact(F.array(
                F.when(F.col("reached").isNotNull(), F.struct(F.col("k").alias("table"), F.col("reached").alias("step"))),
                F.when(F.col("k") == 2, F.struct(F.lit(0).alias("table"), F.col("start").alias("step"))))))
            slots = {t: min(SLOTS[1], max(SLOTS[0], 1 << (SLOTS_EACH * n).bit_length())) for t, n in fresh.items()}
            tables.update(_tables(state.select("k", "a", "b", marks.alias("m")).select("k", "a", "b", "m.*")
                                  .where(F.col("table").isin(list(slots))), slots))
        number += 1
    kept = state.where(F.col("n") >= least)
    word = kept.where("k = 1").select("lang", "phrase", "a")
    pairs = (kept.where("k = 2").select("a", "b", "n")
             .join(word.select("lang", "a", F.col("phrase").alias("x")), "a")
             .join(word.select(F.col("a").alias("b"), F.col("phrase").alias("y")), "b")
             .select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), F.lit(2).alias("k"), "n"))
    counts = kept.where("k <> 2").select("lang", "phrase", "k", "n").unionByName(pairs)
    return write_table(counts, "collocation-phrases"), words


def _merge(state: DataFrame, new: DataFrame, step: int, shards: int, least: int) -> DataFrame:
    """The counts after this step: a phrase takes part in the ``shards`` scans from its first one on.

    A pair's first one is the first with its share of the threshold; pairs stay, so that none begins
    twice.  After the first cycle, other phrases that have seen every shard without reaching the threshold leave.
    """
    both = state.unionByName(new.withColumns({"start": F.lit(step), "reached": F.lit(None).cast("int")}))
    before = F.col("start") < step
    both = (both.groupBy("k", "lang", "phrase", "a", "b")
            .agg(F.sum(F.when(before, F.col("n")).otherwise(0)).alias("old"),
                 F.sum(F.when(before, 0).otherwise(F.col("n"))).alias("new"),
                 F.min("start").alias("start"), F.max("reached").alias("reached")))
    share = (F.col("k") != 2) | (F.col("start") < step) | (F.col("new") >= -(-least // shards))
    n = F.col("old") + F.when(F.col("start") + shards > step, F.col("new")).otherwise(0)
    out = both.where(share).select("k", "lang", "phrase", "a", "b", n.alias("n"), "start", "reached")
    out = out.withColumn("reached", F.when(F.col("reached").isNotNull(), F.col("reached")).when(F.col("n") >= least, F.lit(step)))
    # rare words stay to the end of their cycle: the sum of all words is the size of the language
    done = ((F.col("k") == 1) & F.lit(step >= shards)) | ((F.col("k") > 2) & (F.col("start") + shards - 1 <= step))
    return out.where(~done | (F.col("n") >= least))


def _cuts(k: int) -> list[tuple[int, int]]:
    return [(i, k - i) for i in range(1, k)]


def _piece(parts: Column, start: int, size: int) -> Column:
    return F.array_join(F.slice(parts, start + 1, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, first: int = FIRST,
                 covered: int = COVERED, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` best phrases of each language.

    ``a``, ``l``, ``r`` are the counts of the phrase and of the two sides of its worst cut, ``n`` the
    words of the language.  Phrases of which a longer one makes up ``covered`` percent are left out.
    Empty and null texts have no words; repeated rows count as often as they stand there; columns
    other than ``text`` and ``lang`` are ignored.
    """
    counts, words = phrase_counts(docs, least, most_words, shards)
    parts = F.split("phrase", " ")
    exact = "decimal(38,0)"
    # both sides of a cut occur at least as often as the phrase, so they are in the table too
    sides = counts.select("lang", F.col("phrase").alias("side"), F.col("n").alias("f"))
    cuts = []
    for k in range(2, most_words + 1):
        for i, rest in _cuts(k):
            cuts.append(F.when(F.col("k") == k, F.struct(F.lit(i).alias("cut"), _piece(parts, 0, i).alias("left"),
                                                         _piece(parts, i, rest).alias("right"))))
    cut = (counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.array_compact(F.array(*cuts))).alias("c"))
           .select("lang", "phrase", "k", "a", "c.*"))
    cut = (cut.join(sides.select("lang", F.col("side").alias("left"), F.col("f").alias("l")), ["lang", "left"])
           .join(sides.select("lang", F.col("side").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    cut = cut.withColumn("score", F.expr(f"(cast(2000000 as {exact}) * a) div (cast(l as {exact}) + r)").cast("long"))
    scored = (cut.groupBy("lang", "phrase", "k", "a")
              .agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst")).select("lang", "phrase", "a", "worst.*"))
    inner = []
    for k in range(3, most_words + 1):
        for size in range(2, k):
            inner += [F.when(F.col("k") == k, _piece(parts, at, size)) for at in range(k - size + 1)]
    longer = (counts.where("k > 2").select("lang", F.col("n").alias("f"), F.explode(F.array_distinct(F.array_compact(F.array(*inner)))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("longest"))) if inner else None
    if longer is not None:
        hidden = F.coalesce(F.expr(f"cast(longest as {exact}) * 100 >= cast(a as {exact}) * {covered}"), F.lit(False))
        scored = scored.join(longer, ["lang", "phrase"], "left").where(~hidden)
    # a partial limit in each task comes before the shuffle, so no task sorts a whole language
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)
    return top.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), phrases AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM places, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(w)
), counts AS (
    SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL
), words AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), frequent AS (
    SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE f >= 30
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, s.cut, x.f AS l, y.f AS r,
           CAST((CAST(2000000 AS HUGEINT) * c.f) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
    FROM frequent c, (VALUES (1), (2), (3)) AS s(cut), frequent x, frequent y
    WHERE c.k > s.cut
      AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:s.cut], ' ')
      AND y.lang = c.lang AND y.phrase = array_to_string(c.w[s.cut + 1:], ' ')
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_phrases AS (
    SELECT c.lang, array_to_string(c.w[p.i:p.i + z.size - 1], ' ') AS phrase, max(c.f) AS longest
    FROM frequent c, (VALUES (1), (2), (3)) AS p(i), (VALUES (2), (3)) AS z(size)
    WHERE z.size < c.k AND p.i + z.size - 1 <= c.k GROUP BY 1, 2
), kept AS (
    SELECT s.* FROM scored s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.phrase = s.phrase
    WHERE i.longest IS NULL OR CAST(100 AS HUGEINT) * i.longest < CAST(80 AS HUGEINT) * s.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, w.n, score
FROM kept k JOIN words w ON w.lang = k.lang
QUALIFY rank <= 2000
"""
