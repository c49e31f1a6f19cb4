"""Deduplication of repeated runs of words, by winnowing, and of runs of whole lines.

Runs of words (``dedup_passages``): a run of ``min_words`` words may begin and end
anywhere, also inside lines.  Its fingerprint is the smallest hash of the grams of
half its words that it holds, so equal runs have equal fingerprints and about
one word in 13 begins one.  Fingerprints that occur once leave; a map of the others
goes to a second reading, which writes the stretches of runs that follow each other
and have the same one.  Equal stretches meet at their first place; inside a repeat
all are equal.  Only where a fingerprint has unequal stretches, as at the edges of
repeats, the runs of each stretch's first place are written one by one and meet at
their first place.  Words in a run that stood earlier are deleted: a longer repeat
is the union of its runs, whatever its edges.

Runs of lines (``dedup_lines``): a window is a shortest run of lines that holds ``min_words`` words, taken from
every line to the right and to the left.  Windows are matched whole, by a print of
all their lines; no match is extended.  The smallest line hash of a window is its
fingerprint and only filters: windows whose fingerprint begins at one line only
leave before prints are compared, but windows of one text that overlap often share
one.  Equal windows meet at their first position, and lines of a window that stood
earlier are deleted.  Every line of a repeated run of ``min_words`` words lies in
such a window, so whole runs go, also those longer than a window.

No pairs of places are made: each window meets the first place of the same
window only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import WordHashes, map_batches, mix, slices, table
from tillroll.session import write_table

MIN_WORDS = 50
#: Bits of the map of fingerprints that occur twice: so many for each, and at most.  A wrong bit costs time only.
BITS_EACH, MAP_BITS = 16, 1 << 29
#: Bits of a piece of the map, as Spark's bitmap functions have them.
PIECE_BITS = 1 << 15
#: Bytes of text whose words are hashed at once; arrays of some 15 numbers a word are made of them.
SLICE_BYTES = 1 << 19
#: Multipliers of the two hashes of a run; odd, so that they have inverses.
BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def windows(text: str, min_words: int) -> list[tuple[int, int, int, bytes]]:
    """(first line, last line, fingerprint, print of the window) of each window; blank lines count for nothing."""
    at, digests, sizes = [], [], []
    for i, line in enumerate(text.split("\n")):
        w = line.encode("utf-8", "replace").split()
        if w:
            at.append(i)
            sizes.append(len(w))
            digests.append(xxhash.xxh3_128_digest(b" ".join(w)))
    total = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if total[-1] < min_words:
        return []
    n = len(sizes)
    last = np.searchsorted(total, total[:n] + min_words) - 1            # left-anchored: i .. last[i]
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1   # right-anchored: first[j] .. j
    runs = {(i, int(j)) for i, j in enumerate(last) if j < n} | {(int(i), j) for j, i in enumerate(first) if i >= 0}
    marks = np.frombuffer(b"".join(digests), np.int64)[::2]
    joined = b"".join(digests)
    return [(at[i], at[j], int(marks[i:j + 1].min()), xxhash.xxh3_128_digest(joined[16 * i:16 * (j + 1)]))
            for i, j in sorted(runs)]


def _window_rows(docs: DataFrame, min_words: int) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text"))):
            for a, b, fp, print_ in windows(text or "", min_words):
                w1, w2 = np.frombuffer(print_, np.int64)
                out.append((doc, mark, a, b, fp, int(w1), int(w2)))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*out)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["doc_id", "mark", "a", "b", "fp", "w1", "w2"])
    return map_batches(docs.select(F.col("doc_id").cast("long"), _mark().alias("mark"), "text"), rows,
                       "doc_id long, mark long, a int, b int, fp long, w1 long, w2 long")


def _mark() -> Column:
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _place() -> Column:
    """Order of places: doc_id (null last), then the text's mark, then the line."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "a")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, runs: array of (a, b) line ranges to delete) for rows with a later repeated run."""
    found = write_table(_window_rows(docs, min_words).withColumn("place", _place()).drop("doc_id", "mark"), "windows")
    # fingerprints of windows that begin at more than one line: a filter
    shared = (found.groupBy("fp").agg(F.min("place").alias("x"), F.max("place").alias("y"))
              .where("x != y").select("fp"))
    seeds = found.join(shared, "fp", "left_semi")
    first = (seeds.groupBy("fp", "w1", "w2").agg(F.min("place").alias("x"), F.max("place").alias("y"))
             .where("x != y").select("fp", "w1", "w2", F.col("x").alias("origin")))
    later = seeds.join(first, ["fp", "w1", "w2"]).where("place > origin")
    return (later.groupBy("place.doc_id", "place.mark")
            .agg(F.sort_array(F.collect_set(F.struct(F.col("place.a").alias("a"), "b"))).alias("runs")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) plus ``ld_lines``, ``ld_deleted`` and ``ld_text``.

    A run of lines of at least ``min_words`` words that stood earlier (smaller
    doc_id, or higher up in the same text) is deleted; lines are compared with
    their blanks collapsed.  Blank lines inside a deleted run go with it, all
    other lines and their order stay.  Null text: 0 lines, text null; a null
    doc_id stands after all others; rows equal in doc_id and text are the same
    place, each is treated like the other; rows that share a doc_id are ordered
    by a hash of their text.  Every input row gives one row.
    """
    runs = repeated_lines(docs, min_words).select(
        F.col("doc_id").alias("__ld_doc"), F.col("mark").alias("__ld_mark"), F.col("runs").alias("__ld_runs"))
    here = docs.join(runs, F.col("doc_id").cast("long").eqNullSafe(F.col("__ld_doc")) & (_mark() == F.col("__ld_mark")), "left")
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.exists("__ld_runs", lambda r: (r["a"] <= i) & (i <= r["b"])))
    out = here.withColumn("ld_text", F.when(F.col("__ld_runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(F.col(c), "\n", -1)))     # noqa: E731
    changed = F.col("__ld_runs").isNotNull()
    return (out.withColumn("ld_lines", count("text").cast("long"))
            .withColumn("ld_deleted", F.when(changed, F.col("ld_lines") - F.size(kept)).otherwise(0).cast("long"))
            .drop("__ld_doc", "__ld_mark", "__ld_runs"))


class _Runs:
    """Hashes of the words of texts, one text after the other, and of all runs of so many words."""

    def __init__(self, texts: pa.Array):
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        start, _, self.words = WordHashes(_BLANK).of(b"\n".join(raw))
        size = np.diff(np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in raw)])))
        self.text = np.repeat(np.arange(len(raw)), size)
        self.at = np.arange(len(self.words)) - np.repeat(np.cumsum(size) - size, size)

    def grams(self, width: int, base: int) -> np.ndarray:
        """Hash of the words that follow each place, by sums over powers of an odd number modulo 2^64."""
        n = len(self.words)
        power = lambda b, count: np.cumprod(np.append(np.uint64(1), np.full(max(0, count - 1), b, np.uint64)))[:count]     # noqa: E731
        total = np.append(np.uint64(0), np.cumsum(self.words * power(base, n), dtype=np.uint64))
        return mix((total[width:] - total[:n + 1 - width]) * power(pow(base, -1, 1 << 64), n + 1 - width))

    def marked(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places where a run of a text starts, the fingerprint of each, fingerprints by their own places)."""
        if len(self.words) < min_words:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        width = (min_words + 1) // 2
        grams = self.grams(width, BASES[0])
        inside = self.text[:len(self.words) - min_words + 1] == self.text[min_words - 1:]
        least = _over(grams, min_words - width + 1, np.minimum)
        # a gram is a fingerprint if it is the least of a run that holds it
        wide = np.concatenate([np.zeros(min_words - width, np.uint64), np.where(inside, least, 0).astype(np.uint64),
                               np.zeros(min_words - width, np.uint64)])
        own = grams[_over(wide, min_words - width + 1, np.maximum) == grams]
        return np.flatnonzero(inside), least[inside], own


def _over(x: np.ndarray, width: int, fn: np.ufunc) -> np.ndarray:
    """fn over each ``width`` values that follow each other, by doubling."""
    have = 1
    while have < width:
        more = min(have, width - have)
        x = fn(x[:len(x) - more], x[more:])
        have += more
    return x


def _bit_map(ids: DataFrame) -> np.ndarray:
    """Bit map of the numbers in a table of one column; tasks make its pieces, at most 64 MB reach the driver."""
    bits = min(MAP_BITS, max(PIECE_BITS, 1 << (BITS_EACH * ids.count()).bit_length()))
    bit = F.col(ids.columns[0]).bitwiseAND(F.lit(bits - 1))
    pieces = (ids.select(F.shiftright(bit, PIECE_BITS.bit_length() - 1).alias("piece"), bit.bitwiseAND(F.lit(PIECE_BITS - 1)).alias("bit"))
              .groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow())
    out = np.zeros(bits // 8, np.uint8)
    for piece, found in zip(pieces.column("piece").to_pylist(), pieces.column("bits").to_pylist()):
        out[piece * PIECE_BITS // 8:(piece + 1) * PIECE_BITS // 8] = np.frombuffer(found, np.uint8)
    return out


def _in_map(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    bit = (ids & np.uint64(8 * len(known) - 1)).astype(np.int64)
    return known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0


def _stretches(docs: DataFrame, min_words: int) -> DataFrame:
    """(fp, h, place, n, runs, again): runs that follow each other and have the same fingerprint, if it occurs more than
    once; ``h`` is a print of the stretch, ``runs`` one of each run, ``again`` whether two of them are equal."""
    def marks(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, c = np.unique(_Runs(batch.column(0)).marked(min_words)[2], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(c)], ["fp", "c"])
    shared = write_table(map_batches(docs.select("text"), marks, "fp long, c long", SLICE_BYTES).groupBy("fp")
                         .agg(F.sum("c").alias("c")).where("c > 1").select("fp"), "fingerprints")
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(shared))
    longest = min_words - (min_words + 1) // 2 + 1

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        runs = _Runs(batch.column("text"))
        start, fp, _ = runs.marked(min_words)
        some = _in_map(fp, sent.value)
        start, fp = start[some], fp[some]
        if not len(start):
            return None
        prints, text = runs.grams(min_words, BASES[1])[start], runs.text[start]
        new = np.concatenate([[True], (np.diff(start) != 1) | (fp[1:] != fp[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(new)
        inside = np.arange(len(start)) - np.repeat(first, np.diff(first, append=len(start)))
        inside %= longest                                     # equal words can make a stretch of any length
        first = np.flatnonzero(inside == 0)
        n = np.diff(first, append=len(start))
        factor = np.cumprod(np.full(longest, BASES[0], np.uint64))
        h = mix(np.add.reduceat(prints * factor[inside], first) + n.astype(np.uint64))
        owner = np.repeat(np.arange(len(first)), n)
        order = np.lexsort((prints, owner))
        same = (np.diff(prints[order]) == 0) & (np.diff(owner[order]) == 0)
        again = np.zeros(len(first), bool)
        again[owner[order][1:][same]] = True
        row = pa.array(text[first])
        offsets = pa.array(np.append(first, len(start)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(row), batch.column("mark").take(row), pa.array(runs.at[start[first]], pa.int32()),
             pa.array(fp[first].view(np.int64)), pa.array(h.view(np.int64)), pa.array(n, pa.int32()),
             pa.ListArray.from_arrays(offsets, pa.array(prints.view(np.int64))), pa.array(again)],
            ["doc_id", "mark", "a", "fp", "h", "n", "runs", "again"])
    found = map_batches(docs.select(F.col("doc_id").cast("long"), _mark().alias("mark"), "text"), rows,
                        "doc_id long, mark long, a int, fp long, h long, n int, runs array<long>, again boolean", SLICE_BYTES)
    return write_table(found.withColumn("place", _place()).drop("doc_id", "mark", "a"), "stretches")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, runs: array of a * 2^32 + n): words a where a run of ``min_words`` begins that stood earlier, and how many
    such runs begin there one word after the other."""
    found = _stretches(docs, min_words)
    first = write_table(found.groupBy("fp", "h").agg(F.min("place").alias("origin"), F.max("place").alias("end"),
                                                     F.max("again").alias("again")), "first_stretches")
    later = (found.select("fp", "h", "place", "n").join(first.where("origin != end").select("fp", "h", "origin"), ["fp", "h"])
             .where("place > origin").select("place.doc_id", "place.mark", "place.a", "n"))
    open_ = write_table(first.groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.max("again").alias("again"))
                        .where("c > 1 or again").select("fp"), "open_fingerprints")
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(open_))

    def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_in_map(batch.column("fp").to_numpy().view(np.uint64), sent.value)))
    flat = found.select("fp", "h", "place.*", "runs")
    origins = first.select("fp", "h", "origin.*")
    single = (map_batches(flat, opened, flat.schema.simpleString()[len("struct<"):-1])
              .withColumn("__doc", F.coalesce("doc_id", F.lit(0)))
              .join(origins.select("fp", "h", "last", F.coalesce("doc_id", F.lit(0)).alias("__doc"), "mark", "a"),
                    ["fp", "h", "last", "__doc", "mark", "a"], "left_semi")
              .select("fp", "doc_id", "mark", F.col("a").alias("from"), F.posexplode("runs").alias("i", "run"))
              .select("fp", "run", "doc_id", "mark", (F.col("from") + F.col("i")).alias("a")))
    # a run is here once for each stretch that it is in, so copies make no group large
    edges = (single.withColumn("origin", F.min(_place()).over(Window.partitionBy("fp", "run"))).where(_place() > F.col("origin"))
             .select("doc_id", "mark", "a", F.lit(1).alias("n")))
    run = F.shiftleft(F.col("a").cast("long"), 32) + F.col("n")
    return later.union(edges).groupBy("doc_id", "mark").agg(F.collect_set(run).alias("runs"))


def without_runs(text: str, runs: np.ndarray, min_words: int) -> tuple[str, int]:
    """The text without the runs of words (for each a * 2^32 + n the n that begin at word a and those after it), and how many lines went with them.

    A line all of whose words are deleted goes, and so do blank lines inside a
    run; of other lines the deleted words go with the blanks that follow them,
    or that stand before them at the line's end.
    """
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff((~_BLANK[data]).astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n, starts, counts = len(begins), runs >> 32, runs & 0xFFFFFFFF

    def covered(width: int) -> np.ndarray:
        step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + counts - 1 + width, minlength=n + 1)
        return np.cumsum(step)[:n] > 0
    gone, joined = covered(min_words), covered(min_words - 1)         # joined: a run goes on after the word
    line_ends = np.append(np.flatnonzero(data == 10), len(raw))
    last = np.searchsorted(begins, line_ends)                         # words up to each line's end
    first = np.concatenate([[0], last[:-1]])
    cut = np.concatenate([[0], np.cumsum(gone)])
    cut = cut[last] - cut[first]
    blank = (first == last) & (first > 0) & (last < n)
    drop = np.where(first < last, cut == last - first, blank & joined[np.maximum(first - 1, 0)])
    out, from_ = [], 0
    for i, to in enumerate(line_ends.tolist()):
        if not drop[i]:
            kept, end = [], to
            if cut[i]:
                for j in range(int(first[i]), int(last[i])):
                    if gone[j]:
                        if j == first[i] or not gone[j - 1]:
                            kept.append(raw[from_:begins[j]])
                        from_ = int(begins[j + 1]) if j + 1 < last[i] else end
            kept.append(raw[from_:end])
            line = b"".join(kept)
            out.append(line.rstrip() if cut[i] and gone[last[i] - 1] else line)
        from_ = to + 1
    return b"\n".join(out).decode("utf-8", "replace"), int(drop.sum())


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) plus ``ld_lines``, ``ld_deleted`` and ``ld_text``.

    Every run of at least ``min_words`` words that stood earlier (smaller doc_id,
    or further up in the same text) is deleted, wherever in lines it begins and
    ends; ``ld_deleted`` counts the lines that went whole.  Words are runs of
    characters other than blanks.  Other rules are those of ``dedup_lines``.
    """
    runs = write_table(repeated_runs(docs, min_words).select(
        F.col("doc_id").alias("__ld_doc"), F.col("mark").alias("__ld_mark"), F.col("runs").alias("__ld_runs")), "repeated")
    # texts without a repeat are not shuffled: a map of the others holds every one of them, and a few more
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(runs.select(F.xxhash64("__ld_doc", "__ld_mark"))))

    @F.arrow_udf("boolean")
    def known(key: pa.Array) -> pa.Array:
        return pa.array(_in_map(key.to_numpy(zero_copy_only=False).view(np.uint64), sent.value))
    marked = docs.withColumn("__ld_known", known(F.xxhash64(F.col("doc_id").cast("long"), _mark())))
    some = marked.where("__ld_known").drop("__ld_known")
    here = some.join(runs, F.col("doc_id").cast("long").eqNullSafe(F.col("__ld_doc")) & (_mark() == F.col("__ld_mark")), "left")
    here = here.unionByName(marked.where("not __ld_known").drop("__ld_known"), allowMissingColumns=True)

    @F.arrow_udf("text string, deleted long")
    def cut(text: pa.Array, runs: pa.Array) -> pa.Array:
        found = [(None, None) if t is None or not len(r) else without_runs(t, r, min_words)
                 for t, r in zip((t.as_py() for t in text), slices(runs))]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                                          ["text", "deleted"])
    changed = F.col("__ld_runs").isNotNull()
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return (here.withColumn("__ld_cut", cut(F.when(changed, F.col("text")), "__ld_runs"))
            .withColumn("ld_text", F.when(changed, F.col("__ld_cut.text")).otherwise(F.col("text")))
            .withColumn("ld_lines", lines.cast("long"))
            .withColumn("ld_deleted", F.coalesce("__ld_cut.deleted", F.lit(0)).cast("long"))
            .drop("__ld_doc", "__ld_mark", "__ld_runs", "__ld_cut"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, and size and digest of the text that stays."""
    out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("ld_text", F.lit(""))
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_deleted").alias("n_deleted"),
                      F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))
