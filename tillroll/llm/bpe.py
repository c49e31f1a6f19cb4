"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Frequent words (by a count over all documents) are merged once on the driver and
compiled into a minimal automaton: equal suffixes share states, and numbers on
its arcs add up to a word's place in the table of id sequences.  The automaton,
the merges and the vocabulary are one file in the shared folder; executors fetch
it once and memory-map it.  A batch's words walk the automaton together; words
that it does not hold are merged exactly, so the lexicon never changes a result.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import lists, map_batches, most_frequent, released, slices, table
from tillroll.session import ensure_checkpoint_dir, write_table

#: Frequent words in the automaton.
LEXICON_WORDS = 1 << 17
#: Words whose ids a task keeps.
CACHE = 250_000
#: Bytes of an Arrow batch that are worked on at once, by the batch's mean row.
SLICE_BYTES = 2 << 20
#: A word longer than this is not looked up.
LONGEST = 32

BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words with their leading blank, and runs of blanks, as the pre-tokenizer's rule divides them.
WORDS = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: A place of the table of pairs that holds none.
_NO_PAIR = np.int64(np.iinfo(np.int64).max)
#: Words whose pieces are plain by the rule: letters below U+02B0, with or without a blank before them, then stops.
PLAIN = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u02af]+)([.,;:!?]*)")
#: The rule inside one word.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merges and tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.byte_ids = np.zeros(256, np.int32)
        size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens = [b""] * size
        for token, i in ids.items():
            self.tokens[i] = bytes(letters[c] for c in token)
            if len(token) == 1:
                self.byte_ids[letters[token]] = i
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int32).reshape(-1, 3)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


class Merges:
    """Exact merging of many short pieces at once: lowest rank first, the leftmost of equals first."""

    #: Pieces up to this many bytes share a grid of their width; longer ones are merged one by one.
    WIDTHS = (4, 8, 12, 16, 24, 32, 64)
    #: Rows of a grid.
    ROWS = 8192

    def __init__(self, merges: np.ndarray):
        """merges: rows (left, right, merged) in order of rank."""
        keys = (merges[:, 0].astype(np.int64) << 32) | merges[:, 1]
        # pairs in an open hash table: a look-up is a multiplication and about one probe
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, _NO_PAIR)
        self.rank = np.full(1 << self.bits, len(keys), np.int32)
        self.new = np.zeros(1 << self.bits, np.int32)
        self.none = np.int32(len(keys))
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.keys[slot] == _NO_PAIR
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(rest), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.rank[slot[put]], self.new[slot[put]] = keys[rest[put]], rest[put], merges[rest[put], 2]
            rest, slot = rest[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs; rank ``none`` where they do not merge."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(np.ascontiguousarray(key))
        there = self.keys[slot]
        open_ = np.flatnonzero((there != key) & (there != _NO_PAIR))
        if len(open_):
            flat, want = slot.reshape(-1), key.reshape(-1)
            while len(open_):
                flat[open_] = (flat[open_] + 1) & ((1 << self.bits) - 1)
                there = self.keys[flat[open_]]
                open_ = open_[(there != want[open_]) & (there != _NO_PAIR)]
            there = self.keys[slot]
        return np.where(there == key, self.rank[slot], self.none), self.new[slot]

    def merge(self, pieces: list[list[int]]) -> list[tuple[int, ...]]:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, size = self.merge_flat(np.fromiter(chain.from_iterable(pieces), np.int32, int(size.sum())), size)
        ends = np.cumsum(size).tolist()
        ids = ids.tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def merge_flat(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces that stand one after the other, merged."""
        start = np.cumsum(size) - size
        out, left = ids.copy(), size.copy()
        below = 1
        for width in self.WIDTHS:
            rows = np.flatnonzero((size > below) & (size <= width))
            below = width
            for at in range(0, len(rows), self.ROWS):
                part = rows[at:at + self.ROWS]
                self._grid(ids, start[part], size[part], width, part, out, left)
        for i in np.flatnonzero(size > below).tolist():
            done = self._long(ids[start[i]:start[i] + size[i]].tolist())
            out[start[i]:start[i] + len(done)] = done
            left[i] = len(done)
        return out[_ranges(start, left)], left

    def _grid(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, rows: np.ndarray,
              out: np.ndarray, left: np.ndarray) -> None:
        """Merges pieces as rows of a grid; a row that is done goes to its place in ``out``."""
        grid = np.full((len(rows), width + 1), -1, np.int32)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        grid[np.repeat(np.arange(len(rows)), size), at] = ids[_ranges(start, size)]
        rank, _ = self._find(grid[:, :-1], grid[:, 1:])
        while len(rows):
            j = rank.argmin(1)
            here = np.arange(len(rows))
            done = rank[here, j] == self.none
            if done.any():
                lines = grid[done]
                held = lines >= 0
                left[rows[done]] = n = held.sum(1)
                out[_ranges(start[done], n)] = lines[held]
                more = ~done
                rows, start, grid, rank, j = rows[more], start[more], grid[more], rank[more], j[more]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            _, new = self._find(grid[here, j], grid[here, j + 1])
            columns = np.arange(grid.shape[1] - 1)
            grid = np.take_along_axis(grid, columns + (columns > j[:, None]), 1)
            grid[here, j] = new
            columns = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, columns + (columns > j[:, None]), 1)
            if rank.shape[1] == 0:
                rank = np.full((len(rows), 1), self.none, np.int32)
                grid = np.concatenate([grid, np.full((len(rows), 1), -1, np.int32)], 1)
                continue
            right = np.minimum(j, rank.shape[1] - 1)
            after = j < rank.shape[1]
            found, _ = self._find(new, grid[here, right + 1])
            rank[here[after], j[after]] = found[after]
            before = j > 0
            found, _ = self._find(grid[here, np.maximum(j - 1, 0)], new)
            rank[here[before], j[before] - 1] = found[before]

    def _long(self, ids: list[int]) -> tuple[int, ...]:
        """A long piece as a linked list with a heap of its pairs."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ids, heap = list(ids), []

        def push(i: int, j: int) -> None:
            key = (ids[i] << 32) | ids[j]
            at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.keys[at] not in (key, _NO_PAIR):
                at = (at + 1) & ((1 << self.bits) - 1)
            if self.keys[at] == key:
                heapq.heappush(heap, (int(self.rank[at]), i, j, ids[i], ids[j], int(self.new[at])))
        for i in range(len(ids) - 1):
            push(i, i + 1)
        while heap:
            _, i, j, a, b, new = heapq.heappop(heap)
            if ids[i] != a or ids[j] != b or after[i] != j:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return tuple(x for x in ids if x >= 0)


def compile_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimal automaton of sorted distinct words: arc keys (state * 256 + byte), targets, outputs, final flags.

    Words arrive in order; states that no later word can change are replaced by
    an equal one that exists.  An arc's output is the number of words that sort
    before its branch, so outputs along a word add up to its place.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]                                       # states along the last word
    last = b""

    def settle(keep: int) -> None:
        while len(path) > keep + 1:
            state, label = path.pop(), last[len(path) - 1]
            key = (final[state], tuple(arcs[state].items()))
            arcs[path[-1]][label] = known.setdefault(key, state)

    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        settle(same)
        for label in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][label] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0)

    number, order, count = {0: 0}, [0], {}
    for state in order:                              # breadth first: the states that are left
        for target in arcs[state].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)

    def total(root: int) -> None:
        todo = [root]
        while todo:
            state = todo[-1]
            open_ = [t for t in arcs[state].values() if t not in count]
            if open_:
                todo += open_
            else:
                count[state] = final[state] + sum(count[t] for t in arcs[state].values())
                todo.pop()
    total(0)
    rows = []
    for state in order:
        before = int(final[state])
        for label, target in sorted(arcs[state].items()):
            rows.append((number[state] * 256 + label, number[target], before))
            before += count[target]
    keys, targets, outputs = (np.array(c, k) for c, k in zip(zip(*rows), (np.int64, np.int32, np.int32))) if rows else (
        np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    return keys, targets, outputs, np.array([final[s] for s in order])


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: length of the directory, directory, arrays at offsets of 64."""
    head, at, body = {}, 0, []
    for name, a in arrays.items():
        head[name] = (a.dtype.str, a.shape, at)
        raw = a.tobytes()
        raw += bytes(-len(raw) % 64)
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a packed file, memory-mapped."""
    raw = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(raw[8:8 + n].tobytes()).items():
        size = int(np.dtype(kind).itemsize * np.prod(shape))
        out[name] = raw[8 + n + at:8 + n + at + size].view(kind).reshape(shape)
    return out


class _Numbers(dict):
    """A number for each word, given on first sight; ``new`` are the words that have no ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Lexicon:
    """The mapped file at work: ids of words, bytes of ids."""

    def __init__(self, arrays: dict[str, np.ndarray], special: dict[str, int]):
        self.a = arrays
        self.special = special
        self.at_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.merges = Merges(arrays["merges"])
        self._forget()

    def _forget(self) -> None:
        """Only special tokens have numbers; the ids of word n are ``ids[ends[n]:ends[n + 1]]``."""
        self.known = _Numbers()
        for text in self.special:
            self.known[text]
        self.known.new = []
        self.ids = np.fromiter(self.special.values(), np.int32, len(self.special))
        self.ends = np.arange(len(self.special) + 1)

    def look_up(self, items: list[bytes]) -> np.ndarray:
        """Place of each word in the automaton's order, -1 for others; all words walk at once."""
        a = self.a
        lengths = np.fromiter(map(len, items), np.int64, len(items))
        where = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        grid = np.frombuffer(b"".join(items[i].ljust(LONGEST, b"\0") for i in where), np.uint8).reshape(-1, LONGEST)
        state, place = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        live = np.arange(len(where))
        out = np.full(len(items), -1, np.int64)
        for i in range(LONGEST):
            if not len(live) or not len(a["keys"]):
                break
            key = state[live] * 256 + grid[live, i]
            arc = np.minimum(np.searchsorted(a["keys"], key), len(a["keys"]) - 1)
            ok = a["keys"][arc] == key
            live, arc = live[ok], arc[ok]
            state[live] = a["targets"][arc]
            place[live] += a["outputs"][arc]
            done = lengths[where[live]] == i + 1
            end = live[done]
            end = end[a["final"][state[end]]]
            out[where[end]] = place[end]
            live = live[~done]
        return out

    def merged(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words by merging their pieces."""
        divided = [m.groups() if (m := PLAIN.fullmatch(w)) else PIECES.findall(w) for w in items]
        raw = [p.encode("utf-8", "replace") for ps in divided for p in ps]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, size = self.merges.merge_flat(self.a["byte_ids"][np.frombuffer(b"".join(raw), np.uint8)], size)
        of = np.repeat(np.arange(len(items)), np.fromiter(map(len, divided), np.int64, len(divided)))
        return ids, np.bincount(of, weights=size, minlength=len(items)).astype(np.int64)

    def learn_words(self) -> None:
        """The ids of the words that got numbers since: by the automaton, else by merging."""
        new = self.known.new
        if not new:
            return
        places = self.look_up([w.encode("utf-8", "replace") for w in new])
        held = places >= 0
        first, last = self.a["ends"][np.where(held, places, 0)], self.a["ends"][np.where(held, places + 1, 0)]
        unseen = [new[i] for i in np.flatnonzero(~held).tolist()]
        merged, sizes = self.merged(unseen)
        size = np.where(held, last - first, 0)
        size[~held] = sizes
        ids = np.empty(int(size.sum()), np.int32)
        of = np.repeat(held, size)
        ids[of] = self.a["ids"][_ranges(first[held], size[held])]
        ids[~of] = merged
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        self.known.new = []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text: one number a word, then one gather of all words' ids."""
        if len(self.known) > CACHE:
            self._forget()
        numbers = []
        for text in texts:
            words = WORDS.findall(text or "")
            if self.at_special and text and self.at_special.search(text):
                words = [w for part in self.at_special.split(text) for w in ([part] if part in self.special else WORDS.findall(part))]
            numbers.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        self.learn_words()
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        size = self.ends[number + 1] - self.ends[number]
        ids = self.ids[_ranges(self.ends[number], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([len(n) for n in numbers], dtype=np.int64)] if numbers else []
        return np.split(ids, ends[:-1]) if numbers else []

    def decode(self, ids: np.ndarray) -> str:
        start, end = self.a["token_ends"][ids], self.a["token_ends"][ids + 1]
        return self.a["token_bytes"][_ranges(start, end - start)].tobytes().decode("utf-8", "replace")


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS) -> list[str]:
    """At most ``limit`` of the most frequent words of all documents (ties are in or out together), of those that repeat."""
    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        c: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            c.update(WORDS.findall(text or ""))
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["w", "n"])
    counts = map_batches(docs.select("text"), counted, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r.w for r in most_frequent(write_table(counts.where("n > 1"), "frequent"), "n", limit).select("w").collect()]


def build(vocabulary: Vocabulary, words: list[str]) -> dict[str, np.ndarray]:
    """Arrays of the packed file for a vocabulary and its frequent words."""
    ends = np.concatenate([[0], np.cumsum([len(t) for t in vocabulary.tokens])]).astype(np.int64)
    arrays = {"merges": vocabulary.merges, "byte_ids": vocabulary.byte_ids, "token_ends": ends,
              "token_bytes": np.frombuffer(b"".join(vocabulary.tokens), np.uint8)}
    by_bytes = {w.encode("utf-8", "replace"): w for w in words}
    items = sorted(b for b in by_bytes if 0 < len(b) <= LONGEST)
    plain = Lexicon(arrays, {})
    ids, size = plain.merged([by_bytes[b] for b in items])
    arrays["keys"], arrays["targets"], arrays["outputs"], arrays["final"] = compile_automaton(items)
    arrays["ids"] = ids
    arrays["ends"] = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return arrays


class Codec:
    """A packed file in the shared folder, known to all executors."""

    def __init__(self, name: str, special: dict[str, int]):
        self.name, self.special = name, special

    def open(self) -> Lexicon:
        return Lexicon(mapped(SparkFiles.get(self.name)), self.special)


def publish(spark: SparkSession, vocabulary: Vocabulary, words: list[str]) -> Codec:
    """Writes the packed file to ``spark.checkpoint.dir`` and names it to the executors."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = ensure_checkpoint_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path, True)
    out.write(pack(build(vocabulary, words)))
    out.close()
    spark.sparkContext.addFile(files.makeQualified(path).toString())
    return Codec(name, vocabulary.special)


def codec_for(docs: DataFrame, vocabulary: str | None = None, lexicon_words: int = LEXICON_WORDS) -> Codec:
    return publish(docs.sparkSession, Vocabulary(vocabulary or default_vocabulary()), frequent_words(docs, lexicon_words))


def encode(docs: DataFrame, codec: Codec, key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(key, ids array<int>) of every whole ``text``; a null text is an empty one, a null key stays null.

    ``decoded`` adds the text that the ids decode to, in the same pass.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = codec.open()
        for b in batches:
            rows = max(1, min(1000, SLICE_BYTES * b.num_rows // max(1, b.nbytes)))
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids = lexicon.encode(part.column(1).to_pylist())
                columns = [part.column(0), lists(ids, pa.int32())]
                if decoded:
                    columns.append(pa.array([lexicon.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][:len(columns)])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(lambda batches: released(run(batches)), f"{key} {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, codec: Codec, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded string): the text of each id sequence; special ids are written out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = codec.open()
        for b in batches:
            rows = max(1, min(1000, SLICE_BYTES * b.num_rows // max(1, b.nbytes)))
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                texts = [lexicon.decode(ids) for ids in slices(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 [key, "ids", "decoded"])
    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, digest of the ids, digest of the decoded text."""
    codec = codec_for(docs, vocabulary)
    return encode(docs, codec, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
