"""Operators on texts: brute force, exact round trips, edge rows (null, empty, long, repeated, extra columns)."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tillroll.llm import attention, bpe, jaccard, lines, mixing, quality, toxicity
from tillroll.llm.common import shingle_set, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, tokens string"


def frame(spark, rows):
    """rows: (doc_id, text[, source]); more columns carry names that the operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "k", 7, "t") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "Ä ö <|endoftext|> x y  z\n\n"),
        (6, "word " * 30_000)]


# --- words, shingles ---------------------------------------------------------------
def test_words_follow_the_rule():
    import re
    text = "A b C\x0bd\x1ce\r\nF  É é"
    expected = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    assert [w.decode() for w in words(text)] == expected


def test_short_texts_are_one_shingle():
    assert len(shingle_set("a b")) == 1 and len(shingle_set("")) == 0 and len(shingle_set("a b c d e f")) == 2
    assert shingle_set("a b")[0] != shingle_set("a b b")[0]


# --- 10: Jaccard join ----------------------------------------------------------------
def brute_components(rows, percent=80):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and (
                    100 * common >= percent * (len(sets[a]) + len(sets[b]) - common)):
                parent[find(a)] = find(b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted(((d, len(sets[i]), low.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows)), key=repr)


def near_rows():
    r = random.Random(5)
    rows, n = [], 100
    for _ in range(25):
        base = sentence(r, r.randrange(3, 120)).split()
        for _ in range(r.randrange(1, 7)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"x{r.randrange(50)}"
            rows.append((n, " ".join(w)))
            n += 1
    r.shuffle(rows)
    return rows


def test_jaccard_equals_brute_force(spark):
    rows = near_rows() + EDGE
    got = jaccard.near_duplicates(frame(spark, rows))
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)


def test_jaccard_blocks_and_chains(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)          # groups span several blocks and parts
    r = random.Random(9)
    base = sentence(r, 100).split()
    rows = []
    for i in range(40):                                # a chain: neighbours are similar, ends are not
        rows.append((i, " ".join(base)))
        base[i] = f"c{i}"
    got = jaccard.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)


def test_jaccard_empty_table(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


def test_keep_one_of_each_group(spark):
    text = "the same seven words stand here again"
    rows = [(9, text), (3, text), (3, text), (5, "something else that is quite different"), (None, text), (7, None), (8, "")]
    kept = jaccard.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(3, text), (5, rows[3][1]), (7, None), (8, "")]
    assert kept.where("doc_id is null").count() == 1


def test_keep_one_tells_texts_of_one_id_apart(spark):
    text = "the same seven words stand here again"
    rows = [(1, text), (2, text), (2, "clean and unrelated words that nobody else has"), (4, "one text of a repeated id"),
            (4, "another text under the same number"), (4, "another text under the same number"), (5, text), (5, "five is also this"),
            (6, "six has this here and"), (6, "six has this here and "), (6, "near copies under one single id are one group a b c d e f g h i j k l m n o p"),
            (6, "near copies under one single id are one group a b c d e f g h i j k l m n o p q")]
    kept = sorted((r.doc_id, r.text.strip()) for r in jaccard.keep_one(frame(spark, rows)).collect())
    near = [k for k in kept if k[1].startswith("near")]
    assert len(near) == 1
    assert [k for k in kept if k not in near] == [(1, text), (2, rows[2][1]), (4, rows[4][1]), (4, rows[3][1]), (5, rows[7][1]), (6, rows[8][1])]


# --- 7: line dedup --------------------------------------------------------------------
def brute_lines(rows, min_words):
    """Texts after deleting every window that stood at a smaller place; places by (null last, id, text's mark, line)."""
    def spans(text):
        at = [(i, tuple(x.split())) for i, x in enumerate((text or "").split("\n")) if x.split()]
        out = set()
        for a in range(len(at)):
            for b in range(a, len(at)):
                sizes = [len(w) for _, w in at[a:b + 1]]
                if sum(sizes) >= min_words and (sum(sizes[1:]) < min_words or sum(sizes[:-1]) < min_words):
                    out.add((at[a][0], at[b][0], tuple(w for _, w in at[a:b + 1])))
        return out
    first = {}
    for doc, mark, text in rows:
        for a, _, key in spans(text):
            place = (doc is None, doc or 0, mark, a)
            first[key] = min(place, first.get(key, place))
    result = []
    for doc, mark, text in rows:
        gone = {i for a, b, key in spans(text) if first[key] < (doc is None, doc or 0, mark, a) for i in range(a, b + 1)}
        kept = [x for i, x in enumerate(text.split("\n")) if i not in gone] if text is not None else None
        result.append((doc, len(gone), None if kept is None else "\n".join(kept)))
    return sorted(result, key=repr)


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(3)
    pool = [sentence(r, r.randrange(1, 9), 30) for _ in range(12)]
    rows = [(i, "\n".join(r.choice([*pool, "", " ", sentence(r, 4)]) for _ in range(r.randrange(1, 14)))) for i in range(50)]
    docs = frame(spark, rows + EDGE)
    marks = {(d, t): m for d, t, m in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, ''))").collect()}
    for n in (3, 12):
        got = sorted(((x.doc_id, x.ld_deleted, x.ld_text) for x in lines.dedup_lines(docs, n).collect()), key=repr)
        assert got == brute_lines([(d, marks[d, t], t) for d, t in rows + EDGE], n)


def test_line_dedup_keeps_the_first_long_passage(spark):
    r = random.Random(1)
    passage = "\n".join(sentence(r, 20) for _ in range(3))
    docs = frame(spark, [(1, "head one\n" + passage), (2, passage + "\ntail two"), (3, "short\nshort"), (4, "short")])
    got = {x.doc_id: x.ld_text for x in lines.dedup_lines(docs).collect()}
    assert got == {1: "head one\n" + passage, 2: "tail two", 3: "short\nshort", 4: "short"}


def brute_passages(rows, n):
    """Words that stay, in order, by (doc_id, mark), after deleting every run of n words that stood at a smaller place."""
    first = {}
    for doc, mark, text in rows:
        w = (text or "").split()
        for a in range(len(w) - n + 1):
            place = (doc is None, doc or 0, mark, a)
            first[tuple(w[a:a + n])] = min(place, first.get(tuple(w[a:a + n]), place))
    out = []
    for doc, mark, text in rows:
        w = (text or "").split()
        gone = {i for a in range(len(w) - n + 1) if first[tuple(w[a:a + n])] < (doc is None, doc or 0, mark, a) for i in range(a, a + n)}
        out.append((doc, [x for i, x in enumerate(w) if i not in gone]))
    return sorted(out, key=repr)


def test_passages_equal_brute_force(spark):
    r = random.Random(8)
    pool = [sentence(r, r.randrange(5, 40), 30) for _ in range(8)]
    some = lambda: " ".join(r.choice([*pool, sentence(r, 6), "\n", "\n \n"]) for _ in range(r.randrange(1, 14)))       # noqa: E731
    rows = [(i, some()) for i in range(50)] + [(7, "same id, other text " + pool[0]), (None, pool[1] + " " + pool[2])] + EDGE[:-1]
    docs = frame(spark, rows)
    marks = {(d, t): m for d, t, m in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, ''))").collect()}
    for n in (3, 12, 50):
        got = lines.dedup_passages(docs, n).collect()
        assert sorted(((x.doc_id, (x.ld_text or "").split()) for x in got), key=repr) == brute_passages([(d, marks[d, t], t) for d, t in rows], n)
        assert all((x.text is None) == (x.ld_text is None) for x in got)


def test_passage_inside_longer_lines_is_deleted(spark, tmp_path):
    r = random.Random(9)
    passage = sentence(r, 51)
    broken = passage.replace(" ", "\n", 30).replace("\n", " ", 20)
    rows = [(1, f"some head {passage} and a tail\nlast"), (2, f"first\n\nother  words\t{passage}  then more\nend"),
            (3, f"x y {broken} z"), (4, "only  " + " ".join(passage.split()[:49])), (5, passage), (6, "a\n" + passage + " \nb")]
    expected = {1: rows[0][1], 2: "first\n\nother  words\tthen more\nend", 3: "x y\nz", 4: rows[3][1], 5: "", 6: "a\nb"}
    got = {x.doc_id: (x.ld_text, x.ld_lines, x.ld_deleted) for x in lines.dedup_passages(frame(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == expected
    assert [got[i][2] for i in range(1, 7)] == [0, 0, 9, 0, 1, 1] and got[2][1] == 4
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    query = {x.doc_id: x.kept_sha256 for x in lines.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert query == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in expected.items()}


def test_line_dedup_empty_table(spark):
    assert lines.dedup_passages(frame(spark, [])).count() == 0
    assert lines.dedup_lines(frame(spark, [])).count() == 0


# --- 3: mixing ----------------------------------------------------------------------------
def test_mix_targets_and_copies(spark):
    r = random.Random(2)
    rows = [(i, sentence(r, r.randrange(0, 60)), r.choice(["b", "b", "b", "a", "Z", None])) for i in range(300)] + [(None, "x y", "a"), (999, None, "q")]
    planned = mixing.plan_mix(frame(spark, rows)).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    for _ in order:                                       # the rule as stated: reshare what full sources leave
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        full |= {s for s in order if target[s] > 2 * size[s]}
    for p in planned:
        assert p.mx_source_size == size[p.source] and p.mx_target == pytest.approx(min(target[p.source], 2 * size[p.source]))
        rate = p.mx_target / p.mx_source_size if p.mx_source_size else 0
        assert math.floor(rate) <= p.mx_copies <= math.ceil(rate)
    assert len(planned) == len(rows)
    mixed = mixing.mix_sources(frame(spark, rows))
    assert mixed.columns == frame(spark, []).columns and mixed.count() == sum(p.mx_copies for p in planned)
    taken = sum(p.mx_copies * p.mx_size for p in planned)
    assert taken == pytest.approx(1.5 * sum(size.values()), rel=0.1)
    assert mixing.plan_mix(frame(spark, [])).count() == 0


# --- 4: toxicity -----------------------------------------------------------------------------
def distance_to(entry, word):
    """Least edits that turn the entry (a stem: any prefix of the word) into the word."""
    letters, stem = entry.rstrip("$"), not entry.endswith("$")
    row = list(range(len(word) + 1))
    for i, ch in enumerate(letters, 1):
        new = [i]
        for j, w in enumerate(word, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (ch != w)))
        row = new
    return min(row) if stem else row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcd", min_size=3, max_size=9), min_size=1, max_size=5, unique=True), st.text("abcd", max_size=11), st.booleans())
def test_matcher_equals_edit_distance(stems, word, whole):
    entries = sorted({s + "$" if whole or len(s) % 2 else s for s in stems})
    near = [(d, i) for i, e in enumerate(entries) if (d := distance_to(e, word)) <= toxicity.edits_for(len(e.rstrip("$")))]
    assert toxicity.Matcher(entries).match(word) == (min(near)[::-1] if near else None)


def toxic_corpus():
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = sentence(r, 30, 60).split()
        w = ["".join(chr(97 + int(c)) for c in x[1:].zfill(3)) for x in w]
        if toxic:
            for term in ("moronic", "loweitum", "loweischaft"):
                w.insert(r.randrange(len(w)), term)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_learns_words_and_stems(spark):
    rows, labels = toxic_corpus()
    known = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame(spark, rows), known)
    assert "moronic$" in model.entries and any(e.startswith("lowei") for e in model.entries)
    probe = [(1000, "you are a moronic abc"), (1001, "abc mornic def"), (1002, "abc def"), (1003, None), (1004, ""), (1005, "abc " * 20_000)]
    got = {r.doc_id: r.s for r in toxicity.score(frame(spark, probe), model, "s").collect()}
    assert got[1000] >= 0.3 and got[1001] >= 0.3 and max(got[i] for i in (1002, 1003, 1004, 1005)) < 0.3
    kept = toxicity.drop_toxic(frame(spark, rows + EDGE), known)
    assert kept.columns == frame(spark, []).columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted(
        (i or -1) for i, _ in rows + EDGE if i is None or i > 400 or (i % 5 or i >= 400) or (i, _) in EDGE)


def test_toxicity_quotation_weighs_less():
    m = toxicity.Matcher(["moron$"])
    assert m.evidence('he said "what a moron" today') == {(0, 0, True)} and m.evidence("what a moron") == {(0, 0, False)}


@pytest.mark.parametrize("text, quoted", [
    ('he said "what a moron" today', True), ("what a moron", False), ('"hello". You moron! "bye"', False), ('"moron', False),
    ("er rief „du moron“ laut", True), ("il dit « quel moron » hier", True), ("“you moron” he said", True), ('moron" he said', False),
    ('"' + "x " * 60 + 'moron"', False)])
def test_quotation_marks_are_paired(text, quoted):
    m = toxicity.Matcher(["moron$"])
    assert m.evidence(text) == {(0, 0, quoted)}


def test_toxicity_score_against_a_plain_statement(spark):
    """The score is the logistic function of the bias and the weight of each distinct piece of evidence, words one by one."""
    r = random.Random(3)
    entries = ["dabcd$", "ba", "cabbag"]
    weights = {(i, e, q): r.uniform(0, 3) for i in range(3) for e in range(3) for q in (False, True)}
    model = toxicity.Model(entries, weights, -2.5)
    texts = [" ".join("".join(r.choice("abcd") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(0, 12))) for _ in range(60)]
    texts += [None, "", "... 12", "DABCD dabcd"]
    for text, got in zip(texts, next(model.scores(iter([pd.Series(texts)])))):
        evidence = set()
        for word in (text or "").lower().split():
            near = [(d, i) for i, e in enumerate(entries) if word.isalpha() and (d := distance_to(e, word)) <= toxicity.edits_for(len(e.rstrip("$")))]
            if near:
                evidence.add((*min(near)[::-1], False))
        assert got == pytest.approx(1 / (1 + math.exp(2.5 - sum(weights[e] for e in evidence))))


def test_automaton_is_made_anew_when_it_is_large(monkeypatch):
    r = random.Random(2)
    words_ = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 12))) for _ in range(400)]
    entries = ["abcdefga$", "bcdefgh", "hgfedcba$"]
    want = [toxicity.Matcher(entries).match(w) for w in words_]
    monkeypatch.setattr(toxicity, "STATES", 5)
    small = toxicity.Matcher(entries)
    assert [small.match(w) for w in words_] == want and len(small.sets) < 5 + 20


def test_toxicity_and_quality_of_null_ids_are_not_held_out(spark, tmp_path):
    frame(spark, EDGE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (toxicity.op4_toxicity, quality.op5_quality):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == len(EDGE) and [r.held_out for r in got if r.doc_id is None] == [False]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(frame(spark, EDGE), none).count() == len(EDGE)
    assert toxicity.drop_toxic(frame(spark, []), none).count() == 0


# --- 1: BPE ------------------------------------------------------------------------------------
TEXTS = ["Hello world's  end\n\n it's   ok\t!", "<|endoftext|> a<|endoftext|>b", "ÄÖÜ 中文 123abc😀  x\x85y\x1cz", "'s 'LL don't\r\n", "", " ", "a" * 300,
         " \n x", "x 　 y"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + EDGE
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame(spark, rows)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()           # noqa: E731
    expected = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert got == expected
    assert bpe.digests(frame(spark, [])).count() == 0
    codec = bpe.codec_for(frame(spark, rows))
    texts = bpe.decode(bpe.encode(frame(spark, rows), codec), codec).select("doc_id", "decoded").collect()
    assert Counter(map(tuple, texts)) == Counter((i, t or "") for i, t in rows)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_exact_merges_equal_the_library(library, text):
    lexicon = test_exact_merges_equal_the_library.__dict__.setdefault(
        "lexicon", bpe.Lexicon(bpe.build(v := bpe.Vocabulary(bpe.default_vocabulary()), [" the", "and"]), v.special))
    ids = lexicon.encode([text])[0]
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert lexicon.decode(ids.astype(np.int64)) == text


def test_grid_and_heap_merge_alike(library):
    v = bpe.Vocabulary(bpe.default_vocabulary())
    m, r = bpe.Merges(v.merges), random.Random(1)
    pieces = [[int(v.byte_ids[b]) for b in "".join(r.choice("theinraose") for _ in range(r.randrange(1, 90))).encode()] for _ in range(300)]
    assert m.merge(pieces) == [m._long(p) for p in pieces]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=20))
def test_automaton_numbers_its_words(items, others):
    items = sorted(items)
    keys, targets, outputs, final = bpe.compile_automaton(items)
    lexicon = bpe.Lexicon.__new__(bpe.Lexicon)
    lexicon.a = {"keys": keys, "targets": targets, "outputs": outputs, "final": final}
    asked = items + others
    assert lexicon.look_up(asked).tolist() == [items.index(w) if w in items else -1 for w in asked]
    # minimal: states with the same arcs and flag are one
    arcs = {}
    for k, t in zip(keys.tolist(), targets.tolist()):
        arcs.setdefault(k >> 8, []).append((k & 255, t))
    shapes = [(bool(final[s]), tuple(arcs.get(s, ()))) for s in range(len(final))]
    assert len(set(shapes)) == len(shapes)


def test_packed_file_round_trip(tmp_path):
    a = {"x": np.arange(5, dtype=np.int64), "flag": np.array([True, False]), "none": np.zeros(0, np.int32)}
    (tmp_path / "f").write_bytes(bpe.pack(a))
    assert all((bpe.mapped(str(tmp_path / "f"))[k] == v).all() for k, v in a.items())


# --- 5: quality -----------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = sentence(r, 200) if good else " ".join([f"W{r.randrange(9)}!!"] * 150)
        rows.append((i, sentence(r, 20) + "\n" + text))
        labels.append((i, int(good), 0))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(frame(spark, rows), known)
    got = {x.doc_id: x.q for x in quality.score(frame(spark, rows + [(i + 5000 if i else None, t) for i, t in EDGE]), model, "q").collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in held)
    assert all(0 <= v <= 1 for v in got.values())


def plain_features(words_):
    """The numbers of one passage, stated one by one."""
    n = max(1, len(words_))
    text = "".join(words_)
    low, up, dig = (lambda c: "a" <= c <= "z"), (lambda c: "A" <= c <= "Z"), (lambda c: "0" <= c <= "9")
    stop, other = (lambda c: c in ".,;:'?"), (lambda c: ord(c) >= 128)
    symbol = lambda c: not (low(c) or up(c) or dig(c) or stop(c) or other(c) or ord(c) <= 32)                    # noqa: E731
    part = lambda f: sum(map(f, text)) / max(1, len(text))                                                  # noqa: E731
    count = lambda f: sum(f(w) for w in words_) / n                                                         # noqa: E731
    letters = lambda w: sum(low(c) or up(c) or other(c) for c in w)                                         # noqa: E731
    has = lambda w, f: sum(map(f, w))                                                                       # noqa: E731
    mean = sum(map(len, words_)) / n
    return [part(low), part(up), part(dig), part(stop), part(symbol), part(other), len(set(words_)) / n,
            sum(a == b for a, b in zip(words_, words_[1:])) / n, sum(a == b for a, b in zip(words_, words_[2:])) / n,
            mean / 10, max(0.0, sum(len(w) ** 2 for w in words_) / n - mean ** 2) ** 0.5 / 10,
            count(lambda w: has(w, up) > 1 and not has(w, low)), count(lambda w: has(w, symbol) > 0 and letters(w) > 0),
            count(lambda w: has(w, symbol) > 0 and not letters(w)), count(lambda w: not letters(w)), count(lambda w: has(w, dig) > 0),
            count(lambda w: has(w, stop) > 0), count(lambda w: len(w) == 1), count(lambda w: has(w, up) == 1 and has(w, low) > 0),
            math.log1p(len(words_))]


def test_passages_against_a_plain_statement():
    r = random.Random(12)
    texts = [" ".join("".join(r.choice("abZQ09.,!#é中") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(0, 150))) for _ in range(12)]
    texts += [None, "", "one", "a a a b a"]
    x, owner = quality.encode_passages(texts)
    at = 0
    for i, text in enumerate(texts):
        words_ = (text or "").split()
        for start in range(0, max(1, len(words_)), quality.PASSAGE_WORDS):
            assert owner[at] == i and x[at] == pytest.approx(plain_features(words_[start:start + quality.PASSAGE_WORDS]), abs=1e-5)
            at += 1
    assert at == len(x)


def test_pooled_score_against_a_plain_statement():
    model, r = quality.Model(), np.random.default_rng(4)
    x, p = r.normal(size=(9, quality.N_FEATURES)), None
    owner, p = np.array([0, 0, 0, 1, 2, 2, 2, 2, 2]), model.p
    got = model.forward(x, owner, 3)[-1]
    for bag in range(3):
        h = [np.tanh(row @ p["W"] + p["b"]) for row in x[owner == bag]]
        e = [float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"]) for v in h]
        a = np.exp(e) / np.exp(e).sum()
        z = sum(w * v for w, v in zip(a, h))
        assert got[bag] == pytest.approx(1 / (1 + math.exp(-float(z @ p["c"] + p["d"][0]))))


def test_quality_gradient_matches_differences():
    r = np.random.default_rng(0)
    m = quality.Model()
    m.p["c"] = r.normal(size=m.p["c"].shape)
    x, owner, y = r.normal(size=(7, quality.N_FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.log(np.where(y == 1, o := m.forward(x, owner, 3)[-1], 1 - o)))          # noqa: E731
    g = m.gradient(x, owner, y)
    for k in g:
        at = tuple(r.integers(0, s) for s in m.p[k].shape)
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        down = loss()
        m.p[k][at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# --- 6: LM scoring ------------------------------------------------------------------------------------
def language(seed=0):
    r = np.random.default_rng(seed)
    lm = attention.Language(r.random(attention.VOCAB), r.random(attention.VOCAB))
    for m in (lm.outer, lm.inner):
        for k in ("Wc", "M"):
            m.p[k] = r.normal(0, 0.1, m.p[k].shape).astype(np.float32)
    return lm


def test_attention_is_a_causal_distribution():
    lm, r = language(), np.random.default_rng(1)
    m = lm.inner
    x = r.integers(0, attention.VOCAB, (1, 2 * attention.INNER)).astype(np.int64)
    x[0, :2] = -1
    tables = m.tables(m.p["E"])
    total = 0.0
    for start in range(0, attention.VOCAB, 512):
        ids = np.arange(start, start + 512)
        target = np.full((512, attention.INNER), -1)
        target[:, 1] = ids
        total += np.exp(m.log_probs(tables, np.repeat(x, 512, 0), target)[:, 1]).sum()
    assert total == pytest.approx(1, abs=1e-3)
    target = np.array([[5, 6, 7, 8]])
    before = m.log_probs(tables, x, target)
    later = x.copy()
    later[0, -1] = 3                                      # seen by the last position only
    after = m.log_probs(tables, later, target)
    assert np.allclose(before[0, :-1], after[0, :-1], atol=1e-5) and before[0, -1] != after[0, -1]


def test_attention_gradient_matches_differences():
    lm, r = language(2), np.random.default_rng(3)
    m = lm.outer
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = r.integers(0, 50, (2, 2 * attention.OUTER, attention.WORD_IDS))
    x[0, :5] = -1
    x[:, :, 4:] = -1
    target = r.integers(0, 50, (2, attention.OUTER))
    target[1, 10:] = -1

    def loss():
        tables = m.tables(m.embed(x).reshape(-1, attention.WIDTH))
        at = np.where(x[:, :, 0] >= 0, np.arange(x[:, :, 0].size).reshape(x.shape[:2]), -1)
        return -m.log_probs(tables, at, target).sum() / (target >= 0).sum()
    g = m.gradient(x, target)
    for k in ("E", "Wq", "Wk", "Wv", "Wr", "Wo", "b", "rel", "Wc", "bc", "M", "bm"):
        flat = np.abs(g[k]).ravel().argmax()
        at = np.unravel_index(flat, g[k].shape)
        m.p[k][at] += 1e-3
        up = loss()
        m.p[k][at] -= 2e-3
        down = loss()
        m.p[k][at] += 1e-3
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4), k


def test_words_longer_than_a_block_are_scored_once():
    ids = [tuple(range(1, n + 1)) for n in (1, 3, 4, 5, 9)]
    x, owner = attention.inner_windows(ids)
    targets = [[t for w, o in zip(x, owner) if o == i for t in w[attention.INNER + 1:].tolist() if t >= 0] for i in range(len(ids))]
    assert targets == [[*w[1:], attention.END] for w in ids]


def test_every_block_is_learned_once_in_some_round(monkeypatch):
    sub, r = attention.Subwords([]), random.Random(4)
    texts = ["", "one", *(sentence(r, n) for n in (15, 16, 17, 40, 700))]
    spelt = lambda bags, w: tuple(() if i < 0 else tuple(bags.take(np.array([i])).flat.tolist()) for i in w)     # noqa: E731
    rounds = [attention.windows_of(texts, sub, turn) for turn in range(attention.ROUNDS)]
    whole = []
    for t in texts:
        ids = [(), *sub.ids([b"", *words(t), b""]), *[()] * 16]
        for at in range(1, len(words(t)) + 2, attention.OUTER):
            block = lambda i: ids[i + 1] if 0 <= i <= len(words(t)) + 1 else ()                                  # noqa: E731
            whole.append(tuple(block(i) for i in range(at - 1 - attention.OUTER, at + attention.OUTER)))
    assert sorted(spelt(bags, w) for bags, ws in rounds for w in ws) == sorted(whole)
    seen, gradient = Counter(), attention.Attention.word_gradient

    def counted(self, bags, x, target):
        seen.update(spelt(bags, w) for w in x)
        return gradient(self, bags, x, target)
    monkeypatch.setattr(attention.Attention, "word_gradient", counted)
    assert language().train(rounds, 0, 0.01, 0) == len(whole)
    assert seen == Counter(w[:-1] for w in whole)


def test_long_words_are_learned_and_seen_whole(monkeypatch):
    sub, learned, gradient = attention.Subwords([]), [], attention.Attention.gradient

    def noted(self, x, target, times):
        learned.extend((*w[w >= 0].tolist(), n) for w, n in zip(target, times))
        return gradient(self, x, target, times)
    monkeypatch.setattr(attention.Attention, "gradient", noted)
    monkeypatch.setattr(attention, "ROUNDS", 1)
    part = attention.windows_of(["Abcdefghi abcdefghi x"], sub, 0)
    lm = language()
    lm.train([part], 0, 0.01, 0)
    assert sorted(learned) == sorted([(*b"abcd", 2), (*b"efgh", 2), (*b"i", attention.END, 2), (*b"x", attention.END, 1)])
    ids = sub.ids([b"abcdefghi", b"abcdefghj", b"y", b""])
    bags = attention.Bags.of(ids)
    assert np.allclose(bags.mean(lm.outer.p["E"])[0], lm.outer.p["E"][list(ids[0])].mean(0), atol=1e-6)
    a, b = lm.first_scores(bags, [np.array([3, 0, 2, 3]), np.array([3, 1, 2, 3])])
    assert a != b                                            # they differ in the tenth id only


def test_word_gradient_is_that_of_the_grid():
    m, r = language(5).outer, np.random.default_rng(6)
    ids = [tuple(r.integers(0, 50, n).tolist()) for n in (1, 2, 6, 3)]
    x = r.integers(-1, len(ids), (3, 2 * attention.OUTER))
    target = np.where(x[:, attention.OUTER:] >= 0, 7, -1)
    grid = np.concatenate([attention.padded(ids, attention.WORD_IDS), np.full((1, attention.WORD_IDS), -1)])[x]
    one, other = m.word_gradient(attention.Bags.of(ids), x, target), m.gradient(grid, target)
    assert all(np.allclose(one[k], other[k], atol=1e-5) for k in one)


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(attention, "KNOWN_WORDS", 20)            # most words take the join
    monkeypatch.setattr(attention, "LEARN_EVERY", 1)
    monkeypatch.setattr(attention, "ROUNDS", 1)
    monkeypatch.setattr(attention, "STEPS", 3)
    r = random.Random(6)
    rows = [(i, sentence(r, r.randrange(0, 50))) for i in range(40)]
    extra = rows + [(100, "neverseen " * 3), (101, None), (102, ""), (None, "W1 w2"), (103, "x" * 5000), (1, rows[1][1])]
    got = attention.score(frame(spark, extra), frame(spark, rows)).collect()
    c = Counter(w for _, t in rows for w in [*words(t), b""])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(extra)
    key = lambda x: (x[0] is None, x[0] or 0)                    # noqa: E731
    for g, (i, t) in zip(sorted(got, key=key), sorted(extra, key=key)):
        w = [*words(t), b""]
        assert (g.doc_id, g.n_tokens, g.n_known, g.train_tokens) == (i, len(w), sum(x in c for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert math.isfinite(g.score) and g.score < 0
    assert attention.score(frame(spark, []), frame(spark, rows)).count() == 0
    assert attention.score(frame(spark, rows[:2]), frame(spark, [])).count() == 2


def test_distinct_words_are_learned_once_by_their_counts(monkeypatch):
    learned, gradient = Counter(), attention.Attention.gradient
    rows = []

    def noted(self, x, target, times):
        rows.append(len(x))
        for w, n in zip(target, times):
            learned[tuple(w[w >= 0].tolist())] += n
        return gradient(self, x, target, times)
    monkeypatch.setattr(attention.Attention, "gradient", noted)
    monkeypatch.setattr(attention, "ROUNDS", 1)
    monkeypatch.setattr(attention, "LATE_WINDOWS", 8)            # many steps of the outer model
    sub = attention.Subwords([])
    language().train([attention.windows_of(["ab c d ab " * 500], sub, 0)], 0, 0.01, 0)
    assert learned == {(ord("a"), ord("b"), attention.END): 1000, (ord("c"), attention.END): 500, (ord("d"), attention.END): 500}
    assert sum(rows) == 3                                        # not three for each step
    learned.clear()
    items = [bytes(w) for w in {tuple(random.Random(i).choices(b"abcdefgh", k=3)) for i in range(300)}]
    times = np.array([5000, *[1] * (len(items) - 1)])
    assert language().train_inner([(sub.bags(items), times)], 6, 0.01, 0) == len(items)
    total = {k: pytest.approx(v) for k, v in zip((( *w, attention.END) for w in items), times.tolist())}
    once = sum(times) * 1.0
    rounds = sum(learned.values()) / once
    assert rounds >= 1 and all(learned[k] == pytest.approx(v.expected * rounds) for k, v in total.items())


def test_rounds_of_documents_agree_with_spark(spark, monkeypatch):
    r = random.Random(8)
    texts = ["", *(sentence(r, n) for n in range(1, 40)), "Größe \u65e5\u672c " * 3]
    docs, sub = frame(spark, list(enumerate(texts))), attention.Subwords([])
    for turn in range(attention.ROUNDS):
        here = [row.text for row in docs.where(attention.of_round("text", attention.LEARN_EVERY, turn)).collect()]
        of = lambda t: len(attention.windows_of(t, sub, turn)[1])            # noqa: E731
        assert of(here) == of(texts) == sum(-(-(len(words(t)) + 1) // attention.OUTER) for t in here)


def test_split_words_and_run_sums_match_plain_ones():
    texts = pa.array([None, " A b ", "", None, "  ", "\x0bQ\x1cz\u00c9 k\n", "x"])
    for part in (texts, texts.slice(1, 5), texts.slice(5), texts.slice(2, 0)):
        at, ends, distinct = attention.split_words(part)
        assert [[distinct[i] for i in at[a:b]] for a, b in zip(ends[:-1], ends[1:])] == [words(t) for t in part.to_pylist()]
    r = np.random.default_rng(3)
    rows, size = r.normal(size=(50, 4)), np.array([1, 200, 3, attention.LONG_RUN, attention.LONG_RUN + 1, 2, 1])
    order, start = r.integers(0, 50, size.sum()), np.cumsum(size) - size
    assert np.allclose(attention.run_sums(rows, order, start, size), [rows[order[a:a + n]].sum(0) for a, n in zip(start, size)])
    sub = attention.Subwords([(ord("a"), ord("b"), 256)])
    items = [b"ab", b"q", b"xabab" * 20]
    bags = sub.bags(items)
    assert [tuple(bags.take(np.array([i])).flat.tolist()) for i in range(3)] == sub.ids(items)


# --- the pipeline ---------------------------------------------------------------------------------------
def test_pipeline_stages_on_edge_rows(spark, tmp_path):
    rows, labels = toxic_corpus()
    r = random.Random(12)
    passage = sentence(r, 70)
    rows += [(500 + i, passage + f"\nown line {i} " + sentence(r, 12)) for i in range(5)] + EDGE
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert after.columns == docs.columns, name
        path = str(tmp_path / name)
        after.write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        if name == "toxicity":
            assert docs.count() == len(rows) - 80
        if name == "line_dedup":
            assert docs.where(docs.text.contains(passage)).count() == 1 and docs.count() == before.count()
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_on_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
