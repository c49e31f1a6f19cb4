"""Collocations, language identification and whitening: brute force, held-out rows, edge rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import collocations, language, whitening

SF = "/root/testdata/sf0.001"


# --- 11: collocations ------------------------------------------------------------------------
def brute_collocations(rows, least, first, most=4):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q, n in f.items() if len(q) > len(p) and n >= least and 100 * n >= 80 * a
                      and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if longer:
                continue
            score, k = min((2000000 * a // (f[p[:i]] + f[p[i:]]), i) for i in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def found_collocations(spark, rows, least, first, shards):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(df, least=least, first=first, shards=shards)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_collocations_against_brute_force(spark, shards):
    r = random.Random(shards)
    vocab = ["new", "york", "City", "der", "é", "x1", "a", " b", "NUL\x00", "of"]
    rows = []
    for _ in range(120):
        n = r.randrange(0, 40)
        text = "".join(r.choice(vocab[:r.randrange(2, 11)]) + r.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  ", ""]) for _ in range(n))
        rows.append((r.choice(["en", "de", None, "und"]), text))
    rows += [("en", None), ("fr", ""), (None, None), ("fr", "...")] + [rows[0]] * 5
    assert found_collocations(spark, rows, 6, 15, shards) == brute_collocations(rows, 6, 15)


def test_collocations_of_hidden_phrases_and_ties(spark):
    rows = [("en", "a b c d. x y. y x. x y. y x")] * 10 + [("en", "b c")] * 2 + [("en", "q q q q q q")] * 4
    assert found_collocations(spark, rows, 10, 5, 2) == brute_collocations(rows, 10, 5)


def test_collocations_without_rows(spark):
    df = spark.createDataFrame([], "lang string, text string, score int")
    assert collocations.collocations(df).collect() == []


def test_collisions_of_the_table_do_not_change_counts(spark, monkeypatch):
    """Every phrase shares its slot with others: counts start early and are kept long, but each pair begins once."""
    monkeypatch.setattr(collocations, "SLOTS", (4, 4))
    monkeypatch.setattr(collocations, "ROW_SLOTS", 2)
    scans, scan = [], collocations.scan
    monkeypatch.setattr(collocations, "scan", lambda docs, step: scans.append(step.number) or scan(docs, step))
    r = random.Random(9)
    rows = [("en", " ".join(r.choice("abcdefghijklmn") for _ in range(30))) for _ in range(60)]
    assert found_collocations(spark, rows, 8, 50, 2) == brute_collocations(rows, 8, 50)
    assert max(scans) <= 4 * 2 + 2


def test_words_have_one_hash_wherever_they_stand():
    words = collocations.Words()
    text = "ab cd\tab.é,cd  ab\n" * 3
    start, length, hashes, piece = words.of(text.encode())
    raw = text.encode()
    found = [raw[a:a + n] for a, n in zip(start, length)]
    assert found == re.findall(rb"[^ \t.,;:!?\n]+", raw)
    assert len({(w, h) for w, h in zip(found, hashes.tolist())}) == len(set(found)) == len(set(hashes.tolist()))
    assert piece.tolist()[:6] == [0, 0, 0, 1, 2, 2] and piece[6] == 3
    assert all(len(x) == 0 for x in words.of(b"")) and len(words.of(b" . ")[0]) == 0
    first, n, key = collocations._distinct(np.array([5, 7, 5, 5], np.uint64), np.array([0, 2, 4, 6]))
    assert n.tolist() == [3, 1] and first[1] == 2 and key.tolist() == [5, 7]


# --- 12: language ------------------------------------------------------------------------------
def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language.op12_language_id(spark, SF).collect()}
    rows = docs.select("doc_id", "lang", language.fold_of("doc_id", 4).alias("fold")).collect()
    assert len(got) == len(rows)
    held = [r for r in rows if r.fold == 2]
    assert all(got[r.doc_id].held_out == (r.fold == 2) for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_rows(spark):
    rows = [(1, "der Hund und die Katze sind im Haus", "de"), (3, "the dog and the cat are in the house", "en"),
            (4, "le chien et le chat sont dans la maison", "fr"), (5, None, "en"), (6, "123 !? 45", "en"), (7, "", None),
            (None, "the cat", "en"), (8, "der Hund", None), (8, "der Hund", None), (9, "le chat " * 30_000, None)] * 2
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language.learn(df)
    out = language.predict(df, model).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    for r in out:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        if r.text and r.text.startswith(("der", "le ")):
            assert r.lang_pred == ("de" if r.text.startswith("der") else "fr")
    empty = language.predict(df.limit(0), language.learn(df.limit(0)))
    assert empty.collect() == [] and language.predict(df, None).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_row_of_features_does_not_depend_on_its_neighbours():
    table = language.letters()
    texts = ["Abc, déf", "", "x", None, "日本 語", "ab  c"]
    x, some = language.features(texts, table)
    for i, t in enumerate(texts):
        alone, ok = language.features([t], table)
        assert np.array_equal(alone[0], x[i]) and ok[0] == some[i]
    assert some.tolist() == [True, False, True, False, True, True]
    # n-grams counted one by one
    text = " abc déf "
    for k in (1, 2, 3):
        grams = Counter(text[i:i + k] for i in range(len(text) - k + 1) if text[i:i + k] != " ")
        part = np.sort(x[0, (k - 1) * language.PLACES:k * language.PLACES])[::-1][:len(grams)]
        want = np.sort(np.sqrt(np.array(list(grams.values())) / sum(grams.values())))[::-1]
        assert np.allclose(part, want, atol=1e-6)


def test_machine_is_at_the_optimum():
    """No step in any direction makes the squared-hinge objective smaller by more than the tolerance."""
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * r.normal(size=60) > 0, 1.0, -1.0)
    w, b = language.machine(x, y, epochs=500)
    side = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum()) * len(y) / 2

    def objective(v):
        gap = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        return (v @ v) / 2 + language.COST * (side * gap * gap).sum()
    best = np.append(w, b).astype(float)
    for _ in range(300):
        step = r.normal(size=6)
        assert objective(best) <= objective(best + 10 ** r.uniform(-4, 0) * step) * (1 + 1e-3)


def test_families_come_first(spark):
    model = language.Model(np.eye(4, language.WIDTH, dtype=np.float32), ["en", "de", "fr", "zz"])
    assert model.families == ["germanic", "romance", "zz"] and model.pairs == [(0, 1)]
    best, score = model.predict(np.eye(4, language.WIDTH, dtype=np.float32))
    assert [model.langs[i] for i in best] == ["en", "de", "fr", "zz"] and ((0 <= score) & (score <= 1)).all()


# --- 13: whitening -------------------------------------------------------------------------------
def brute_whitening(rows, most=16):
    kept = [(i, [np.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v) and len(v)]
    out = []
    for d in {len(v) for _, v in kept}:
        x = np.array([v for _, v in kept if len(v) == d]).astype(np.int64)
        fit = np.unique(x, axis=0)
        n, s = len(fit), fit.sum(0)
        y = fit - s / n
        v = y.T @ y / n
        e, q = np.linalg.eigh(v)
        e, q = e[::-1][:most], q[:, ::-1][:, :most]
        keep = e > 1e-13 * max(np.trace(v), 0)
        w = (x - s / n) @ q[:, keep] / np.sqrt(e[keep])
        dev = ((n * x.astype(object) - s) ** 2).sum(1)
        for (i, _), white, t in zip([k for k in kept if len(k[1]) == d], w, dev):
            out += [(i, c + 1, n, int(t), abs(float(z)), e[c] / np.trace(v)) for c, z in enumerate(white)]
    return sorted(out, key=repr)


def check_whitening(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, component int")
    got = whitening.whiten(df).collect()
    want = brute_whitening([(i, None if v is None else [None if c is None else (np.float32(c) if kind == "float" else c) for c in v]) for i, v in rows])
    plain = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=lambda r: repr(r[:4]))
    assert [r[:4] for r in plain] == [r[:4] for r in sorted(want, key=lambda r: repr(r[:4]))]
    assert np.allclose([r[4:] for r in plain], [r[4:] for r in sorted(want, key=lambda r: repr(r[:4]))], atol=1e-7)
    assert all(r.identity_error < 1e-8 for r in got)
    # signs agree: the columns are whitened versions of one basis
    return got


def test_whitening_against_numpy(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=20) * np.linspace(3, 1, 20)).tolist()) for i in range(150)]
    rows += [(None, rows[0][1]), (0, rows[0][1]), (900, None), (901, [None] * 20), (902, [float("nan")] * 20),
             (903, [float("inf")] + [0.0] * 19), (904, [])]
    got = check_whitening(spark, rows)
    assert len(got) == 152 * 16
    assert max(r.identity_error for r in got) < 1e-10


def test_whitening_of_several_lengths_and_few_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=3).tolist()) for i in range(30)] + [(100 + i, r.normal(size=2).tolist()) for i in range(9)]
    check_whitening(spark, rows, "double")
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == []                     # no variance, no component
    assert whitening.whiten(same.limit(0)).collect() == []


def test_deviation_beyond_64_bits_is_null():
    t = whitening.centred_exact(np.array([[1 << 50], [0]]), 1 << 20, [0])
    assert whitening.deviations(t) == [None, 0]
    assert whitening.deviations(np.array([[3, 4]])) == [25]


@pytest.mark.parametrize("n", [1, 2, 5, 33, 90])
def test_components_equal_numpy(n):
    r = np.random.default_rng(n)
    x = r.normal(size=(3 * n + 1, n))
    a = x.T @ x
    e, v = whitening.components(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-11 * np.trace(a))
    assert np.allclose(v.T @ v, np.eye(n), atol=1e-12) and np.allclose(a @ v, v * e, atol=1e-11 * np.trace(a))
    top, _ = whitening.components(a, 3)
    assert np.allclose(top, e[:3], rtol=1e-12)


@pytest.mark.parametrize("values", [[4, 4, 4], [5, 5, 1, 1, 0, 0], [1e6, 1, 1e-6, 0], [0, 0], [2, 2 + 1e-12, 1], [-1, 0, 1]])
def test_components_of_repeated_values(values):
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values),) * 2))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.components(a)
    assert np.allclose(e, sorted(values, reverse=True), atol=1e-12 * max(1, max(values)))
    assert np.allclose(a @ v, v * e, atol=1e-12 * max(1, max(values)))


def test_polar_factor():
    r = np.random.default_rng(3)
    x = r.normal(size=(12, 12))
    a = (x + x.T) / 2
    u = whitening.polar(a)
    e, q = np.linalg.eigh(a)
    assert np.allclose(u, q @ np.diag(np.sign(e)) @ q.T, atol=1e-12)
    assert whitening.polar(np.zeros((2, 2))) is None and whitening.polar(np.diag([1.0, 0.0])) is None


def test_arrow_slices_are_read_from_their_start():
    a = pa.array([[1, 2], [3, 4], [5, 6]], pa.list_(pa.int64()))
    assert whitening._matrix(a.slice(1), 2).tolist() == [[3, 4], [5, 6]]


def test_registered_sql():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert con.sql(collocations.ORACLE).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
