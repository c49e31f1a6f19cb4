"""Embeddings, binary codes and conversations: brute force, round trips and SQL."""

import random

import duckdb
import numpy as np
import pytest

from tillroll.llm import chat, hamming, hnsw, mixing
from tillroll.llm.components import Forest, connected_components

SF = "/root/testdata/sf0.001"


# --- components ---------------------------------------------------------------------------
def test_components_of_random_edges(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(1000, 1000), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges if None not in e for v in e}
    for _ in label:
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    linked = {v for a, b in edges if a is not None and a != b for v in (a, b)}
    assert got == {v: c for v, c in label.items() if v in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_joins_what_is_linked():
    r = np.random.default_rng(0)
    for _ in range(30):
        n = 12
        links = r.random((n, n)) < 0.15
        links |= links.T
        forest, edges = Forest(np.arange(100, 100 + n)), []
        for q in range(n):
            at = np.flatnonzero(links[q])
            edges += [(100 + q, b) for b in forest.due(100 + q, at[at != q])]
        assert len(edges) < n

        def roots(pairs):
            label = list(range(n))
            for _ in range(n):
                for a, b in pairs:
                    label[a] = label[b] = min(label[a], label[b])
            return label
        assert roots([(a - 100, b - 100) for a, b in edges]) == roots([(int(a), int(b)) for a, b in np.argwhere(links)])


# --- 2: embeddings -----------------------------------------------------------------------------
def vectors():
    r = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1, 2):
        for _ in range(40):
            base = r.normal(size=16)
            for _ in range(int(r.integers(1, 6))):
                rows.append((n, (base + r.normal(0, 0.07, 16)).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n + 1, rows[0][1], 0), (n + 2, rows[0][1], 1), (n + 3, None, 0), (n + 4, [0.0] * 16, 0), (n + 5, [1.0, None] * 8, 0),
             (n + 6, [float("nan")] * 16, 0), (n + 7, rows[0][1], None), (n + 8, [], 0), (n + 9, [1.0, 2.0], 0), (n + 10, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    return rows


def brute_links(rows, threshold):
    unit = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)
        unit.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    near = [[b for b in range(len(rows)) if a != b and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2]
             and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold] for a in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        for a, bs in enumerate(near):
            for b in bs:
                label[a] = label[b] = min(label[a], label[b])
    low = {}
    for a, row in enumerate(rows):
        low[label[a]] = min(row[0] if row[0] is not None else 1 << 60, low.get(label[a], 1 << 60))
    return sorted(((row[0], len(near[a]), low[label[a]] if row[0] is not None else None, row[0] is not None and row[0] == low[label[a]])
                   for a, row in enumerate(rows)), key=repr)


@pytest.mark.parametrize("shard_rows, block", [(16_384, 1024), (40, 17)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(hnsw, "BLOCK_QUERIES", block)
    rows = vectors()
    frame = spark.createDataFrame([(*x, 1, "z") for x in rows], "vec_id long, embedding array<float>, label int, shard int, copies string")
    got = hnsw.near_duplicates(frame, 0.98)
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows, 0.98)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_with_repeated_ids(spark, kind):
    """Rows that share an id are one vector with several values; each other id counts once."""
    r = np.random.default_rng(11)
    base = r.normal(size=(6, 12))
    rows = []
    for i in range(60):
        vec = base[r.integers(6)] + r.normal(0, 0.03, 12) * r.integers(0, 2)
        rows.append((int(r.integers(25)), (np.float32(vec) if kind == "float" else vec).tolist(), int(r.integers(2))))
    rows += rows[:10]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int"), 0.98)
    linked = {i: {i} for i, *_ in rows}
    for a, x, la in rows:
        for b, y, lb in rows:
            u, v = np.array(x, float), np.array(y, float)
            if la == lb and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                linked[a].add(b)
    root = {i: i for i in linked}
    for _ in root:
        for a, bs in linked.items():
            for b in bs:
                root[a] = root[b] = min(root[a], root[b])
    assert sorted(map(tuple, got.collect())) == sorted((i, len(linked[i]) - 1, root[i], root[i] == i) for i, *_ in rows)


def test_links_of_double_vectors_near_the_threshold(spark):
    """Cosines are those of the vectors as given, not of rounded ones."""
    angle = np.arccos(0.98) + np.arange(-100, 101) * 1e-9
    rows = [(0, [1.0, 0.0], 1)] + [(i + 1, [float(np.cos(a)), float(np.sin(a))], 1) for i, a in enumerate(angle)]
    got = {x.vec_id: x.n_links for x in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i] for i in range(len(rows))] == [int((row >= 0.98).sum()) - 1 for row in x @ x.T]


def test_spark_shards_walk_their_graphs(spark):
    """Shards larger than the beam: planted links are all found, and the beam search did the work."""
    r = np.random.default_rng(12)
    base = r.normal(size=(900, 24))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)] + [(1000 + i, (base[i] + r.normal(0, 0.03, 24)).tolist(), 0) for i in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: x for x in hnsw.near_duplicates(df, 0.98).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.98).sum(1) - 1
    assert len(rows) > 8 * hnsw.FIRST_BEAM and [got[i].n_links for i, *_ in rows] == true.tolist()
    graph = hnsw.Graph(np.arange(len(x)), np.ones(len(x), np.int64), x)
    found, _ = graph.near(x, np.arange(len(x)), 0.98, hnsw.FIRST_BEAM)
    assert sum(map(len, found)) >= 0.99 * (true + 1).sum()


def test_embedding_empty_table(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_recall_against_brute_force():
    r = np.random.default_rng(5)
    base = r.normal(size=(700, 32))
    x = np.concatenate([base, base[:200] + r.normal(0, 0.05, (200, 32)), np.repeat(base[:1], 150, 0) + r.normal(0, 0.05, (150, 32))])
    ids = np.arange(len(x), dtype=np.int64)
    graph = hnsw.Graph.load(hnsw.Graph(ids, np.ones(len(x), np.int64), x).dump())
    found = graph.all_near(graph.unit, ids, 0.98)
    true = [np.flatnonzero(graph.unit @ u >= 0.98) for u in graph.unit]
    assert sum(len(np.intersect1d(a, b)) for a, b in zip(found, true)) >= 0.99 * sum(map(len, true))
    assert all(np.isin(a, b).all() for a, b in zip(found, true))


def test_audit_counts_sparse_links_beside_a_dense_cluster(monkeypatch):
    r = np.random.default_rng(6)
    pairs = r.normal(size=(20, 32))
    x = np.concatenate([np.repeat(r.normal(size=(1, 32)), 500, 0) + r.normal(0, 0.02, (500, 32)), pairs, pairs + r.normal(0, 0.01, (20, 32))])
    ids = np.arange(len(x), dtype=np.int64)
    graph, near = hnsw.Graph(ids, np.ones(len(x), np.int64), x), hnsw.Graph.near

    def first_beam_misses_pairs(self, unit, own, threshold, beam):
        exact, full = near(self, unit, own, threshold, len(self.ids))
        return [np.array([o]) if o >= 500 and beam == hnsw.FIRST_BEAM else e for o, e in zip(own, exact)], full
    monkeypatch.setattr(hnsw.Graph, "near", first_beam_misses_pairs)
    found = graph.all_near(graph.unit, ids, 0.98)
    assert all(np.array_equal(a, np.flatnonzero(graph.unit @ u >= 0.98)) for a, u in zip(found, graph.unit))


# --- 9: exact search -----------------------------------------------------------------------------
@pytest.mark.parametrize("dim, shard_rows", [(64, 8192), (20, 30), (3, 50)])
def test_top_k_equals_brute_force(spark, monkeypatch, dim, shard_rows):
    monkeypatch.setattr(hamming, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(hamming, "BLOCK_QUERIES", 2)
    r = np.random.default_rng(dim)
    rows = [(i, r.normal(size=dim).tolist()) for i in range(150)] + [(7, r.normal(size=dim).tolist())] + [(200 + i, [1.0] * dim) for i in range(30)]
    odd = [(300, None), (301, []), (302, [float("inf")] * dim), (303, [None] * dim), (None, [1.0] * dim), (400, [1.0] * (dim + 1))]
    codes = hamming.sign_codes(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"))
    queries = codes.where("vec_id % 50 = 0")
    got = sorted(map(tuple, hamming.top_k(codes, queries, 5).collect()))
    bits = {j: np.array(v) > 0 for j, (_, v) in enumerate(rows)}
    expected = []
    for j, (q, _) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((int((bits[j] != bits[m]).sum()), n) for m, (n, _) in enumerate(rows) if n != q)[:5]
            expected += [(q, k + 1, n, d) for k, (d, n) in enumerate(near)]
    assert got == sorted(expected)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert hamming.top_k(hamming.sign_codes(empty), hamming.sign_codes(empty)).count() == 0


# --- 8: chats -------------------------------------------------------------------------------------
HARD = ["<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "a\\b", "\\\\", "<\\|", "\\<|", "\\n", "", None, "<", "<|", "|>", "x\n\ny", "\\", "<\\\\|", "<|im_end|>\n"]


def test_chats_survive_their_round_trip(spark):
    r = random.Random(0)
    rows = []
    for c in range(60):
        for t in range(r.randrange(1, 5)):
            rows.append((c if c else None, r.choice([t, t, None]), r.choice(["user", "assistant", None, "a<|b", "x\ny", "q\\n"]),
                         "".join(str(r.choice(HARD) or "") for _ in range(3)) if r.random() < 0.9 else None))
    frame = spark.createDataFrame([(*x, "e") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {x.conv_id: x for x in chat.format_chats(frame).collect()}
    for conv in {x[0] for x in rows}:
        expected = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [e[1:] for e in expected]
        assert all(t.loss == (t.role == "assistant") for t in got[conv].turns)
        assert got[conv].formatted.count("<|im_start|>") == len(expected)
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_plain_chats_are_written_as_they_are(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(frame).first().formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"


# --- queries that SQL can express -----------------------------------------------------------------
@pytest.mark.parametrize("name, run, sql", [("chat", chat.op8_chat_formatting, chat.ORACLE), ("mix", mixing.op3_mix_sources, mixing.ORACLE),
                                            ("search", hamming.op9_exact_top_k, hamming.ORACLE)])
def test_query_equals_its_sql(spark, name, run, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(sql).fetchdf()
    got = run(spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    order = lambda d: d[columns].sort_values(columns).reset_index(drop=True)          # noqa: E731
    assert order(got).equals(order(expected))
