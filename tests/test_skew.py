"""Skew-safe operators stay exact when one group holds most rows."""
import itertools

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from test_operators import brute_rules
from tillroll.operators import baskets
from tillroll.sources.reports import forward_fill, forward_fill_blocked


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]),
                          st.integers(0, 5), st.one_of(st.none(), st.sampled_from("xyz"))),
                min_size=1, max_size=60))
def test_blocked_fill_equals_whole_group_window(spark, data):
    # seq increases with block so blocks are contiguous chunks of the order
    recs = [(g, b, b * 1000 + i, v) for i, (g, b, v) in enumerate(data)]
    df = spark.createDataFrame(recs, "file string, block long, seq long, ctx string")
    a = forward_fill_blocked(df, ["ctx"])
    b = forward_fill(df, ["ctx"], ["file"], ["block", "seq"])
    assert rows(a, "file", "seq", "ctx") == rows(b, "file", "seq", "ctx")


def test_hot_basket_is_exact(spark):
    # one basket carries a third of all lines (many repeats of few items)
    hot = [("b", "hot", f"item{i % 7}", 1.0, 2.0) for i in range(600)]
    cold = [("b", f"c{j}", f"item{(j + k) % 9}", 1.0, 2.0) for j in range(300) for k in range(4)]
    lines = spark.createDataFrame(hot + cold, "branch string, customer string, item string, "
                                              "qty double, price double")
    bk = baskets.build_baskets(lines)
    got = {r["customer"]: set(r["items"]) for r in bk.collect()}
    assert got["hot"] == {f"ITEM{i}" for i in range(7)}
    sets = list(got.values())
    pairs = {(r["antecedents"], r["consequents"]): r["support"]
             for r in baskets.item_pairs(bk, None).collect()}
    for (a, b), s in pairs.items():
        assert s == sum(1 for x in sets if a in x and b in x) / len(sets)
    want = {p for x in sets for p in itertools.combinations(sorted(x), 2)}
    assert set(pairs) == want
    m = baskets.mine(bk, 0.1)
    for r in m.itemsets.collect():
        assert r["freq"] == sum(1 for x in sets if set(r["items"]) <= x)


def test_pairs_of_split_baskets_are_exact(spark):
    """Baskets larger than the chunk size are split into hash chunks; counts are unchanged."""
    recs = [("b", "hot", f"i{n}", 1.0, 1.0) for n in range(40)]
    recs += [("b", f"c{j}", f"i{(j * 7 + k) % 40}", 1.0, 1.0) for j in range(50) for k in range(5)]
    lines = spark.createDataFrame(recs, "branch string, customer string, item string, "
                                        "qty double, price double")
    bk = baskets.build_baskets(lines)
    sets = [set(r["items"]) for r in bk.collect()]
    want = {}
    for x in sets:
        for p in itertools.combinations(sorted(x), 2):
            want[p] = want.get(p, 0) + 1
    for chunk in (3, 6, 2048):                     # 3 and 6 split the 40-item basket
        got = {(r["a"], r["b"]): r["both"] for r in baskets.pair_counts(bk, chunk=chunk).collect()}
        assert got == want, chunk


def test_round_trips_exact_when_files_split_into_many_blocks(spark):
    """Report files read as many small splits: the blocked fill still matches the oracle."""
    import duckdb

    import __spark_entry__ as E
    from check_oracle import canon, same
    from conftest import SF
    from tillroll.sources.tables import TABLE_NAMES

    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name in ["report_delivery_lines", "report_attendance", "report_item_sales"]:
            df = E.queries()[name](spark, SF)
            files = df.inputFiles()
            splits = (df.sparkSession.read.text(files)
                      .select("_metadata.file_path", "_metadata.file_block_start")
                      .distinct().count())
            assert splits > len(files), name          # some file is read as several splits
            got = [tuple(r) for r in df.collect()]
            res = con.execute(E.oracle_sql()[name])
            want_cols = [d[0] for d in res.description]
            assert same(canon(df.columns, got), canon(want_cols, res.fetchall())), name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sets(st.sampled_from(["A", "B", "C", "D", "E"]), min_size=1, max_size=4),
                min_size=5, max_size=25))
def test_rules_match_brute_force_on_random_baskets(spark, sets):
    recs = [("b", f"c{j}", item, 1.0, 1.0) for j, s in enumerate(sets) for item in s]
    lines = spark.createDataFrame(recs, "branch string, customer string, item string, "
                                        "qty double, price double")
    bk = baskets.build_baskets(lines)
    m = baskets.mine(bk, 0.2)
    got = {(r["antecedents"], r["consequents"]): (r["support"], r["confidence"], r["lift"])
           for r in baskets.association_rules(m.itemsets, 1.0, 0.3).collect()}
    want = brute_rules([set(s) for s in sets], 0.2, 1.0, 0.3)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "a"]), st.integers(0, 3),
                          st.integers(0, 5), st.one_of(st.none(), st.sampled_from("xy")),
                          st.one_of(st.none(), st.sampled_from("pq"))),
                min_size=1, max_size=50))
def test_blocked_fill_multi_column_struct_order(spark, data):
    # block = chunk of the first order key; seq = (k1, position) as a struct
    recs = [(g, k1, k1 * 100 + k2 * 10 + i % 10, i, u, v)
            for i, (g, k1, k2, u, v) in enumerate(data)]
    df = (spark.createDataFrame(recs, "file string, block long, k long, i long, u string, "
                                      "v string")
          .withColumn("seq", F.struct("k", "i")))
    a = forward_fill_blocked(df, ["u", "v"])
    b = forward_fill(df, ["u", "v"], ["file"], ["block", "k", "i"])
    assert rows(a, "file", "i", "u", "v") == rows(b, "file", "i", "u", "v")


def test_mining_adds_up_equal_baskets_and_builds_no_tree(spark, monkeypatch):
    """Equal baskets are one row with a count; a basket without items counts in the base, a repeated item once."""
    from pyspark.ml.fpm import FPGrowth

    def tree(*_):
        raise AssertionError("a tree of baskets in a task")
    monkeypatch.setattr(FPGrowth, "fit", tree)
    sets = [("a", "b", "c")] * 40 + [("b", "c")] * 30 + [("a", "d")] * 5 + [()] * 10 + [("c", "e", "a", "b")] * 15 + [("a", "a")] * 2 + [None] * 3
    bk = spark.createDataFrame([(list(x) if x is not None else None,) for x in sets], "items array<string>")
    for support in (0.06, 0.6):
        n = len(sets)
        held = [set(x or ()) for x in sets]
        want = {}
        for size in range(1, 6):
            for c in itertools.combinations("abcde", size):
                freq = sum(set(c) <= h for h in held)
                if freq and freq / n >= support:
                    want[c] = (size, freq, freq / n)
        m = baskets.mine(bk, support, 3)
        assert m.n_baskets == n
        assert {tuple(r["items"]): (r["size"], r["freq"], r["support"]) for r in m.itemsets.collect()} == want
