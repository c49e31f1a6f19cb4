"""Cases of the third round: quote states, bounded pairs, roll-ups of sets, exact quantiles, series that compose."""

import csv
import io
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillroll.operators import baskets, quantiles, series, staffing
from tillroll.sources.reports import csv_split, read_report_lines, split_cells


# --- the report reader -------------------------------------------------------------------------
def read_small(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        return [(r.line, r.raw) for r in read_report_lines(spark, str(path)).orderBy("block", "seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def filled(rows):
    """Rows that hold something, empty cells as None."""
    return [[c or None for c in row] for row in rows if any(c and c.strip() for c in row)]


def by_python(text):
    return filled(csv.reader(io.StringIO(text, newline="")))


def test_stray_inch_marks_lose_no_row(spark, tmp_path):
    rows = [f"branch {i},item {i},{i}" for i in range(2000)]
    rows[300] = 'branch 300,pipe 5" wide,300'
    rows[1500] = 'branch 1500,pipe 7" wide,1500'
    (tmp_path / "r.csv").write_text("\n".join(rows) + "\n")
    got = read_small(spark, tmp_path / "r.csv", 4096)
    assert [line for line, _ in got] == rows
    assert got[300][1] == ["branch 300", 'pipe 5" wide', "300"]


def test_quoted_cells_across_splits_against_the_csv_module(spark, tmp_path):
    r = random.Random(7)
    pieces = ['a', '"', '""', ',', '\n', 'x y', '"q, r"', '"two\nlines"', '5"', '"say ""hi"""', '"\n"', ' "', '"z"z']
    for case in range(6):
        text = "h,h\n" + "".join(r.choice(pieces) for _ in range(120))
        rows = by_python(text)
        # a cell that never closes is the one case that the csv module reads otherwise
        text = text.rstrip("\n") + '\nend,"1"\n'
        rows = by_python(text)
        if not rows or rows[-1] != ["end", "1"]:
            text, rows = "h,h\n", [["h", "h"]]
        (tmp_path / f"{case}.csv").write_text(text, newline="")
        got = read_small(spark, tmp_path / f"{case}.csv", 16)
        assert filled([raw for _, raw in got]) == rows, text


def test_a_cell_that_never_closes_keeps_its_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,"two\nlines"\nb,"open\nc,1\nd,"x"\n')
    got = read_small(spark, tmp_path / "r.csv", 8)
    assert [line for line, _ in got][0] == 'a,"two\nlines"'
    (tmp_path / "s.csv").write_text('a,1\nb,"open\nc,2\nd,3\n')
    assert [line for line, _ in read_small(spark, tmp_path / "s.csv", 8)] == ["a,1", 'b,"open', "c,2", "d,3"]


@settings(max_examples=8, deadline=None)
@given(lines=st.lists(st.text(alphabet='a", \u00e9', max_size=14), min_size=30, max_size=60))
def test_cells_of_one_line_against_the_csv_module(spark, lines):
    closed = []
    for line in lines:
        rows = list(csv.reader(io.StringIO(line + "\nend", newline="")))
        if len(rows) == 2:
            closed.append((line, [c or None for c in rows[0]] or [None]))
    if closed:
        df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(closed)], "i int, line string")
        got = [r.c for r in df.select("i", csv_split("line").alias("c")).orderBy("i").collect()]
        plain = [[c or None for c in row] for row in got]
        assert plain == [want for _, want in closed]


def test_text_is_scanned_once(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\nc,d\n")
    plan = split_cells(read_report_lines(spark, str(tmp_path / "r.csv")))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan parquet" in plan


# --- bounded pairs -----------------------------------------------------------------------------
def test_top_pairs_equal_the_full_count(spark):
    r = random.Random(3)
    for head, n_items in ((4, 30), (64, 12), (2, 200)):
        sets = [{f"i{min(int(r.expovariate(0.15)), n_items)}" for _ in range(r.randrange(0, 9))} for _ in range(150)]
        b = spark.createDataFrame([("m", str(i), sorted(s)) for i, s in enumerate(sets)], "branch string, customer string, items array<string>")
        want = [tuple(x) for x in baskets.item_pairs(b, 7).collect()]
        got = [tuple(x) for x in baskets.top_pairs(b, 7, head=head).collect()]
        assert got == want
        counts = Counter(p for s in sets for p in combinations(sorted(s), 2))
        first = sorted((-n, p) for p, n in counts.items())[:7]
        assert [(a, c) for a, c, *_ in got] == [p for _, p in first]


def test_top_pairs_of_few_or_no_baskets(spark):
    none = spark.createDataFrame([], "branch string, customer string, items array<string>")
    assert baskets.top_pairs(none).collect() == []
    one = spark.createDataFrame([("m", "1", ["a"]), ("m", "2", []), ("m", "3", ["b", "c"])], none.schema)
    assert [(x.antecedents, x.consequents) for x in baskets.top_pairs(one, 5, head=1).collect()] == [("b", "c")]


def test_top_pairs_leave_rare_items_out(spark, monkeypatch):
    """Only items that can still be in a top pair are ever paired."""
    sets = [["a", "b", f"rare{i}", f"odd{i}"] for i in range(50)]
    b = spark.createDataFrame([("m", str(i), sorted(s)) for i, s in enumerate(sets)], "branch string, customer string, items array<string>")
    paired, full = [], baskets.pair_counts

    def watched(part, keys, chunk):
        paired.append(part.select(F.explode("items").alias("i")).distinct().count())
        return full(part, keys, chunk)
    monkeypatch.setattr(baskets, "pair_counts", watched)
    (row,) = baskets.top_pairs(b, 1, head=2).collect()
    assert (row.antecedents, row.consequents, row.support) == ("a", "b", 1.0) and paired == [2]


# --- sets that roll up ---------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["long", "string"])
def test_staff_rollup_against_sets(spark, kind):
    r = random.Random(1)
    rows = [(r.choice([r.randrange(9), -r.randrange(4), 10 ** 12 + r.randrange(3), None]), r.choice(["x", "y", None]),
             f"2025-0{r.randrange(1, 4)}-0{r.randrange(1, 9)}", f"{r.randrange(0, 24):02d}.00.00", r.choice([8.0, 0.1])) for _ in range(400)]
    df = spark.createDataFrame([(None if e is None else str(e) if kind == "string" else e, *x) for e, *x in rows],
                               f"employee_id {kind}, branch string, date string, punch_in string, work_hours double").withColumn("date", F.to_date("date"))
    got = {(x.level, x.branch, x.shift, str(x.date), x.day_of_week, x.month): x.distinct_staff for x in staffing.staff_rollup(df).collect()}
    punches = [p for p in staffing.assign_shifts(df).collect() if p.branch and p.employee_id is not None]
    sets = {}
    for p in punches:
        m = p.date.strftime("%Y-%m")
        for key in (("day", p.branch, p["shift"], str(p.date), p.day_of_week, m), ("weekday", p.branch, p["shift"], "None", p.day_of_week, None),
                    ("month", p.branch, p["shift"], "None", None, m), ("branch", p.branch, None, "None", None, None),
                    ("network", None, None, "None", None, None)):
            sets.setdefault(key, set()).add(p.employee_id)
    assert got == {k: len(v) for k, v in sets.items()}


def test_staff_rollup_reads_the_punches_once(spark):
    from tillroll.plans.registry import QUERIES
    plan = QUERIES["staff_rollup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Expand" in plan


# --- exact quantiles -------------------------------------------------------------------------------
@pytest.mark.parametrize("small, splitters", [(4096, 63), (5, 3), (1, 7)])
def test_quantiles_against_sorting(spark, small, splitters):
    r = np.random.default_rng(small)
    groups = {"normal": r.normal(size=700).tolist(), "one": [3.0], "two": [1.0, 2.0], "equal": [5.0] * 300,
              "mostly": [0.0] * 200 + [1.0, -1.0, 2.0], "wide": (10.0 ** r.uniform(-300, 300, 400)).tolist(),
              "special": [float("inf"), float("-inf"), float("nan"), 0.0, 1.0, -0.5]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(None, 1.0), ("null", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {x.g: x for x in quantiles.exact_quantiles(df, ["g"], "v", probs, splitters, small).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        s, n = sorted(vs, key=lambda v: (v != v, v)), len(vs)
        assert got[g].n == n
        for p, name in zip(probs, ("q00", "q10", "q50", "q90", "q100")):
            assert repr(got[g][name]) == repr(s[max(1, n - int(np.floor(n - p * n))) - 1]), (g, p)
        if g not in ("special",):
            assert got[g].median == s[(n - 1) // 2] * 0.5 + s[n // 2] * 0.5


def test_quantiles_without_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.exact_quantiles(df, ["g"], "v").collect() == []


# --- series that compose ---------------------------------------------------------------------------
def test_parts_of_a_series_give_the_fit_of_the_whole(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for b, n in (("a", 40), ("b", 1), ("c", 2), ("d", 13)):
        y = np.round(r.uniform(100, 9000, n), 2)
        rows += [(b, 2020 + i // 12, i % 12 + 1, float(v)) for i, v in enumerate(y)]
        t = np.arange(1, n + 1)
        want[b] = np.polyfit(t, y, 1) if n > 1 else (0.0, y[0])
    df = spark.createDataFrame([*rows, (None, 2020, 1, 5.0)], "branch string, year int, month_num int, total_sales double")
    for cut in (F.col("year"), F.lit(0), F.floor((F.col("year") * 12 + F.col("month_num")) / 5), F.col("year") * 12 + F.col("month_num")):
        got = {x.branch: x for x in series.fit(series.join_parts(series.fold(df, cut))).collect()}
        assert got.keys() == want.keys()
        for b, (slope, intercept) in want.items():
            assert got[b].slope == pytest.approx(slope, abs=1e-7) and got[b].intercept == pytest.approx(intercept, rel=1e-9)
    # joining is associative: months may arrive in any number of steps
    steps = series.fold(df.where("year = 2020"))
    for year in (2021, 2022, 2023):
        steps = series.append(steps, df.where(F.col("year") == year))
    whole = series.join_parts(series.fold(df))
    assert sorted(map(tuple, steps.collect())) == sorted(map(tuple, whole.collect()))


def test_appending_reads_only_the_new_months(spark, tmp_path):
    df = spark.createDataFrame([("a", 2024, m, 10.0 * m) for m in range(1, 13)], "branch string, year int, month_num int, total_sales double")
    series.join_parts(series.fold(df)).write.parquet(str(tmp_path / "part"))
    new = spark.createDataFrame([("a", 2025, 1, 130.0), ("z", 2025, 1, 7.0)], df.schema)
    got = {x.branch: (x.n_months, x.slope) for x in series.fit(series.append(spark.read.parquet(str(tmp_path / "part")), new)).collect()}
    assert got == {"a": (13, pytest.approx(10.0)), "z": (1, 0.0)}


# --- itemsets over bitmaps ---------------------------------------------------------------------------
def test_vertical_itemsets_equal_fp_growth(spark):
    from tillroll.operators import itemsets
    r = random.Random(6)
    for support in (0.07, 0.25):
        sets = [sorted({"every", *r.sample("abcdefg", r.randrange(0, 6))}) for _ in range(200)] + [[]] * 3
        b = spark.createDataFrame([("m", str(i), s) for i, s in enumerate(sets)], "branch string, customer string, items array<string>").repartition(5)
        want = {(tuple(x["items"]), x["size"], x.freq, x.support) for x in baskets.frequent_itemsets(b, support).collect()}
        got = [(tuple(x["items"]), x["size"], x.freq, x.support) for x in itemsets.frequent_itemsets(b, support).collect()]
        assert set(got) == want and len(got) == len(want)
    pairs = itemsets.frequent_itemsets(b, 0.25, max_size=2).collect()
    assert {len(x["items"]) for x in pairs} == {1, 2}
    assert itemsets.frequent_itemsets(b.limit(0), 0.1).collect() == []


def test_an_item_of_every_basket_is_no_large_group(spark):
    """The hot item has one row a chunk, not one a basket."""
    from tillroll.operators import itemsets
    b = spark.range(50_000).select(F.col("id").alias("customer"), F.array(F.lit("hot"), F.concat(F.lit("i"), F.col("id") % 7)).alias("items")).repartition(4)
    rows = itemsets.item_bitmaps(b).groupBy("items").count().collect()
    assert max(x["count"] for x in rows) <= 8 and {x["items"][0] for x in rows} == {"hot", *(f"i{k}" for k in range(7))}


# --- footers, keywords ----------------------------------------------------------------------------------
def test_profile_reads_footers_only(spark, tmp_path):
    from tillroll.sources.profile import column_profile
    df = spark.createDataFrame([(1, "x", None, [1]), (3, None, 2.5, [2]), (-2, "y", 0.0, None)], "a long, b string, c double, d array<int>")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    profile = column_profile(spark, {"t": str(tmp_path / "t")})
    assert sorted(map(tuple, profile.collect())) == [("t", "a", "bigint", 3, 0, -2.0, 3.0), ("t", "b", "string", 3, 1, None, None), ("t", "c", "double", 3, 1, 0.0, 2.5)]
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan and "FileScan" not in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown", "false") == "false"


def test_profile_of_columns_without_bounds(spark, tmp_path):
    """A row group of nulls only and a NaN leave no bounds in the footer: the columns are read."""
    from tillroll.sources.profile import column_profile
    for i, v in enumerate((None, 2.0, float("nan"))):
        spark.createDataFrame([(i, v)], "a int, c double").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    got = {r.column: r for r in column_profile(spark, {"t": str(tmp_path / "t")}).collect()}
    assert (got["a"].n_rows, got["a"].n_nulls, got["a"].least, got["a"].greatest) == (3, 0, 0.0, 2.0)
    assert (got["c"].n_rows, got["c"].n_nulls, got["c"].least) == (3, 1, 2.0)


@settings(max_examples=6, deadline=None)
@given(texts=st.lists(st.text(alphabet="abc .", max_size=25), min_size=1, max_size=20),
       words=st.lists(st.text(alphabet="abc .", min_size=1, max_size=4), min_size=1, max_size=12, unique=True))
def test_keywords_in_one_pass_equal_one_by_one(spark, texts, words):
    from tillroll.operators import topics
    table = {"one": words[::2], "two": words[1::2] or ["zz"]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    a = topics.classify_topics(df, "text", table).orderBy("i").collect()
    b = topics.classify_topics_one_pass(df, "text", table).orderBy("i").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]
