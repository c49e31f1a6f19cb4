"""Cases of the second round: rule keys, thresholds, number text, quoted lines, channel totals, ties, fallbacks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tillroll.functions.scalar import clean_number, money_sum, signed
from tillroll.operators import baskets, branches, demand
from tillroll.sources.reports import csv_split, read_report_lines


def frame(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "customer int, items array<string>")


def test_items_that_hold_the_separator(spark):
    m = baskets.mine(frame(spark, [{"A, B"}, {"A", "B", "C"}, {"A", "B", "C"}, {"C"}, {"A"}, {"B"}]), 0.1)
    rules = baskets.association_rules(m.itemsets, 0.0, 0.0).collect()
    assert len(rules) == len({(r.antecedents, r.consequents) for r in rules})
    (r,) = [r for r in rules if (r.antecedents, r.consequents) == ("A, B", "C")]
    assert r.confidence == 1.0 and all(r.confidence <= 1 for r in rules)


def test_support_exactly_at_the_threshold(spark):
    found = baskets.mine(frame(spark, [{"x"}] * 7 + [{"y"}] * 93), 0.07).itemsets
    assert {(tuple(r["items"]), r.freq) for r in found.collect()} == {(("x",), 7), (("y",), 93)}


def test_long_itemsets_give_every_rule_above_the_confidence(spark):
    sets = [set("abcd")] * 4 + [set("abc")] * 3 + [{"a"}] * 2 + [{"d"}]
    got = {(r.antecedents, r.consequents): r.confidence
           for r in baskets.association_rules(baskets.mine(frame(spark, sets), 0.1).itemsets, 0.0, 0.5).collect()}
    from itertools import combinations
    expected = {}
    count = lambda s: sum(set(s) <= x for x in sets)                              # noqa: E731
    for n in range(2, 5):
        for whole in combinations("abcd", n):
            for k in range(1, n):
                for c in combinations(whole, k):
                    a = [x for x in whole if x not in c]
                    if count(whole) / count(a) >= 0.5:
                        expected[", ".join(a), ", ".join(c)] = count(whole) / count(a)
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("text, value", [
    ("5F", None), ("12d", None), ("0x1p3", None), ("1_000", None), ("1 2", None), ("NaN", None), ("", None), (",\xa00", 0.0), (' "1,234.50" ', 1234.5),
    ("-", 0.0), ("-3.5e2", -350.0), (".5", 0.5), ("5.", 5.0), ("+7", 7.0)])
def test_number_text(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(clean_number("t")).first()[0]
    assert got == value


def test_small_amounts_are_not_cut(spark):
    df = spark.range(1000).select(F.lit(0.004).alias("v"))
    assert df.agg(money_sum("v")).first()[0] == 4.0


def test_channel_that_is_not_listed_counts_in_the_total(spark):
    menu = spark.createDataFrame([("b", "TABLE", 1.0, 50.0), ("b", "DRIVE THRU", 1.0, 50.0)],
                                 "branch string, menu_channel string, num_customers double, sales double")
    assert branches.channel_mix(menu, ["TABLE"]).first().pct_table == 50.0


def test_text_rounds_the_binary_value(spark):
    df = spark.createDataFrame([(12.25,), (0.15,), (-2.5,), (0.0,)], "x double").select(signed("x", 1))
    assert [r[0] for r in df.collect()] == ["+12.2", "+0.1", "-2.5", "+0.0"]


def test_ties_take_the_first_name(spark):
    k = spark.createDataFrame([("z", 1.0, 1, 0.0, 50.0), ("a", 1.0, 1, 0.0, 50.0)],
                              "branch string, total_revenue double, num_customers long, monthly_growth_pct double, revenue_share_pct double")
    assert branches.expansion_signals(k).first().saturated_branch == "a"
    months = [(b, 2025, m, 100.0 - 20 * m) for b in ("z", "a") for m in (1, 2)]
    assert demand.worst_decline(spark.createDataFrame(months, "branch string, year int, month_num int, total_sales double")).first().worst_branch == "a"


def test_many_quoted_cells(spark):
    line = ",".join(f'"cell, {i}"' for i in range(5000))
    cells = spark.createDataFrame([(line,)], "l string").select(csv_split("l").alias("c")).first().c
    assert len(cells) == 5000 and cells[4999] == "cell, 4999"


def test_quoted_line_breaks_stay_one_record(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b\n"x ""y""",1\n"street 1\nfloor ""2""\ntown",2\nlast,"one\ntwo"\nend,3\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")          # records span file splits
    try:
        rows = [r.line for r in read_report_lines(spark, str(tmp_path / "r.csv")).orderBy("block", "seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == ["a,b", '"x ""y""",1', '"street 1\nfloor ""2""\ntown",2', 'last,"one\ntwo"', "end,3"]


def test_pairs_stand_in_where_nothing_is_frequent(spark):
    sets = [{f"a{i}", f"b{i}"} for i in range(60)]
    b = spark.createDataFrame([("m", str(i), sorted(s)) for i, s in enumerate(sets)], "branch string, customer string, items array<string>")
    lines = b.select(F.explode("items").alias("item"), F.lit(1.0).alias("qty"), F.lit(1.0).alias("price"))
    m = baskets.mine(b, 0.5)
    got = baskets.combo_summary(baskets.association_rules(m.itemsets), m.n_baskets, lines, 10, m.itemsets, b).collect()
    assert len(got) == 10 and {r.method for r in got} == {"apriori"} and all(r.confidence == 1 for r in got)


def test_queries_take_each_path():
    """The registered queries reach the fallbacks and itemsets of three on the driver's tables."""
    import os
    import sys
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tillroll.plans.oracle import ORACLE
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    assert con.sql(f"SELECT count(*) FROM ({ORACLE['association_rules_triples']}) WHERE contains(consequents, ',')").fetchall()[0][0] > 0
    assert con.sql(f"SELECT DISTINCT method FROM ({ORACLE['combo_summary_single']})").fetchall() == [("top_single_items",)]
    assert con.sql(f"SELECT DISTINCT method FROM ({ORACLE['combo_summary_pairs']})").fetchall() == [("apriori",)]
