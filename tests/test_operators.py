"""Operator semantics on small hand-made inputs, checked against brute force."""
import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from tillroll.functions import constants as K
from tillroll.functions.scalar import (clean_number, duration_hours, punch_hour, segment_of,
                                       shift_of)
from tillroll.operators import baskets, demand, segments, staffing, topics


def one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_clean_number(spark):
    vals = ["1,234.50", '"12"', "-", "", "nan", "abc", " 7 ", "0.00", None, '"1,000"', "--"]
    assert one_col(spark, vals, clean_number) == [
        1234.5, 12.0, 0.0, None, None, None, 7.0, 0.0, None, 1000.0, None]


def test_duration_hours(spark):
    got = one_col(spark, ["11.58.21", "173:36:38", "abc", "a.b.c", "00.00.00"], duration_hours)
    assert got[0] == pytest.approx(11 + 58 / 60 + 21 / 3600)
    assert got[1] == pytest.approx(173 + 36 / 60 + 38 / 3600)
    assert got[2] == 0.0 and got[3] is None and got[4] == 0.0


def test_shift_is_total_over_the_day(spark):
    punches = [f"{h:02d}.15.00" for h in range(24)] + [None, "x"]
    got = one_col(spark, punches, lambda c: shift_of(punch_hour(c)))
    for h in range(24):
        want = (K.SHIFT_MORNING if 6 <= h < 14 else
                K.SHIFT_AFTERNOON if 14 <= h < 22 else K.SHIFT_NIGHT)
        assert got[h] == want, h
    assert got[24:] == [K.SHIFT_UNKNOWN, K.SHIFT_UNKNOWN]


def test_segment_precedence(spark):
    items = ["Frappe Mocha", "HOT CHOCOLATE", "Chimney Cake", "mocha shake", "donut box",
             "water", "Chimney Roll", "Iced Latte"]
    assert one_col(spark, items, segment_of) == [
        "milkshake", "coffee", "chimney_cake", "milkshake", "chimney_cake", "other",
        "chimney_cake", "coffee"]


def test_topics(spark):
    texts = ["How many staff do we need for the night shift?",
             "Which milkshake sells best?",
             "Should we open a new branch in a new location?",
             "hello there",
             "bundle staff",                     # tie: staffing comes first
             "What will demand be next month? forecast please"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r["topic"] for r in topics.classify_topics(df).orderBy("id").collect()]
    assert got == ["staffing", "beverage", "expansion", "overview", "staffing", "demand"]
    scores = topics.classify_topics(df).orderBy("id").collect()
    assert scores[1]["score_beverage"] == 2          # "milkshake" and "shake" both count


BASKET_LINES = [
    # branch, customer, item, qty, price
    ("b", "c1", "latte", 1.0, 5.0), ("b", "c1", "cake", 1.0, 3.0), ("b", "c1", "donut", 1.0, 2.0),
    ("b", "c2", "latte", 1.0, 5.0), ("b", "c2", "cake", 2.0, 3.0), ("b", "c2", "donut", 1.0, 2.0),
    ("b", "c3", "latte", 1.0, 5.0), ("b", "c3", "cake", 1.0, 3.0),
    ("b", "c4", "latte", 1.0, 5.0), ("b", "c4", "shake", 1.0, 4.0), ("b", "c4", "donut", 1.0, 2.0),
    ("b", "c5", "cake", 1.0, 3.0), ("b", "c5", "donut", 1.0, 2.0),
    ("b", "c6", "latte", 1.0, 5.0), ("b", "c6", "delivery charge", 1.0, 1.0),
    ("b", "c7", "shake", 1.0, 4.0), ("b", "c7", "shake", -1.0, 4.0),     # sums to 0: absent
    ("b", "c8", "refund", -2.0, 4.0),                                    # negative: present
    ("b", "c9", "free dip", 1.0, 0.0),                                   # unpaid: dropped
]


def brute_rules(sets, min_support, min_lift, min_conf):
    n = len(sets)
    items = sorted(set().union(*sets))
    supp = {}
    for k in range(1, len(items) + 1):
        for combo in itertools.combinations(items, k):
            c = sum(1 for s in sets if set(combo) <= s)
            if c / n >= min_support:
                supp[combo] = c / n
    out = {}
    for iset, s in supp.items():
        if len(iset) < 2:
            continue
        for r in range(1, len(iset)):
            for ante in itertools.combinations(iset, r):
                cons = tuple(x for x in iset if x not in ante)
                conf = s / supp[ante]
                lift = conf / supp[cons]
                if lift >= min_lift and conf >= min_conf:
                    out[(", ".join(ante), ", ".join(cons))] = (s, conf, lift)
    return out


def test_baskets_and_rules_match_brute_force(spark):
    lines = spark.createDataFrame(BASKET_LINES, "branch string, customer string, item string, "
                                                "qty double, price double")
    bk = baskets.build_baskets(lines)
    got = {r["customer"]: r["items"] for r in bk.collect()}
    assert got["c7"] == [] and got["c8"] == ["REFUND"] and "c9" not in got
    assert got["c6"] == ["LATTE"]                       # delivery charge excluded
    sets = [set(v) for v in got.values()]
    m = baskets.mine(bk, 0.2)
    assert m.n_baskets == 8
    rules = baskets.association_rules(m.itemsets, 1.0, 0.1)
    want = brute_rules(sets, 0.2, 1.0, 0.1)
    have = {(r["antecedents"], r["consequents"]): (r["support"], r["confidence"], r["lift"])
            for r in rules.collect()}
    assert set(have) == set(want)
    assert any(", " in k[1] for k in want)              # multi-item consequents exercised
    for k, v in want.items():
        assert have[k] == pytest.approx(v)
    lifts = {(r["antecedents"], r["consequents"]): r["lift"] for r in rules.collect()}
    for (a, c), lift in lifts.items():                  # lift is symmetric
        if (c, a) in lifts:
            assert lifts[(c, a)] == pytest.approx(lift)
    for r in rules.collect():
        assert r["confidence"] <= 1 + 1e-12
        if r["confidence"] == 1:
            assert math.isinf(r["conviction"])
    fi = {tuple(r["items"]): r["support"] for r in m.itemsets.collect()}
    for iset, s in fi.items():                          # support is anti-monotone
        for sub in itertools.combinations(iset, len(iset) - 1):
            if sub:
                assert fi[sub] >= s


def test_item_pairs_brute_force(spark):
    lines = spark.createDataFrame(BASKET_LINES, "branch string, customer string, item string, "
                                                "qty double, price double")
    bk = baskets.build_baskets(lines)
    sets = [set(r["items"]) for r in bk.collect()]
    n = len(sets)
    cnt = {i: sum(i in s for s in sets) for i in set().union(*sets)}
    want = {}
    for a, b in itertools.combinations(sorted(cnt), 2):
        both = sum(1 for s in sets if a in s and b in s)
        if both:
            ca, cb = both / max(cnt[a], 1), both / max(cnt[b], 1)
            want[(a, b)] = (both / n, max(ca, cb), ca / max(cnt[b] / n, 1e-9))
    got = {(r["antecedents"], r["consequents"]): (r["support"], r["confidence"], r["lift"])
           for r in baskets.item_pairs(bk, None).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_forecast_edge_cases(spark):
    m = spark.createDataFrame(
        [("one", 2025, 5, 100.0), ("two", 2025, 11, 10.0), ("two", 2026, 1, 30.0)],
        "branch string, year int, month_num int, total_sales double")
    fc = {(r["branch"], r["step"]): r for r in demand.demand_forecast(m, 2).collect()}
    assert fc[("one", 1)]["forecast"] == pytest.approx(100.0)   # one point: constant fit
    assert fc[("one", 1)]["period"] == "June 2025"
    # dense index: t = 1, 2 for Nov 2025 and Jan 2026; next t = 3, 4 -> 50, 70
    assert fc[("two", 1)]["forecast"] == pytest.approx(50.0)
    assert fc[("two", 2)]["forecast"] == pytest.approx(70.0)
    assert fc[("two", 1)]["period"] == "February 2026"
    g = {r["branch"]: r["growth_pct"] for r in demand.demand_growth(m).collect()}
    assert g == {"one": 0.0, "two": pytest.approx(200.0)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["n", "s", "e"]),
                          st.sampled_from(["LATTE", "SHAKE", "CAKE", "TEA", "FRAPPE X"]),
                          st.floats(min_value=0, max_value=1000, allow_nan=False)),
                min_size=1, max_size=30))
def test_segment_shares_sum_to_100(spark, data):
    df = spark.createDataFrame([(b, i, 1.0, a) for b, i, a in data],
                               "branch string, item string, qty double, total_amount double")
    share = segments.segment_share(segments.classify(df))
    for r in share.groupBy("branch").agg(F.sum("share_pct").alias("s"),
                                         F.first("branch_total").alias("t")).collect():
        if r["t"]:
            assert r["s"] == pytest.approx(100.0)


def test_staffing_counts_distinct_employees(spark):
    att = spark.createDataFrame(
        [(1, "b", "2025-12-01", "07.00.00", 8.0), (1, "b", "2025-12-01", "08.00.00", 2.0),
         (2, "b", "2025-12-01", "09.00.00", 8.0), (3, "b", "2025-12-02", "07.30.00", 0.5),
         (3, "b", "2025-12-02", "15.00.00", 6.0), (None, None, "2025-12-02", "07.00.00", 5.0)],
        "employee_id int, branch string, date string, punch_in string, work_hours double"
    ).withColumn("date", F.to_date("date"))
    s = {(r["branch"], r["shift"]): r for r in staffing.shift_staffing(att).collect()}
    assert set(s) == {("b", K.SHIFT_MORNING), ("b", K.SHIFT_AFTERNOON)}
    m = s[("b", K.SHIFT_MORNING)]
    assert (m["mean_staff"], m["max_staff"], m["min_staff"], m["days_observed"],
            m["recommended_staff"]) == (2.0, 2, 2, 1, 2)


def test_configurable_shift_bins(spark):
    from tillroll.functions.scalar import shift_of_bins
    bins = [("early", 5, 13), ("late", 13, 21), ("overnight", 21, 29)]
    got = one_col(spark, [0, 4, 5, 12, 13, 20, 21, 23, None],
                  lambda c: shift_of_bins(c, bins, "overnight"), "int")
    assert got == ["overnight", "overnight", "early", "early", "late", "late", "overnight",
                   "overnight", K.SHIFT_UNKNOWN]
    default = [(K.SHIFT_MORNING, 6, 14), (K.SHIFT_AFTERNOON, 14, 22), (K.SHIFT_NIGHT, 22, 30)]
    hours = list(range(24)) + [None]
    assert one_col(spark, hours, lambda c: shift_of_bins(c, default, K.SHIFT_NIGHT), "int") == \
        one_col(spark, hours, shift_of, "int")


def test_exclusion_list_as_data(spark):
    lines = spark.createDataFrame(BASKET_LINES, "branch string, customer string, item string, "
                                                "qty double, price double")
    excl = spark.createDataFrame([(" delivery charge",), ("Service Charge",)], "name string")
    a = baskets.build_baskets(lines, exclude=excl)
    b = baskets.build_baskets(lines)
    assert rows(a) == rows(b)


def test_segment_performance_include_missing(spark):
    df = spark.createDataFrame([("n", "LATTE", 1.0, 10.0), ("s", "SHAKE", 1.0, 10.0),
                                ("s", "TEA", 1.0, 90.0)],
                               "branch string, item string, qty double, total_amount double")
    share = segments.segment_share(segments.classify(df))
    base = rows(segments.segment_performance(share), "branch", "segment", "status")
    assert base == [("n", "coffee", "performing"), ("s", "milkshake", "performing")]
    full = rows(segments.segment_performance(share, include_missing=True),
                "branch", "segment", "status")
    assert full == [("n", "coffee", "performing"), ("n", "milkshake", "missing"),
                    ("s", "coffee", "missing"), ("s", "milkshake", "performing")]


def test_order_baskets_equal_generic_build(spark):
    from conftest import SF
    from tillroll.sources import tables as tb
    t = tb.Tables(spark, SF)
    a = tb.order_baskets(t).select("branch", "customer", F.array_join("items", "|").alias("i"))
    b = baskets.build_baskets(tb.delivery_lines(t)).select(
        "branch", "customer", F.array_join("items", "|").alias("i"))
    assert rows(a) == rows(b)


def test_combo_summary_falls_back_to_single_items(spark):
    lines = spark.createDataFrame(BASKET_LINES, "branch string, customer string, item string, "
                                                "qty double, price double")
    m = baskets.mine(baskets.build_baskets(lines), 0.2)
    with_rules = baskets.combo_summary(baskets.association_rules(m.itemsets, 1.0, 0.1),
                                       m.n_baskets, lines)
    assert {r["method"] for r in with_rules.collect()} == {"apriori"}
    none = baskets.combo_summary(baskets.association_rules(m.itemsets, 99.0, 0.1),
                                 m.n_baskets, lines)
    got = [(r["method"], r["items"], r["qty"]) for r in none.orderBy(F.desc("qty"), "items")
           .collect()]
    assert got[:2] == [("top_single_items", "CAKE", 5.0), ("top_single_items", "LATTE", 5.0)]
    assert all(g[0] == "top_single_items" for g in got)
