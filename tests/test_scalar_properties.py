"""Native number/duration/punch parsing agrees with plain-Python rules on random text."""
import math

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tillroll.functions.scalar import clean_number, decimal_text, duration_hours, punch_hour


def py_clean_number(v):
    """Rule: strip, drop ',' and '"'; '-' is 0; empty / NaN text / unparsable is None."""
    if v is None:
        return None
    s = v.strip().replace(",", "").replace('"', "")
    if s == "-":
        return 0.0
    try:
        x = float(s)
    except ValueError:
        return None
    return None if math.isnan(x) else x


LIMIT = 2 ** 63   # Spark integers are 64-bit; Python's are unbounded


def py_int(p):
    x = int(p)
    if not -LIMIT <= x < LIMIT:
        raise ValueError(p)
    return x


def py_duration(v):
    parts = v.replace(".", ":").split(":")
    if len(parts) != 3:
        return 0.0
    try:
        h, m, s = (py_int(p) for p in parts)
    except ValueError:
        return None
    return h + m / 60 + s / 3600


def py_hour(v):
    try:
        return py_int(v.replace(".", ":").strip().split(":")[0])
    except ValueError:
        return None


number_text = st.text(alphabet="0123456789,.-+eE\" \t\u00a0", max_size=12)
clock_text = st.text(alphabet="0123456789.:+- ", max_size=10)


def evaluate(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn("x")).collect()]


@settings(max_examples=10, deadline=None)
@given(st.lists(number_text, min_size=1, max_size=40))
def test_clean_number_matches_rule(spark, values):
    got = evaluate(spark, values, clean_number)
    for v, g in zip(values, got):
        want = py_clean_number(v)
        if want is None or g is None:
            assert want is None and g is None, (v, g, want)
        else:
            assert g == want, (v, g, want)


@settings(max_examples=10, deadline=None)
@given(st.lists(clock_text, min_size=1, max_size=40))
def test_duration_and_punch_hour_match_rule(spark, values):
    durations = evaluate(spark, values, duration_hours)
    hours = evaluate(spark, values, punch_hour)
    for v, d, h in zip(values, durations, hours):
        want = py_duration(v)
        if want is None or d is None:
            assert want is None and d is None, (v, d, want)
        else:
            assert d == want or abs(d - want) <= 1e-9 * max(1.0, abs(want)), (v, d, want)
        assert h == py_hour(v), (v, h, py_hour(v))


from tillroll.functions import constants as K  # noqa: E402
from tillroll.functions.scalar import segment_of  # noqa: E402


def py_segment(item):
    up = item.upper()
    if any(k in up for k in K.MILKSHAKE_KEYWORDS):
        return "milkshake"
    if any(k in up for k in K.COFFEE_KEYWORDS):
        return "coffee"
    if any(k in up for k in K.CHIMNEY_KEYWORDS):
        return "chimney_cake"
    return "other"


def py_topic(text):
    q = text.lower()
    scores = {t: sum(1 for kw in kws if kw in q) for t, kws in K.TOPIC_KEYWORDS.items()}
    best = max(scores, key=lambda t: scores[t])
    return best if scores[best] > 0 else K.TOPIC_FALLBACK


fragments = st.sampled_from(["latte", "SHAKE", "frappe", "Mocha", "conut", "chimney", "tea",
                             " ", "milk", "hot chocolate", "Flat White", "cake", "x"])
words = st.sampled_from(["staff", "shift", "combo", "pair", "demand", "forecast", "open",
                         "site", "coffee", "milkshake", "bev", "how many staff", "hello", " ",
                         "Shifts", "BUNDLE", "new store", "units", "drink"])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(fragments, max_size=4).map("".join), min_size=1, max_size=30))
def test_segment_matches_rule(spark, items):
    assert evaluate(spark, items, segment_of) == [py_segment(i) for i in items]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(words, max_size=6).map(" ".join), min_size=1, max_size=30))
def test_topic_matches_rule(spark, texts):
    from tillroll.operators.topics import classify_topics
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r["topic"] for r in classify_topics(df).orderBy("id").collect()]
    assert got == [py_topic(t) for t in texts]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=1.0, max_value=1e9, allow_nan=False), min_size=2,
                max_size=14))
def test_forecast_matches_numpy_least_squares(spark, sales):
    import numpy as np

    from tillroll.operators.demand import demand_forecast
    rows_ = [("b", 2024 + (i // 12), i % 12 + 1, v) for i, v in enumerate(sales)]
    m = spark.createDataFrame(rows_, "branch string, year int, month_num int, total_sales double")
    got = [r["forecast"] for r in demand_forecast(m, 3).orderBy("step").collect()]
    t = np.arange(1, len(sales) + 1)
    slope, intercept = np.polyfit(t, np.array(sales), 1)
    want = [max(intercept + slope * (len(sales) + k), 0.0) for k in (1, 2, 3)]
    scale = max(sales)
    for g, w in zip(got, want):
        assert abs(g - w) <= 1e-6 * scale, (g, w)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["n", "s", "e"]),
                          st.floats(min_value=0.0, max_value=30.0, allow_nan=False)),
                min_size=1, max_size=40))
def test_hours_stats_match_pandas(spark, data):
    import pandas as pd

    from tillroll.operators.staffing import hours_by_branch
    att = spark.createDataFrame(data, "branch string, work_hours double")
    got = {r["branch"]: r for r in hours_by_branch(att).collect()}
    pdf = pd.DataFrame(data, columns=["branch", "work_hours"])
    pdf = pdf[pdf["work_hours"] > 0.5]
    want = pdf.groupby("branch")["work_hours"].agg(["mean", "median", "min", "max", "count"])
    assert set(got) == set(want.index)
    for b, w in want.iterrows():
        g = got[b]
        assert g["avg_hours"] == pytest.approx(w["mean"])
        assert g["median_hours"] == pytest.approx(w["median"])
        assert (g["min_hours"], g["max_hours"], g["shift_records"]) == (w["min"], w["max"],
                                                                        w["count"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["n", "s"]),
                          st.sampled_from(["DELIVERY", "TABLE", "TAKE AWAY"]),
                          st.integers(min_value=0, max_value=10 ** 7)),
                min_size=1, max_size=20))
def test_channel_mix_sums_to_100(spark, data):
    from tillroll.operators.branches import channel_mix
    menu = spark.createDataFrame([(b, c, x / 100) for b, c, x in data],
                                 "branch string, menu_channel string, sales double")
    for r in channel_mix(menu).collect():
        total = r["sales_delivery"] + r["sales_table"] + r["sales_take_away"]
        pct = r["pct_delivery"] + r["pct_table"] + r["pct_take_away"]
        if total >= 1:
            assert pct == pytest.approx(100.0)


def py_shift(hour):
    if hour is None:
        return K.SHIFT_UNKNOWN
    if 6 <= hour < 14:
        return K.SHIFT_MORNING
    if 14 <= hour < 22:
        return K.SHIFT_AFTERNOON
    return K.SHIFT_NIGHT


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from(["n", "s"]), st.integers(1, 5),
                          st.integers(0, 23), st.floats(min_value=0.0, max_value=12.0,
                                                        allow_nan=False)),
                min_size=1, max_size=40))
def test_shift_staffing_matches_pandas(spark, data):
    import datetime as dt
    import math as m

    import pandas as pd

    from tillroll.operators.staffing import shift_staffing
    recs = [(e, b, dt.date(2025, 12, d), f"{h:02d}.10.00", w) for e, b, d, h, w in data]
    att = spark.createDataFrame(recs, "employee_id int, branch string, date date, "
                                      "punch_in string, work_hours double")
    got = {(r["branch"], r["shift"]): (r["mean_staff"], r["max_staff"], r["min_staff"],
                                       r["days_observed"], r["recommended_staff"])
           for r in shift_staffing(att).collect()}
    pdf = pd.DataFrame(recs, columns=["employee_id", "branch", "date", "punch_in", "work_hours"])
    pdf = pdf[pdf["work_hours"] > 0.5].copy()
    pdf["shift"] = [py_shift(int(p.split(".")[0])) for p in pdf["punch_in"]]
    daily = pdf.groupby(["branch", "shift", "date"])["employee_id"].nunique()
    want = {}
    for (b, s), g in daily.groupby(level=[0, 1]):
        mean = g.mean()
        want[(b, s)] = (mean, g.max(), g.min(), len(g), int(min(m.ceil(mean * 1.15), g.max())))
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0])
        assert got[k][1:] == want[k][1:]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=-100.0, max_value=1e7, allow_nan=False), min_size=1,
                max_size=12))
def test_growth_rates_match_formulas(spark, sales):
    from tillroll.operators.branches import branch_growth
    from tillroll.operators.demand import demand_growth
    rows_ = [("b", 2025, i + 1, v) for i, v in enumerate(sales)]
    m = spark.createDataFrame(rows_, "branch string, year int, month_num int, total_sales double")
    g = demand_growth(m).collect()[0]["growth_pct"]
    c = branch_growth(m).collect()[0]["monthly_growth_pct"]
    first, last, n = sales[0], sales[-1], len(sales)
    want_g = (last - first) / first * 100 if n > 1 and first > 0 else 0.0
    if n >= 2 and first > 0 and last / first >= 0:
        want_c = ((last / first) ** (1 / max(n - 1, 1)) - 1) * 100
        assert c == pytest.approx(want_c, rel=1e-9, abs=1e-9)
    elif not (n >= 2 and first > 0):
        assert c == 0.0
    assert g == pytest.approx(want_g, rel=1e-9, abs=1e-9)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["n", "s", "e"]),
                          st.sampled_from(["Iced Latte", "Vanilla Shake", "Chimney Roll",
                                           "Water", "Frappe", "Donut"]),
                          st.integers(min_value=0, max_value=10 ** 6)),
                min_size=1, max_size=40))
def test_segment_share_matches_pandas(spark, data):
    import pandas as pd

    from tillroll.operators.segments import classify, segment_share
    recs = [(b, i, 1.0, c / 100) for b, i, c in data]
    df = spark.createDataFrame(recs, "branch string, item string, qty double, total_amount double")
    got = {(r["branch"], r["segment"]): (r["segment_revenue"], r["share_pct"])
           for r in segment_share(classify(df)).collect()}
    pdf = pd.DataFrame(recs, columns=["branch", "item", "qty", "total_amount"])
    pdf["segment"] = [py_segment(i) for i in pdf["item"]]
    seg = pdf.groupby(["branch", "segment"])["total_amount"].sum()
    tot = pdf.groupby("branch")["total_amount"].sum()
    assert set(got) == set(seg.index)
    for (b, s), v in seg.items():
        assert got[(b, s)][0] == pytest.approx(v)
        if tot[b]:
            assert got[(b, s)][1] == pytest.approx(v / tot[b] * 100)
        else:
            assert got[(b, s)][1] is None


def test_usual_numbers_take_the_short_way_with_equal_values(spark):
    texts = ["1", "-1", "12.50", "1,234.56", "1,2,3", "5,", "-,5", "-", "+1", "1e3", ".5", "5.", " 7 ", "1,234.5,6", '"9"', "5F", "0x1p3", "1\n", "", "٣", "1 2", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    # a blank before the text turns the short way off and is stripped by the long one
    long = F.concat(F.lit(" "), F.col("x"))
    for f in (clean_number, decimal_text):
        got = df.select("x", f("x"), f(long)).collect()
        assert [r[1] for r in got] == [r[2] for r in got], f
    assert [r[0] for r in df.select(clean_number("x")).orderBy("i").collect()][:7] == [1.0, -1.0, 12.5, 1234.56, 123.0, 5.0, -5.0]


def test_cells_and_values_of_any_line(spark):
    """Lines cut without patterns have the cells that the patterns give, and stripped values."""
    import random
    from tillroll.functions.scalar import compact_cells
    from tillroll.sources import reports as R
    r = random.Random(11)
    alphabet = ["a", "b c", ",", ",", '"', '"x,1"', '""', " ", "\t", "\xa0", "\x01", "é", "7"]
    texts = [f'a,"{x}",c' for x in ("", ",", '""', "p,q", " s ", "\x01")] + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, line string")
    cut = R._with_cells(df).withColumn("vals", R._values(F.col("line"), F.col("raw")))
    got = cut.select("line", "opens", "raw", "vals", R.csv_split("line").alias("by_pattern"), compact_cells(R.csv_split("line")).alias("compact"),
                     R.ends_inside(F.col("line")).alias("inside")).collect()
    for x in got:
        assert (x.raw, x.vals, x.opens) == (x.by_pattern, x.compact, x.inside), x.line
