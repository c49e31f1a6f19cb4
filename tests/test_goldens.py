"""Golden values recomputed from the analysed application's shipped reports.

Skipped when the report folder is not present.
"""
import os

import pytest
from pyspark.sql import functions as F

from conftest import REFERENCE_DATA, fixture_path
from tillroll.operators import branches, demand, staffing
from tillroll.sources.parsers import load_reports

pytestmark = pytest.mark.skipif(not os.path.isdir(REFERENCE_DATA),
                                reason="reference report files not present")


@pytest.fixture(scope="module")
def cat(spark):
    return load_reports(spark, REFERENCE_DATA)


def by_branch(df, col):
    return {r["branch"]: r[col] for r in df.collect()}


def test_parsed_counts(cat):
    assert cat["monthly_sales"].count() == 19
    assert cat["branch_revenue"].count() == 4
    assert cat["menu_avg_sales"].count() == 7
    att = cat["attendance"]
    assert att.count() == 311
    assert att.filter("work_hours > 0.5").count() == 269
    assert att.select("employee_id").distinct().count() == 16
    div = cat["division_summary"]
    assert div.count() == 110
    assert by_branch(div.groupBy("branch").count(), "count") == {
        "Conut": 28, "Conut - Tyre": 27, "Conut Jnah": 28, "Main Street Coffee": 27}


def test_demand(cat):
    m = cat["monthly_sales"]
    g = demand.demand_growth(m)
    assert by_branch(g, "historical_mean")["Conut"] == pytest.approx(778973128.57, abs=0.01)
    growth = by_branch(g, "growth_pct")
    assert round(growth["Conut"], 2) == -87.75
    assert round(growth["Main Street Coffee"], 2) == 2007.90
    fc = demand.demand_forecast(m, 3).filter(F.col("branch") == "Main Street Coffee")
    vals = [round(r["forecast"], 2) for r in fc.orderBy("step").collect()]
    assert vals == pytest.approx([3587062211.51, 4490668959.09, 5394275706.66], abs=0.02)
    periods = [r["period"] for r in fc.orderBy("step").collect()]
    assert periods == ["January 2026", "February 2026", "March 2026"]
    rank = demand.demand_ranking(m, 3).collect()
    assert [r["branch"] for r in rank] == ["Main Street Coffee", "Conut Jnah", "Conut - Tyre",
                                           "Conut"]
    top, bottom = rank[0]["avg_forecast"], rank[-1]["avg_forecast"]
    assert round((top - bottom) / max(bottom, 1) * 100, 1) == 628.1


def test_branch_kpis_and_signals(spark, cat):
    k = branches.branch_kpis(cat["monthly_sales"], cat["branch_revenue"],
                             cat["menu_avg_sales"])
    assert by_branch(k, "revenue_share_pct") == {
        "Conut": 19.47, "Conut - Tyre": 25.67, "Conut Jnah": 28.43, "Main Street Coffee": 26.43}
    assert by_branch(k, "monthly_growth_pct") == {
        "Conut": -40.84, "Conut - Tyre": 21.02, "Conut Jnah": 67.74, "Main Street Coffee": 176.24}
    assert by_branch(k, "avg_spend") == {
        "Conut - Tyre": 1642270.82, "Conut": 1414817.57, "Conut Jnah": 1123700.62,
        "Main Street Coffee": 1448286.39}
    tyre = [r for r in k.collect() if r["branch"] == "Conut - Tyre"][0]
    assert (tyre["pct_delivery"], tyre["pct_table"], tyre["pct_take_away"]) == (3.8, 0.0, 96.2)
    conut = [r for r in k.collect() if r["branch"] == "Conut"][0]
    assert (conut["pct_delivery"], conut["pct_table"], conut["pct_take_away"]) == (0.3, 94.8, 5.0)
    s = branches.expansion_signals(k).collect()[0]
    assert round(s["total_revenue"], 2) == 2193674627.45
    assert s["total_customers"] == 14546
    assert round(s["avg_monthly_growth_pct"], 2) == 56.04
    assert (s["growing_network"], s["saturated_branch_present"], s["high_customer_density"]) \
        == (True, False, True)
    assert s["signal_score"] == 2 and s["feasibility"] == "RECOMMENDED"
    cand = spark.read.csv(fixture_path("candidates.csv"), header=True, inferSchema=True)
    ranked = branches.score_candidates(cand, branches.expansion_signals(k)).collect()
    got = [(r["location"], round(r["composite_score"], 1)) for r in ranked]
    assert got == [("Verdun", 172.4), ("Sidon", 161.5), ("Jounieh", 154.5), ("Hamra", 137.9),
                   ("Mar Mikhael", 123.6), ("Beirut CBD", 115.1), ("Achrafieh", 101.4),
                   ("Dbayeh", 93.9), ("Tripoli", 86.5), ("Zarif", 42.0)]


def test_staffing(cat):
    att = cat["attendance"]
    s = staffing.shift_staffing(att)
    got = {(r["branch"], r["shift"].split()[0]):
           (round(r["mean_staff"], 4), r["max_staff"], r["min_staff"], r["days_observed"],
            r["recommended_staff"]) for r in s.collect()}
    assert got == {
        ("Conut - Tyre", "Morning"): (1.0952, 2, 1, 21, 2),
        ("Conut - Tyre", "Afternoon"): (2.3448, 4, 1, 29, 3),
        ("Conut Jnah", "Morning"): (2.1429, 4, 1, 28, 3),
        ("Conut Jnah", "Afternoon"): (1.0, 1, 1, 12, 1),
        ("Main Street Coffee", "Morning"): (1.3929, 3, 1, 28, 2),
        ("Main Street Coffee", "Afternoon"): (2.4074, 4, 1, 27, 3),
        ("Main Street Coffee", "Night"): (1.0, 1, 1, 1, 1),
    }
    k = staffing.staffing_kpis(s).collect()[0]
    assert (k["n_slots"], k["total_recommended"], k["n_at_risk"]) == (7, 15, 7)
    h = {r["branch"]: r for r in staffing.hours_by_branch(att).collect()}
    t = h["Conut - Tyre"]
    assert (round(t["avg_hours"], 4), round(t["median_hours"], 4), round(t["min_hours"], 4),
            round(t["max_hours"], 4), t["shift_records"]) == (8.6881, 8.5908, 1.1858, 23.9153, 91)
    assert h["Conut Jnah"]["shift_records"] == 72 and h["Main Street Coffee"]["shift_records"] == 106


def test_expansion_recommendations(spark, cat):
    k = branches.branch_kpis(cat["monthly_sales"], cat["branch_revenue"],
                             cat["menu_avg_sales"])
    sig = branches.expansion_signals(k)
    cand = spark.read.csv(fixture_path("candidates.csv"), header=True, inferSchema=True)
    rec = branches.expansion_recommendations(sig, branches.score_candidates(cand, sig), 2)
    got = [r["recommendation"] for r in rec.orderBy("rank").collect()]
    assert got[0] == ("Expansion is RECOMMENDED. Network shows 56.0% avg monthly growth with "
                      "14546 total customers across 4 branches.")
    assert got[1].startswith("Consider Verdun (") and got[1].endswith("composite 172.4).")
    assert got[2].startswith("Consider Sidon (") and got[2].endswith("composite 161.5).")


def test_forecast_branch_and_unknown_branch(cat):
    m = cat["monthly_sales"]
    rows_ = demand.forecast_branch(m, "Conut", 3).collect()
    assert len(rows_) == 3 and all(r["error"] is None for r in rows_)
    missing = demand.forecast_branch(m, "Nowhere", 3).collect()
    assert len(missing) == 1 and missing[0]["error"] == "No data for this branch"
    w = demand.worst_decline(m).collect()[0]
    assert w["worst_branch"] == "Conut" and round(w["worst_growth_pct"], 2) == -87.75


def test_remaining_survey_goldens(cat):
    m = cat["monthly_sales"]
    growth = {b: round(v, 2) for b, v in by_branch(demand.demand_growth(m), "growth_pct").items()}
    assert growth == {"Conut": -87.75, "Conut - Tyre": 114.48, "Conut Jnah": 691.71,
                      "Main Street Coffee": 2007.90}
    mean = by_branch(demand.demand_growth(m), "historical_mean")
    assert round(mean["Conut - Tyre"], 2) == 1035377151.15
    assert round(mean["Conut Jnah"], 2) == 1137869256.05
    assert round(mean["Main Street Coffee"], 2) == 1328045342.59
    avg = {r["branch"]: r["avg_forecast"] for r in demand.demand_ranking(m, 3).collect()}
    assert avg == pytest.approx({"Conut": 616735453.35, "Conut - Tyre": 1746603940.90,
                                 "Conut Jnah": 3243035859.59,
                                 "Main Street Coffee": 4490668959.09}, abs=0.01)
    k = {r["branch"]: r for r in branches.branch_kpis(m, cat["branch_revenue"],
                                                       cat["menu_avg_sales"]).collect()}
    for b in ("Conut Jnah", "Main Street Coffee"):
        assert (k[b]["pct_delivery"], k[b]["pct_table"], k[b]["pct_take_away"]) == (0.0, 100.0, 0.0)
    h = {r["branch"]: r for r in staffing.hours_by_branch(cat["attendance"]).collect()}
    got = {b: (round(r["avg_hours"], 4), round(r["median_hours"], 4), round(r["min_hours"], 4),
               round(r["max_hours"], 4), r["shift_records"]) for b, r in h.items()}
    assert got["Conut Jnah"] == (7.7934, 8.2374, 2.9767, 23.7172, 72)
    assert got["Main Street Coffee"] == (9.0572, 9.0643, 0.5614, 23.97, 106)
    assert cat["attendance"].filter("work_hours > 0.5").select("employee_id").distinct().count() == 15
