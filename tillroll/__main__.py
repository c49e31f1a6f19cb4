"""Command line: parse a folder of report files and write every analysis.

usage: python -m tillroll run REPORT_FOLDER OUT_FOLDER [--format json|parquet]
       python -m tillroll ingest REPORT_FOLDER OUT_FOLDER

``ingest`` writes the parsed datasets; ``run`` writes the analyses whose input
reports are present (missing reports are listed, not fatal).
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame


def analyses(cat: dict[str, DataFrame]) -> dict[str, DataFrame]:
    from tillroll.operators import baskets, branches, demand, segments, staffing

    out: dict[str, DataFrame] = {}
    if "attendance" in cat:
        att = cat["attendance"]
        s = staffing.shift_staffing(att)
        out.update(shift_staffing=s, staffing_alerts=staffing.staffing_alerts(s),
                   staffing_kpis=staffing.staffing_kpis(s), top_slots=staffing.top_slots(s),
                   staffing_by_day=staffing.staffing_by_day(att),
                   hours_by_branch=staffing.hours_by_branch(att))
    if "monthly_sales" in cat:
        m = cat["monthly_sales"]
        out.update(demand_forecast=demand.demand_forecast(m, 3),
                   demand_ranking=demand.demand_ranking(m, 3),
                   demand_trend=demand.demand_trend(m), demand_insight=demand.demand_insight(m))
        if "branch_revenue" in cat and "menu_avg_sales" in cat:
            k = branches.branch_kpis(m, cat["branch_revenue"], cat["menu_avg_sales"])
            # KPI rows ordered by branch at the sink (one row per branch)
            out.update(branch_kpis=k.orderBy("branch"),
                       expansion_signals=branches.expansion_signals(k))
    if "sales_by_item" in cat:
        seg = segments.classify(cat["sales_by_item"])
        share = segments.segment_share(seg)
        out.update(segment_share=share, segment_totals=segments.segment_totals(seg),
                   growth_actions=segments.growth_actions(seg, share),
                   top_coffee_items=segments.top_segment_items(seg, "coffee", 5),
                   top_milkshake_items=segments.top_segment_items(seg, "milkshake", 5))
    if "delivery_items" in cat:
        bk = baskets.build_baskets(cat["delivery_items"])
        m = baskets.mine(bk)
        out.update(combo_top=baskets.combo_top(baskets.association_rules(m.itemsets),
                                               m.n_baskets),
                   top_items_by_qty=baskets.top_items_by_qty(cat["delivery_items"]))
    return out


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m tillroll")
    ap.add_argument("command", choices=["run", "ingest"])
    ap.add_argument("reports")
    ap.add_argument("out")
    ap.add_argument("--format", default="json", choices=["json", "parquet"])
    a = ap.parse_args(argv)

    from tillroll.session import local_session
    from tillroll.sources.parsers import REPORT_FILES, load_reports
    from tillroll.sources.sinks import write_result

    spark = local_session()
    cat = load_reports(spark, a.reports)
    missing = sorted(set(REPORT_FILES) - set(cat))
    if missing:
        print("missing reports:", ", ".join(missing), file=sys.stderr)
    results = cat if a.command == "ingest" else analyses(cat)
    fmt = "parquet" if a.command == "ingest" else a.format
    for name, df in results.items():
        write_result(df, os.path.join(a.out, name), fmt)
        print(name)
    return 0


if __name__ == "__main__":
    sys.exit(main())
