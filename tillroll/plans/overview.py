"""Network overview: one row combining every analysis (A34, A36, P14, P17).

Each part is a one-row aggregate (or the top row of a sorted frame) attached
as a scalar subquery — no joins.  What several parts read (months, signals, rules,
classified lines summed by item) is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.functions.scalar import beverage_status, money, network_growth_label
from tillroll.operators import baskets, branches, demand, segments, staffing
from tillroll.session import write_table
from tillroll.sources import tables as tb
from tillroll.sources.tables import Tables

CHANNELS = tb.DRIVER_CHANNELS


def _segment_items(sales: DataFrame) -> DataFrame:
    """branch, segment, item, qty, total_amount (exact decimals, so that sums of them equal sums of the lines), written once."""
    seg = segments.classify(sales, "item", tb.PART_MILKSHAKE_KEYWORDS, tb.PART_COFFEE_KEYWORDS, tb.PART_CHIMNEY_KEYWORDS)
    return write_table(seg.groupBy("branch", "segment", "item")
                       .agg(F.sum("qty").alias("qty"), F.sum(money("total_amount")).alias("total_amount")), "segment-items")


def network_overview(t: Tables, n_months: int = 3) -> DataFrame:
    """One row: demand ranking ends and spread, expansion verdict, best site, staffing
    alerts, beverage shares and status, rule count, the strongest combos and the
    triggered growth actions."""
    monthly = write_table(tb.monthly_sales(t), "monthly")
    rank = (demand.demand_forecast(monthly, n_months).groupBy("branch")
            .agg(F.avg(F.bround("forecast", 2)).alias("avg_forecast")))
    dem = rank.agg(F.min_by("branch", F.struct(-F.col("avg_forecast"), F.col("branch"))).alias("top_branch"),
                   F.max("avg_forecast").alias("top_avg"),
                   F.min_by("branch", F.struct("avg_forecast", "branch")).alias("bottom_branch"),
                   F.min("avg_forecast").alias("bottom_avg"))
    kpis = branches.branch_kpis(monthly, tb.branch_revenue(t), tb.menu_channels(t), CHANNELS)
    sig = write_table(branches.expansion_signals(kpis), "signals")
    ranked = branches.score_candidates(tb.candidate_sites(t), sig)
    slots = staffing.shift_staffing(tb.attendance(t))
    seg = _segment_items(tb.item_sales(t))
    tot = segments.segment_totals(seg)
    bk = tb.order_baskets(t)
    # thresholds as in the registered rule queries (the driver data has lift ~ 1)
    rules = write_table(baskets.association_rules(baskets.frequent_itemsets(bk, 0.02), 1.0, 0.1), "rules")
    best_rule = (rules.orderBy(F.desc("lift"), "antecedents", "consequents").limit(1)
                 .select(F.concat_ws(" + ", "antecedents", "consequents")))
    # the three strongest rules, ordered inside one bounded sorted list
    top3 = (rules.orderBy(F.desc("lift"), "antecedents", "consequents").limit(3)
            .agg(F.sort_array(F.collect_list(F.struct(
                F.negative("lift").alias("k"), "antecedents", "consequents"))).alias("s"))
            .select(F.when(F.size("s") > 0, F.array_join(F.transform(
                "s", lambda x: F.concat_ws(" + ", x["antecedents"], x["consequents"])), " | "))))
    # triggered growth actions in priority order (at most five rows)
    acts = (segments.growth_actions(seg, segments.segment_share(seg))
            .agg(F.sort_array(F.collect_list(F.struct("rank", "strategy"))).alias("a"))
            .select(F.array_join(F.transform("a", lambda x: x["strategy"]), "; ")))

    # every other part is a scalar subquery on the one-row demand summary
    coffee = tot.select("coffee_share_pct").scalar()
    shake = tot.select("milkshake_share_pct").scalar()
    growth = sig.select("avg_monthly_growth_pct").scalar()
    return dem.select(
        "top_branch", "bottom_branch",
        ((F.col("top_avg") - F.col("bottom_avg"))
         / F.greatest(F.col("bottom_avg"), F.lit(1.0)) * 100).alias("demand_spread_pct"),
        demand.worst_decline(monthly).select("worst_branch").scalar()
        .alias("worst_declining_branch"),
        sig.select("feasibility").scalar().alias("feasibility"),
        network_growth_label(growth).alias("network_growth"),
        ranked.agg(F.min_by("location", F.struct(-F.col("composite_score"), F.col("location")))).scalar().alias("top_location"),
        slots.agg(F.count_if(F.col("min_staff") < K.UNDERSTAFFED_MIN)).scalar()
        .alias("n_staff_alerts"),
        coffee.alias("coffee_share_pct"), shake.alias("milkshake_share_pct"),
        beverage_status(F.bround(coffee, 2) + F.bround(shake, 2)).alias("beverage_status"),
        rules.agg(F.count("*")).scalar().alias("n_rules"),
        best_rule.scalar().alias("top_combo"),
        top3.scalar().alias("top_combos"),
        acts.scalar().alias("actions"),
    )


def overview_sections(t: Tables, n_months: int = 3, top_rules: int = 10) -> DataFrame:
    """section, position (from 1), name, value, text: the overview as rows, with whole rankings.

    Sections: demand_ranking (mean forecast), locations (composite score), combos (lift and sentence),
    staffing (recommended staff and alert), growth_actions (text: the strategy).  Order lines with their
    branch and part are written once; baskets and segments both read them, so line items are scanned once.
    """
    from pyspark.sql import Window

    lines = write_table(tb._lines_with_part(t).select(
        "branch", F.col("l_orderkey").alias("order"), "p_brand", "p_name", "l_quantity", "l_extendedprice"), "order-lines")
    monthly = write_table(tb.monthly_sales(t), "monthly")
    sig = write_table(branches.expansion_signals(branches.branch_kpis(monthly, tb.branch_revenue(t), tb.menu_channels(t), CHANNELS)), "signals")
    bk = baskets.build_baskets(lines.select("branch", F.col("order").cast("string").alias("customer"), F.col("p_brand").alias("item"),
                                            F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price")))
    mined = baskets.mine(bk, 0.02)
    combos = baskets.combo_top(baskets.association_rules(mined.itemsets, 1.0, 0.1), mined.n_baskets, top_rules)
    seg = _segment_items(lines.select("branch", F.col("p_name").alias("item"), F.col("l_quantity").alias("qty"),
                                      F.col("l_extendedprice").alias("total_amount")))
    slots = staffing.staffing_alerts(staffing.shift_staffing(tb.attendance(t)))
    # a section has a row per branch, candidate, slot, rule or action: numbering it is one small window each
    parts = {
        "demand_ranking": demand.demand_ranking(monthly, n_months).select(
            F.col("branch").alias("name"), F.col("avg_forecast").alias("value"), F.lit(None).cast("string").alias("text"),
            F.struct(-F.col("avg_forecast"), "branch").alias("by")),
        "locations": branches.score_candidates(tb.candidate_sites(t), sig).select(
            F.col("location").alias("name"), F.col("composite_score").alias("value"), F.lit(None).cast("string").alias("text"),
            F.struct(-F.col("composite_score"), "location").alias("by")),
        "combos": combos.select(F.col("items").alias("name"), F.col("lift").alias("value"), F.col("recommendation").alias("text"),
                                F.struct(-F.col("lift"), "antecedents", "consequents").alias("by")),
        "staffing": slots.select(F.concat_ws(" – ", "branch", "shift").alias("name"), F.lit(None).cast("double").alias("value"),
                                 F.coalesce("alert", "recommendation").alias("text"), F.struct("branch", "shift").alias("by")),
        "growth_actions": segments.growth_actions(seg, segments.segment_share(seg)).select(
            F.col("strategy").alias("name"), F.col("rank").cast("double").alias("value"), F.col("action").alias("text"), F.struct("rank").alias("by")),
    }
    out = None
    for section, rows in parts.items():
        place = F.row_number().over(Window.partitionBy("section").orderBy("by"))
        rows = rows.withColumn("section", F.lit(section)).withColumn("position", place).select("section", "position", "name", "value", "text")
        out = rows if out is None else out.unionByName(rows)
    return out
