"""Product-segment share analysis (coffee / milkshake / chimney cake / other).

Input: item sales (branch, item, qty, total_amount).  The segment is a native
``CASE`` over upper-case substring tests, evaluated once per row; branch
shares are windows over the (branch, segment) aggregate, at most one row per
segment per branch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.functions.scalar import beverage_status, fixed, money, money_sum, segment_of


def classify(sales: DataFrame, item_col: str = "item",
             milkshake: Sequence[str] = K.MILKSHAKE_KEYWORDS,
             coffee: Sequence[str] = K.COFFEE_KEYWORDS,
             chimney: Sequence[str] = K.CHIMNEY_KEYWORDS) -> DataFrame:
    """Add ``segment``."""
    return sales.withColumn("segment", segment_of(item_col, milkshake, coffee, chimney))


def segment_share(seg: DataFrame) -> DataFrame:
    """Revenue per (branch, segment) and its percent of the branch total."""
    agg = (seg.filter(F.col("branch").isNotNull())
           .groupBy("branch", "segment")
           .agg(money_sum("total_amount").alias("segment_revenue")))
    total = F.sum(money("segment_revenue")).over(Window.partitionBy("branch")).cast("double")
    return (agg.withColumn("branch_total", total)
               .withColumn("share_pct", F.when(F.col("branch_total") != 0,
                                               F.col("segment_revenue") / F.col("branch_total")
                                               * 100)))


def top_segment_items(seg: DataFrame, segment: str, top_n: int = 10) -> DataFrame:
    """Top ``top_n`` items of one segment by revenue (ties by item name)."""
    return (seg.filter(F.col("segment") == segment)
            .groupBy("item")
            .agg(F.sum("qty").alias("total_qty"), money_sum("total_amount").alias("total_revenue"))
            .orderBy(F.desc("total_revenue"), "item")
            .limit(int(top_n))
            .withColumn("segment", F.lit(segment)))


def segment_comparison(seg: DataFrame, segments: Sequence[str] = ("coffee", "milkshake")
                       ) -> DataFrame:
    """Quantity and revenue per (branch, segment) for the given segments."""
    return (seg.filter(F.col("segment").isin(list(segments)) & F.col("branch").isNotNull())
            .groupBy("branch", "segment")
            .agg(F.sum("qty").alias("total_qty"), money_sum("total_amount").alias("total_revenue")))


def segment_totals(seg: DataFrame) -> DataFrame:
    """One row: coffee and milkshake revenue and their share of all revenue."""
    amt = F.col("total_amount")
    t = seg.agg(
        F.coalesce(money_sum(F.when(F.col("segment") == "coffee", amt)), F.lit(0.0))
        .alias("coffee_total_revenue"),
        F.coalesce(money_sum(F.when(F.col("segment") == "milkshake", amt)), F.lit(0.0))
        .alias("milkshake_total_revenue"),
        F.coalesce(money_sum(amt), F.lit(0.0)).alias("total_revenue"),
    )
    den = F.greatest(F.col("total_revenue"), F.lit(1.0))
    return (t.withColumn("coffee_share_pct", F.col("coffee_total_revenue") / den * 100)
             .withColumn("milkshake_share_pct", F.col("milkshake_total_revenue") / den * 100))


def segment_pivot(share: DataFrame, value_col: str = "share_pct",
                  segments: Sequence[str] = K.SEGMENTS) -> DataFrame:
    """Branch x segment matrix of ``value_col``; a missing segment is 0."""
    return (share.groupBy("branch").pivot("segment", list(segments))
            .agg(F.first(value_col)).na.fill(0.0, list(segments)))


def segment_performance(share: DataFrame,
                        thresholds: dict[str, float] | None = None,
                        include_missing: bool = False) -> DataFrame:
    """Per branch and thresholded segment: rounded share and under/at-or-above status.

    By default a branch with no row for a segment gets none (as in the
    analysed application); ``include_missing`` adds those pairs with share 0
    and status ``missing``.  Shares are compared after rounding to 2 decimals.
    """
    thresholds = thresholds or {"coffee": K.COFFEE_UNDER_PCT,
                                "milkshake": K.MILKSHAKE_UNDER_PCT}
    th = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    rounded = F.bround("share_pct", 2)
    out = (share.filter(F.col("segment").isin(list(thresholds)))
           .select("branch", "segment", rounded.alias("share_pct"),
                   th[F.col("segment")].alias("threshold_pct"))
           .withColumn("status", F.when(F.col("share_pct") < F.col("threshold_pct"),
                                        "underperforming").otherwise("performing")))
    if not include_missing:
        return out
    # every branch x thresholded segment: the segment list is a literal array
    pairs = (share.select("branch").distinct()
             .select("branch", F.explode(F.array(*[F.lit(k) for k in thresholds]))
                     .alias("segment")))
    missing = (pairs.join(out.select("branch", "segment"), ["branch", "segment"], "left_anti")
               .select("branch", "segment", F.lit(0.0).alias("share_pct"),
                       th[F.col("segment")].alias("threshold_pct"),
                       F.lit("missing").alias("status")))
    return out.unionByName(missing)


def beverage_gap(share: DataFrame, target: float = K.BEVERAGE_TARGET_PCT) -> DataFrame:
    """Per branch: coffee + milkshake share, gap to the benchmark and a status."""
    bev = (share.filter(F.col("segment").isin("coffee", "milkshake"))
           .groupBy("branch").agg(F.sum(F.bround("share_pct", 2)).alias("beverage_share_pct")))
    return (bev.withColumn("gap_pct", F.greatest(F.lit(target) - F.col("beverage_share_pct"),
                                                 F.lit(0.0)))
               .withColumn("status", beverage_status("beverage_share_pct", target)))


def beverage_gap_network(totals: DataFrame, target: float = K.BEVERAGE_TARGET_PCT) -> DataFrame:
    """One row from ``segment_totals``: the network's beverage share, its gap, status and finding."""
    share = F.bround("coffee_share_pct", 2) + F.bround("milkshake_share_pct", 2)
    t = totals.select(share.alias("beverage_share_pct"))
    t = (t.withColumn("gap_pct", F.greatest(F.lit(float(target)) - F.col("beverage_share_pct"), F.lit(0.0)))
          .withColumn("status", beverage_status("beverage_share_pct", target)))
    text = F.lit(None).cast("string")
    for status, template in K.BEVERAGE_FINDINGS.items():
        text = F.when(F.col("status") == status,
                      F.format_string(template, fixed("beverage_share_pct", 1), F.lit(int(target)),
                                      fixed("gap_pct", 1))).otherwise(text)
    return t.withColumn("finding", text)


# --- fixed values: growth actions (strategy, target, trigger, action, expected impact), in priority order
GROWTH_ACTIONS = [
    ("Star Product Upsell", "coffee", "has_top_coffee",
     "Feature '%s' prominently in menus and POS upsell prompts. "
     "It generates %s units revenue — train staff to recommend it.",
     "5–10% increase in coffee revenue per upsell conversion"),
    ("Coffee + Chimney Cake Combo Bundle", "coffee + chimney_cake", "always",
     "Create a 'Coffee & Chimney' combo at a 5–8% discount vs. buying separately. "
     "Cross-sell at POS when a chimney cake is ordered.",
     "Increases average basket size by ~15% and coffee attach rate"),
    ("Branch-Level Coffee Drive", "underperforming coffee branches", "has_under_coffee",
     "These branches have <20% coffee revenue share. "
     "Run a 2-week 'Coffee Month' promo with discounts on new coffee SKUs, "
     "loyalty stamps, and barista spotlight content on social media.",
     "+3–5% coffee revenue share per branch within 1 month"),
    ("Seasonal Milkshake Menu", "milkshake", "has_top_milkshake",
     "Introduce 2–3 rotating seasonal milkshake flavours (e.g. rose, pistachio) "
     "as limited-edition items. Use scarcity marketing (Instagram stories, countdown).",
     "10–20% milkshake volume uplift during campaign period"),
    ("Off-Peak Happy Hour", "coffee + milkshake", "always",
     "Offer 20% off coffee & milkshakes Mon–Thu 14:00–17:00. "
     "Converts low-traffic afternoon hours into revenue opportunities.",
     "15–25% increase in afternoon transaction volume"),
]
PRIORITY_LABELS = ["IMMEDIATE", "IMMEDIATE", "THIS MONTH", "THIS QUARTER", "THIS QUARTER"]
PRIORITY_FALLBACK = "PLANNED"


def growth_actions(seg: DataFrame, share: DataFrame) -> DataFrame:
    """The triggered subset of the five growth actions, numbered and prioritised.

    Triggers come from one aggregate row over the data; the triggered actions
    are filtered and numbered inside that row (no window, no literal table).
    """
    # branches below the coffee threshold: one per branch at most (scalar subquery)
    under = (share.filter((F.col("segment") == "coffee")
                          & (F.bround("share_pct", 2) < K.COFFEE_UNDER_PCT))
             .agg(F.array_sort(F.collect_list("branch"))).scalar())
    flags = seg.agg(
        F.coalesce(F.max(F.col("segment") == "coffee"), F.lit(False)).alias("has_top_coffee"),
        F.coalesce(F.max(F.col("segment") == "milkshake"), F.lit(False))
        .alias("has_top_milkshake"),
    ).withColumn("under_coffee", under)
    fired = {"always": F.lit(True),
             "has_top_coffee": F.col("has_top_coffee"),
             "has_top_milkshake": F.col("has_top_milkshake"),
             "has_under_coffee": F.size("under_coffee") > 0}
    target = {"underperforming coffee branches":
              F.concat(F.lit("Branches: "), F.array_join("under_coffee", ", "))}
    star = top_segment_items(seg, "coffee", 1)
    flags = (flags.withColumn("star", star.select("item").scalar())
             .withColumn("star_revenue", F.format_number(star.select("total_revenue").scalar(), 0)))
    text = {GROWTH_ACTIONS[0][3]: F.format_string(GROWTH_ACTIONS[0][3], "star", "star_revenue")}
    actions = F.array(*[
        F.struct(F.lit(s_).alias("strategy"), target.get(tg, F.lit(tg)).alias("target"),
                 fired[tr].alias("fired"), text.get(act, F.lit(act)).alias("action"),
                 F.lit(impact).alias("expected_impact"))
        for s_, tg, tr, act, impact in GROWTH_ACTIONS])
    labels = F.array(*[F.lit(x) for x in PRIORITY_LABELS])
    rank = F.col("pos") + 1
    return (flags.select(F.posexplode(F.filter(actions, lambda a: a["fired"]))
                         .alias("pos", "a"))
            .select(rank.cast("int").alias("rank"), F.col("a.strategy").alias("strategy"),
                    F.col("a.target").alias("target"),
                    F.coalesce(F.try_element_at(labels, rank.cast("int")),
                               F.lit(PRIORITY_FALLBACK)).alias("priority"),
                    F.col("a.action").alias("action"), F.col("a.expected_impact").alias("expected_impact")))
