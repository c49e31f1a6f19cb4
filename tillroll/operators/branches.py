"""Branch KPIs, expansion signals and candidate-location scoring.

Inputs: monthly sales (branch, year, month_num, total_sales), branch revenue
(branch, revenue), menu channels (branch, menu_channel, num_customers, sales)
and a candidates table (location, growth_factor, demand_base,
competition_risk).  Network-wide scalars are one-row global aggregates used as
scalar subqueries (no joins).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.functions.scalar import column_suffix, fixed, money_sum


def branch_growth(monthly: DataFrame) -> DataFrame:
    """Compound monthly growth % first -> last month; 0 with < 2 months or first <= 0."""
    period = F.col("year") * 100 + F.col("month_num")
    g = (monthly.filter(F.col("branch").isNotNull())
         .groupBy("branch")
         .agg(F.count("*").alias("n_months"),
              F.min_by("total_sales", period).alias("first_sales"),
              F.max_by("total_sales", period).alias("last_sales")))
    rate = (F.pow(F.col("last_sales") / F.col("first_sales"),
                  1.0 / F.greatest(F.col("n_months") - 1, F.lit(1))) - 1) * 100
    return g.select("branch", "n_months",
                    F.when((F.col("n_months") >= 2) & (F.col("first_sales") > 0), rate)
                    .otherwise(F.lit(0.0)).alias("monthly_growth_pct"))


def channel_mix(menu: DataFrame, channels: Sequence[str] = K.MENU_CHANNELS) -> DataFrame:
    """Branch x channel sales (one column per listed channel) and percent of the branch total.

    The total is over all channels of the branch, listed or not.
    """
    names = [column_suffix(c) for c in channels]
    sums = (menu.filter(F.col("branch").isNotNull()).groupBy("branch")
            .agg(money_sum("sales").alias("_all"),
                 *[F.coalesce(money_sum(F.when(F.col("menu_channel") == c, F.col("sales"))), F.lit(0.0)).alias(f"sales_{n}")
                   for c, n in zip(channels, names)]))
    total = F.greatest(F.coalesce("_all", F.lit(0.0)), F.lit(1.0))
    return sums.select("branch", *[f"sales_{n}" for n in names],
                       *[(F.col(f"sales_{n}") / total * 100).alias(f"pct_{n}") for n in names])


def customer_kpis(menu: DataFrame) -> DataFrame:
    """Customers, sales and spend per customer (customers floored at 1)."""
    return (menu.filter(F.col("branch").isNotNull())
            .groupBy("branch")
            .agg(F.sum("num_customers").alias("num_customers"), money_sum("sales").alias("sales"))
            .withColumn("avg_spend", F.col("sales") / F.greatest(F.col("num_customers"),
                                                                 F.lit(1.0))))


def branch_kpis(monthly: DataFrame, revenue: DataFrame, menu: DataFrame,
                channels: Sequence[str] = K.MENU_CHANNELS) -> DataFrame:
    """Per-branch KPI table.

    The branch set is the union of the revenue and growth branches (full
    outer join); customers and channel mix join left; anything missing is 0.
    Values are rounded as the analysed application reports them (half-even).
    """
    rev = (revenue.filter(F.col("branch").isNotNull())
           .groupBy("branch").agg(money_sum("revenue").alias("total_revenue")))
    growth = branch_growth(monthly).select("branch", "monthly_growth_pct")
    base = rev.join(growth, "branch", "full_outer")
    cust = customer_kpis(menu).select("branch", "num_customers", "avg_spend")
    mix = channel_mix(menu, channels)
    pct_cols = [c for c in mix.columns if c.startswith("pct_")]
    mix = mix.select("branch", *pct_cols)
    net = rev.agg(money_sum("total_revenue")).scalar()                  # scalar subquery
    out = (base.join(cust, "branch", "left").join(mix, "branch", "left")
           .withColumn("network_revenue", net))
    r = F.coalesce(F.col("total_revenue"), F.lit(0.0))
    share = F.when(F.coalesce(F.col("network_revenue"), F.lit(0.0)) != 0,
                   F.bround(r / F.col("network_revenue") * 100, 2)).otherwise(F.lit(0.0))
    return out.select(
        "branch",
        r.alias("total_revenue"),
        share.alias("revenue_share_pct"),
        F.bround(F.coalesce(F.col("monthly_growth_pct"), F.lit(0.0)), 2)
        .alias("monthly_growth_pct"),
        F.coalesce(F.col("num_customers").cast("long"), F.lit(0)).alias("num_customers"),
        F.coalesce(F.bround("avg_spend", 2), F.lit(0.0)).alias("avg_spend"),
        *[F.coalesce(F.bround(c, 1), F.lit(0.0)).alias(c) for c in pct_cols],
    )


def expansion_signals(kpis: DataFrame) -> DataFrame:
    """One row: network totals, the three signals, score, verdict, saturated branch."""
    s = kpis.agg(
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("num_customers").alias("total_customers"),
        F.avg("monthly_growth_pct").alias("avg_monthly_growth_pct"),
        F.max("revenue_share_pct").alias("max_share_pct"),
        # ties: the first name
        F.min_by("branch", F.struct(-F.col("revenue_share_pct"), F.col("branch"))).alias("saturated_branch"),
        F.count("*").alias("n_branches"),
    )
    growing = F.col("avg_monthly_growth_pct") > K.GROWING_PCT
    saturated = F.col("max_share_pct") > K.SATURATED_SHARE_PCT
    dense = F.col("total_customers") > K.DENSE_CUSTOMERS
    score = growing.cast("int") + saturated.cast("int") + dense.cast("int")
    return (s.withColumn("growing_network", growing)
             .withColumn("saturated_branch_present", saturated)
             .withColumn("high_customer_density", dense)
             .withColumn("signal_score", score)
             .withColumn("feasibility", F.when(score >= K.FEASIBLE_SIGNALS, "RECOMMENDED")
                         .otherwise("NOT RECOMMENDED")))


def score_candidates(candidates: DataFrame, signals: DataFrame,
                     top_n: int | None = None) -> DataFrame:
    """Composite score per candidate location, best first.

    demand = demand_base * (1 + g / 100) with g the network's mean monthly
    growth; composite = demand * growth_factor - 0.3 * competition_risk.
    """
    g = signals.select("avg_monthly_growth_pct").scalar()         # scalar subquery
    demand = F.col("demand_base") * (1 + g / 100)
    out = (candidates
           .select("location",
                   demand.alias("demand_score"),
                   F.col("competition_risk"),
                   (demand * F.col("growth_factor")
                    - F.col("competition_risk") * K.COMPETITION_WEIGHT).alias("composite_score")))
    out = out.orderBy(F.desc("composite_score"), "location")
    return out.limit(int(top_n)) if top_n else out


def expansion_recommendations(signals: DataFrame, ranked: DataFrame,
                              n_locations: int = 2) -> DataFrame:
    """rank, recommendation: the verdict (rank 0), then the top locations if feasible.

    ``ranked`` is ``score_candidates`` output (best first); the picks are at
    most ``n_locations`` rows, numbered inside one sorted, bounded list.
    """
    head = signals.select(
        F.lit(0).alias("rank"),
        F.when(F.col("feasibility") == "RECOMMENDED",
               F.format_string("Expansion is RECOMMENDED. Network shows %s%% avg monthly growth "
                               "with %d total customers across %d branches.",
                               fixed("avg_monthly_growth_pct", 1),
                               "total_customers", "n_branches"))
        .otherwise(F.format_string("Expansion is PREMATURE. Avg monthly growth is only %s%%. "
                                   "Focus on optimising existing branch performance first.",
                                   fixed("avg_monthly_growth_pct", 1)))
        .alias("recommendation"))
    pick = F.struct(F.negative("composite_score").alias("k"), F.col("location").alias("location"),
                    F.bround("demand_score", 1).alias("d"),
                    F.bround("competition_risk", 1).alias("r"),
                    F.bround("composite_score", 1).alias("c"))
    feasible = signals.select(F.col("feasibility") == "RECOMMENDED").scalar()
    picks = (ranked.limit(int(n_locations))
             .agg(F.sort_array(F.collect_list(pick)).alias("picks"))
             .filter(feasible)
             .select(F.posexplode("picks").alias("pos", "p"))
             .select((F.col("pos") + 1).cast("int").alias("rank"),
                     F.format_string("Consider %s (demand score %s, competition risk %s, "
                                     "composite %s).", "p.location", F.col("p.d").cast("string"),
                                     F.col("p.r").cast("string"), F.col("p.c").cast("string"))
                     .alias("recommendation")))
    return head.unionByName(picks)
