"""Per-branch demand: growth, OLS trend forecast, ranking and trend labels.

Input: a monthly table (branch, year, month_num, total_sales), one row per
branch-month.  All branches are fitted in one grouped plan — no driver loop.
The series index ``t`` is dense (1..n by year, month): missing months are not
gaps, as in the analysed application.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.functions.scalar import month_label, signed, trend3, trend5


def _period(year: str = "year", month: str = "month_num"):
    return F.col(year) * 100 + F.col(month)


def prepare_series(monthly: DataFrame, branch: str | None = None) -> DataFrame:
    """Add period (YYYYMM) and the dense index t per branch.

    The window partitions by branch over already-aggregated months, so a
    partition holds at most one row per month.
    """
    df = monthly.filter(F.col("branch").isNotNull())
    if branch is not None:
        df = df.filter(F.col("branch") == branch)
    w = Window.partitionBy("branch").orderBy("year", "month_num")
    return df.withColumn("period", _period()).withColumn("t", F.row_number().over(w))


def series_stats(monthly: DataFrame, branch: str | None = None) -> DataFrame:
    """branch, n_months, historical_mean, first/last sales, growth_pct, OLS fit."""
    s = prepare_series(monthly, branch)
    first = F.min_by("total_sales", "period")
    last = F.max_by("total_sales", "period")
    return (
        s.groupBy("branch")
        .agg(F.count("*").alias("n_months"),
             F.avg("total_sales").alias("historical_mean"),
             first.alias("first_sales"), last.alias("last_sales"),
             F.max("period").alias("last_period"),
             F.regr_slope("total_sales", "t").alias("slope"),
             F.regr_intercept("total_sales", "t").alias("intercept"))
        .withColumn("growth_pct",
                    F.when((F.col("n_months") > 1) & (F.col("first_sales") > 0),
                           (F.col("last_sales") - F.col("first_sales"))
                           / F.col("first_sales") * 100).otherwise(F.lit(0.0)))
        # one point: the least-squares fit is the constant series
        .withColumn("slope", F.coalesce("slope", F.lit(0.0)))
        .withColumn("intercept", F.coalesce("intercept", "historical_mean"))
    )


def demand_growth(monthly: DataFrame, branch: str | None = None) -> DataFrame:
    """branch, n_months, historical_mean, growth_pct (first -> last month)."""
    return series_stats(monthly, branch).select(
        "branch", "n_months", "historical_mean", "growth_pct")


def demand_forecast(monthly: DataFrame, n_months: int = 3,
                    branch: str | None = None) -> DataFrame:
    """OLS trend forecast for the next ``n_months`` months of every branch.

    forecast = max(intercept + slope * (n + step), 0); the band is a flat
    -10 % / +10 %; variance_pct compares with the historical mean.
    """
    if not 1 <= int(n_months) <= 12:
        raise ValueError("n_months must be within 1..12")
    st = series_stats(monthly, branch)
    last_month = F.make_date((F.col("last_period") / 100).cast("int"),
                             (F.col("last_period") % 100).cast("int"), F.lit(1))
    out = (
        st.select("branch", "n_months", "historical_mean", "slope", "intercept",
                  last_month.alias("last_month"),
                  F.explode(F.sequence(F.lit(1), F.lit(int(n_months)))).alias("step"))
        .withColumn("target", F.add_months("last_month", F.col("step")))
        .withColumn("forecast", F.greatest(
            F.col("intercept") + F.col("slope") * (F.col("n_months") + F.col("step")),
            F.lit(0.0)))
    )
    return out.select(
        "branch", "step",
        F.year("target").alias("year"), F.month("target").alias("month_num"),
        month_label(F.year("target"), F.month("target")).alias("period"),
        "forecast",
        (F.col("forecast") * K.FORECAST_BAND_LOW).alias("lower"),
        (F.col("forecast") * K.FORECAST_BAND_HIGH).alias("upper"),
        ((F.col("forecast") - F.col("historical_mean"))
         / F.greatest(F.col("historical_mean"), F.lit(1.0)) * 100).alias("variance_pct"),
    )


def demand_ranking(monthly: DataFrame, n_months: int = 3) -> DataFrame:
    """Branches by mean of their 2-dp rounded forecasts, descending."""
    fc = demand_forecast(monthly, n_months)
    return (fc.groupBy("branch")
            .agg(F.avg(F.bround("forecast", 2)).alias("avg_forecast"))
            .orderBy(F.desc("avg_forecast"), "branch"))


def demand_trend(monthly: DataFrame) -> DataFrame:
    """Growth with 3-band and 5-band trend labels per branch."""
    g = demand_growth(monthly)
    return g.select("branch", "growth_pct",
                    trend3("growth_pct").alias("trend"),
                    trend5("growth_pct").alias("trend_band"))


def demand_insight(monthly: DataFrame, n_months: int = 3) -> DataFrame:
    """One sentence per branch: trend, growth and mean projected demand."""
    g = demand_growth(monthly)
    fc = (demand_forecast(monthly, n_months).groupBy("branch")
          .agg(F.avg(F.bround("forecast", 2)).alias("avg_forecast")))
    return g.join(fc, "branch").select(
        "branch",
        F.format_string("%s shows a %s trend (%s%% over the data period). "
                        "Next %d months avg projected demand: %s units.",
                        "branch", trend3("growth_pct"), signed("growth_pct", 1), F.lit(int(n_months)),
                        F.format_number("avg_forecast", 0)).alias("insight"))


def worst_decline(monthly: DataFrame, threshold: float = -5.0) -> DataFrame:
    """One row: the branch with the lowest growth among those below ``threshold``."""
    g = demand_growth(monthly).filter(F.col("growth_pct") < threshold)
    return g.agg(F.min_by("branch", F.struct("growth_pct", "branch")).alias("worst_branch"),
                 F.min("growth_pct").alias("worst_growth_pct"),
                 F.count("*").alias("n_declining"))


def forecast_branch(monthly: DataFrame, branch: str, n_months: int = 3) -> DataFrame:
    """Forecast of one branch (the filter reaches the scan), or an error row.

    Columns of ``demand_forecast`` plus ``error``; a branch without data yields
    a single row carrying the branch name and the error text.
    """
    fc = demand_forecast(monthly, n_months, branch).withColumn(
        "error", F.lit(None).cast("string"))
    found = (monthly.filter(F.col("branch") == branch)
             .agg(F.count("*").alias("n")))
    missing = found.filter(F.col("n") == 0).select(
        F.lit(branch).alias("branch"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in fc.schema.fields
          if f.name not in ("branch", "error")],
        F.lit("No data for this branch").alias("error"))
    return fc.unionByName(missing)
