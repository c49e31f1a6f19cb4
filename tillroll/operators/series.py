"""Monthly series whose straight-line fit composes from parts.

A part of a series is what its least-squares line needs: the number of months n, the
sum of the values and the sum of place times value, with places counted inside
the part.  Joining two parts moves the places of the later one by the n of the
earlier one, so parts made by different tasks, or months that arrive later, give the
fit of the whole series; months that are in a part are never read again.
Sums are exact decimals, so the way a series is cut does not show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.functions.scalar import MONEY_TYPE, money

#: A part: months from ``first_period`` to ``last_period`` (YYYYMM) of a branch.
PART = ("branch", "first_period", "last_period", "n", "sum_y", "sum_ty", "first_sales", "last_sales")


def fold(monthly: DataFrame, cut: Column | None = None) -> DataFrame:
    """One part for each branch and value of ``cut`` (default: the year), which must rise with the months.

    Input: branch, year, month_num, total_sales, a row per month; null branches are left out.
    """
    period = (F.col("year") * 100 + F.col("month_num")).cast("long")
    cut = F.col("year") if cut is None else cut
    df = monthly.where(F.col("branch").isNotNull()).select("branch", period.alias("period"), cut.alias("_cut"), "total_sales")
    place = F.row_number().over(Window.partitionBy("branch", "_cut").orderBy("period"))
    y = money("total_sales")
    return (df.withColumn("t", place).groupBy("branch", "_cut")
            .agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count(F.lit(1)).alias("n"),
                 F.sum(y).cast(MONEY_TYPE).alias("sum_y"), F.sum((y * F.col("t")).cast(MONEY_TYPE)).cast(MONEY_TYPE).alias("sum_ty"),
                 F.min_by("total_sales", "period").alias("first_sales"), F.max_by("total_sales", "period").alias("last_sales"))
            .select(*PART))


def join_parts(parts: DataFrame) -> DataFrame:
    """One part per branch from parts that do not overlap in time, in any number and order."""
    earlier = Window.partitionBy("branch").orderBy("first_period").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.withColumn("_by", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return (moved.groupBy("branch")
            .agg(F.min("first_period").alias("first_period"), F.max("last_period").alias("last_period"), F.sum("n").alias("n"),
                 F.sum("sum_y").cast(MONEY_TYPE).alias("sum_y"),
                 F.sum((F.col("sum_ty") + (F.col("sum_y") * F.col("_by")).cast(MONEY_TYPE)).cast(MONEY_TYPE)).cast(MONEY_TYPE).alias("sum_ty"),
                 F.min_by("first_sales", "first_period").alias("first_sales"),
                 F.max_by("last_sales", "first_period").alias("last_sales"))
            .select(*PART))


def append(part: DataFrame, months: DataFrame) -> DataFrame:
    """The part of a series and of months after it; only the new months are read."""
    return join_parts(part.unionByName(fold(months, F.lit(0))))


def fit(part: DataFrame, n_months: int = 3) -> DataFrame:
    """branch, n_months, historical_mean, growth_pct, slope, intercept and the mean of the next ``n_months`` forecasts (never below 0 each).

    A single month is a constant series.
    """
    n, sy, sty = F.col("n"), F.col("sum_y").cast("double"), F.col("sum_ty").cast("double")
    st, stt = n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6
    slope = F.when(n > 1, (n * sty - st * sy) / (n * stt - st * st)).otherwise(0.0)
    out = part.withColumn("slope", slope).withColumn("intercept", (sy - F.col("slope") * st) / n)
    ahead = [F.greatest(F.col("intercept") + F.col("slope") * (n + step), F.lit(0.0)) for step in range(1, n_months + 1)]
    growth = F.when((n > 1) & (F.col("first_sales") > 0), (F.col("last_sales") - F.col("first_sales")) / F.col("first_sales") * 100)
    return out.select("branch", n.alias("n_months"), (sy / n).alias("historical_mean"), F.coalesce(growth, F.lit(0.0)).alias("growth_pct"),
                      "slope", "intercept", (sum(ahead[1:], ahead[0]) / n_months).alias("forecast"),
                      (sum(ahead[1:], ahead[0]) / n_months * K.FORECAST_BAND_LOW).alias("lower"),
                      (sum(ahead[1:], ahead[0]) / n_months * K.FORECAST_BAND_HIGH).alias("upper"))
