"""Shift staffing from time-and-attendance records.

Input columns (names are parameters): employee, branch, date, punch_in,
work_hours.  All aggregation is native; distinct counts are planned by Spark
as a two-level aggregate keyed on (group, employee), so a hot branch spreads
over many tasks before the final count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.functions.scalar import punch_hour, shift_of


def assign_shifts(att: DataFrame, punch_col: str = "punch_in",
                  hours_col: str = "work_hours", date_col: str = "date",
                  min_hours: float | None = K.GHOST_PUNCH_HOURS) -> DataFrame:
    """Drop ghost punches; add punch_hour, shift, day_of_week."""
    df = att
    if min_hours is not None:
        df = df.filter(F.col(hours_col) > min_hours)
    return (df.withColumn("punch_hour", punch_hour(punch_col))
              .withColumn("shift", shift_of("punch_hour"))
              .withColumn("day_of_week", F.date_format(F.col(date_col), "EEEE")))


def daily_headcount(att: DataFrame, branch_col: str = "branch", emp_col: str = "employee_id",
                    date_col: str = "date", **kw) -> DataFrame:
    """Distinct employees per (branch, shift, date)."""
    df = assign_shifts(att, date_col=date_col, **kw).filter(
        F.col(branch_col).isNotNull() & F.col(date_col).isNotNull())
    return (df.groupBy(F.col(branch_col).alias("branch"), "shift",
                       F.col(date_col).alias("date"), "day_of_week")
              .agg(F.countDistinct(emp_col).alias("staff_count")))


def shift_staffing(att: DataFrame, buffer: float = K.STAFF_BUFFER, **kw) -> DataFrame:
    """Per (branch, shift): mean/max/min staff over observed days and a recommendation.

    recommended_staff = min(ceil(mean_staff * buffer), max_staff).
    """
    daily = daily_headcount(att, **kw)
    return (
        daily.groupBy("branch", "shift")
        .agg(F.avg("staff_count").alias("mean_staff"),
             F.max("staff_count").alias("max_staff"),
             F.min("staff_count").alias("min_staff"),
             F.count("*").alias("days_observed"))
        .withColumn("recommended_staff",
                    F.least(F.ceil(F.col("mean_staff") * F.lit(buffer)),
                            F.col("max_staff")).cast("int"))
    )


def staffing_by_day(att: DataFrame, branch_col: str = "branch",
                    emp_col: str = "employee_id", **kw) -> DataFrame:
    """Distinct employees per (branch, day of week, shift) over the whole span."""
    df = assign_shifts(att, **kw).filter(F.col(branch_col).isNotNull())
    return (df.groupBy(F.col(branch_col).alias("branch"), "day_of_week", "shift")
              .agg(F.countDistinct(emp_col).alias("distinct_staff")))


#: Levels of ``staff_rollup``: the columns that a count is given by.
ROLLUP_LEVELS = {
    "day": ("branch", "shift", "date", "day_of_week", "month"),
    "weekday": ("branch", "day_of_week", "shift"),
    "month": ("branch", "shift", "month"),
    "branch": ("branch",),
    "network": (),
}


def staff_rollup(att: DataFrame, levels: dict[str, Sequence[str]] = ROLLUP_LEVELS, branch_col: str = "branch",
                 emp_col: str = "employee_id", date_col: str = "date", **kw) -> DataFrame:
    """level, branch, shift, date, day_of_week, month, distinct_staff: distinct employees of every level in one pass.

    Distinct counts do not add up, sets do: the employees of a (branch, shift, day)
    are bitmaps of 32,768 numbers each, merged map-side, and the bitmaps are or-ed to
    every level by grouping sets, so the punches are read and shuffled once.  Whole
    numbers are their own place in a bitmap; other ids are numbered first.  Null
    branches, dates and employees are not counted.
    """
    df = (assign_shifts(att, date_col=date_col, **kw)
          .filter(F.col(branch_col).isNotNull() & F.col(date_col).isNotNull() & F.col(emp_col).isNotNull())
          .select(F.col(branch_col).alias("branch"), "shift", F.col(date_col).alias("date"), F.col(emp_col).alias("employee")))
    if dict(df.dtypes)["employee"] not in ("tinyint", "smallint", "int", "bigint"):
        df = _numbered(df, "employee")
    number = F.col("employee").cast("bigint")
    daily = (df.groupBy("branch", "shift", "date", F.bitmap_bucket_number(number).alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("staff"))
             .withColumn("day_of_week", F.date_format("date", "EEEE"))
             .withColumn("month", F.date_format("date", "yyyy-MM")))
    keys = ["branch", "shift", "date", "day_of_week", "month"]
    sets = [[F.col(c) for c in (*columns, "bucket")] for columns in levels.values()]
    # a level is known by which columns it leaves out: the bits of grouping_id, first key first
    ids = {name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in columns) for name, columns in levels.items()}
    merged = (daily.groupingSets(sets, *keys, "bucket")
              .agg(F.grouping_id().alias("gid"), F.bitmap_count(F.bitmap_or_agg("staff")).alias("n")))
    level = F.coalesce(*[F.when(F.shiftright("gid", 1) == i, F.lit(name)) for name, i in ids.items()])
    return merged.groupBy(level.alias("level"), *keys).agg(F.sum("n").alias("distinct_staff"))


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by a whole number of its own for each value, written once so that retries agree."""
    from tillroll.session import write_table

    ids = write_table(df.select(column).distinct().withColumn("_number", F.monotonically_increasing_id()), "numbers")
    return df.join(ids, column).drop(column).withColumnRenamed("_number", column)


def hours_by_branch(att: DataFrame, branch_col: str = "branch", hours_col: str = "work_hours",
                    min_hours: float = K.GHOST_PUNCH_HOURS) -> DataFrame:
    """Mean, exact median, min, max and count of worked hours per branch.

    The exact median keeps a value->count map per group (bounded by the number
    of distinct durations, which are whole seconds), merged map-side.
    """
    df = att.filter((F.col(hours_col) > min_hours) & F.col(branch_col).isNotNull())
    return (df.groupBy(F.col(branch_col).alias("branch"))
              .agg(F.avg(hours_col).alias("avg_hours"),
                   F.median(hours_col).alias("median_hours"),
                   F.min(hours_col).alias("min_hours"),
                   F.max(hours_col).alias("max_hours"),
                   F.count(hours_col).alias("shift_records")))


def hours_histogram(att: DataFrame, hours_col: str = "work_hours", bins: int = 30,
                    min_hours: float = K.GHOST_PUNCH_HOURS) -> DataFrame:
    """Equal-width histogram of worked hours over [min, max]; max falls in the last bin."""
    df = att.filter(F.col(hours_col) > min_hours).select(F.col(hours_col).alias("h"))
    lo, hi = df.agg(F.min("h")).scalar(), df.agg(F.max("h")).scalar()   # scalar subqueries
    width = hi - lo
    binned = (df.select(F.when(width > 0,
                               F.least(F.floor((F.col("h") - lo) * bins / width),
                                       F.lit(bins - 1)))
                        .otherwise(F.lit(0)).cast("int").alias("bin"))
              .groupBy("bin").agg(F.count("*").alias("n")))
    # the bin domain (0 .. bins-1) keeps empty bins in the histogram
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(binned, "bin", "left")
            .select("bin",
                    (lo + width * F.col("bin") / bins).alias("bin_start"),
                    (lo + width * (F.col("bin") + 1) / bins).alias("bin_end"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def staffing_kpis(summary: DataFrame, at_risk_below: int = K.UNDERSTAFFED_MIN) -> DataFrame:
    """One row: number of slots, total recommended staff, slots with min < threshold."""
    return summary.agg(
        F.count("*").alias("n_slots"),
        F.coalesce(F.sum("recommended_staff"), F.lit(0)).alias("total_recommended"),
        F.count_if(F.col("min_staff") < at_risk_below).alias("n_at_risk"),
    )


def staffing_alerts(summary: DataFrame, at_risk_below: int = K.UNDERSTAFFED_MIN) -> DataFrame:
    """Recommendation sentence per slot, plus an alert sentence for at-risk slots."""
    return summary.select(
        "branch", "shift",
        F.format_string("%s – %s: recommend %d staff (observed range %d–%d, avg %s)",
                        "branch", "shift", "recommended_staff", "min_staff", "max_staff",
                        F.format_number("mean_staff", 1)).alias("recommendation"),
        F.when(F.col("min_staff") < at_risk_below,
               F.format_string("ALERT: %s – %s had as few as %d staff on some days.",
                               "branch", "shift", "min_staff")).alias("alert"),
    )


def top_slots(summary: DataFrame, top_n: int = 4) -> DataFrame:
    """Slots needing the most staff (ties by branch, shift)."""
    return (summary.orderBy(F.desc("recommended_staff"), "branch", "shift")
            .limit(int(top_n))
            .select("branch", "shift", "recommended_staff", "mean_staff", "min_staff",
                    "max_staff"))
