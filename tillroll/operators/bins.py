"""Bins of a day kept as a table: shifts that differ by branch and over time.

An interval join without a nested loop: each bin is exploded into the hours and
months that it touches, punches meet bins by equality on (hour, month), and the exact
test of branch and dates follows.  A bin is at most 24 hours x its months, so the
bins grow by a known factor; punches are not multiplied but by bins that overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def assign_bins(df: DataFrame, bins: DataFrame, keys: Sequence[str], hour: str = "punch_hour", date: str = "date",
                branch: str = "branch", fallback: str = UNKNOWN) -> DataFrame:
    """``df`` plus ``bin``: the label of the bin that holds the row's hour.

    ``bins``: branch (null: every branch), valid_from and valid_to (dates, both included; null:
    open), from_hour and to_hour (to is excluded; from > to passes midnight, equal is the
    whole day), label, rank.  Of several bins that hold a row one of the row's own
    branch comes before one for every branch, then the lower rank, then the label.  Rows without
    an hour or date, or without a bin, get ``fallback``.  ``keys`` tell the rows of ``df`` apart.
    """
    keys = list(keys)
    h = F.col("_h")
    inside = (F.when(F.col("from_hour") < F.col("to_hour"), (h >= F.col("from_hour")) & (h < F.col("to_hour")))
              .otherwise((h >= F.col("from_hour")) | (h < F.col("to_hour"))))
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    first, last = span.select("a").scalar(), span.select("b").scalar()
    # bins without an end reach as far as the rows do
    start = F.greatest(F.coalesce("valid_from", first), first)
    end = F.least(F.coalesce("valid_to", last), last)
    wide = (bins.select(F.col("branch").alias("_branch"), start.alias("_from"), end.alias("_to"), "from_hour", "to_hour", "label", "rank",
                        F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_h"))
            .where(inside & (F.col("_from") <= F.col("_to")))
            .select("_branch", "_from", "_to", "label", "rank", "_h",
                    F.explode(F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))).alias("_month")))
    rows = df.where(F.col(hour).isNotNull() & F.col(date).isNotNull()).select(
        *keys, F.col(branch).alias("_b"), F.col(date).alias("_d"), F.col(hour).cast("int").alias("_h"), F.trunc(date, "month").alias("_month"))
    own = F.col("_branch").isNotNull()
    held = (rows.join(wide, ["_h", "_month"])
            .where((~own | (F.col("_branch") == F.col("_b"))) & F.col("_d").between(F.col("_from"), F.col("_to")))
            .groupBy(*keys).agg(F.min(F.struct((~own).alias("general"), "rank", "label")).alias("best"))
            .select(*keys, F.col("best.label").alias("bin")))
    return df.join(held, keys, "left").withColumn("bin", F.coalesce("bin", F.lit(fallback)))
