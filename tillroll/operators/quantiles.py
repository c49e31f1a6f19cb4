"""Exact quantiles of many groups by refining buckets, without sorting or collecting a group.

Each round cuts what is left of a group at splitters (values of an approximate
percentile sketch), counts the values between and at the splitters, and goes on
with the only bucket that holds a wanted rank.  A bucket excludes its splitters,
so it always shrinks, whatever the distribution or the number of equal values.
Small buckets are sorted in one row.  A group with a third of all values
costs partial counts, never one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import write_table

#: Splitters of a bucket, and the number of values up to which a bucket is sorted whole.
SPLITTERS, SMALL = 63, 4096


def _ranks(n: Column, probs: Sequence[float], middle: bool) -> Column:
    """Ranks from 0: for each p the value below which a share p lies; the two around the middle for the median."""
    at = [F.greatest(n - F.floor(n - F.lit(float(p)) * n), F.lit(1)) - 1 for p in probs]
    if middle:
        at += [F.floor((n - 1) / 2), F.ceil((n - 1) / 2)]
    return F.array_distinct(F.array(*[a.cast("long") for a in at]))


def select_ranks(values: DataFrame, keys: Sequence[str], wanted: DataFrame, splitters: int = SPLITTERS, small: int = SMALL) -> DataFrame:
    """keys..., rank, value: the value of each wanted rank (from 0, by rising value) of each group.

    ``values`` holds keys and ``value`` without nulls, ``wanted`` one row per group: keys, ``ranks`` (array of
    whole numbers below the group's size) and ``n``.
    """
    keys = list(keys)
    at = [*keys, "part"]
    parts = write_table(wanted.withColumn("part", F.lit("")).select(*at, "n", F.transform(
        "ranks", lambda r: F.struct(r.alias("rank"), r.alias("left"))).alias("targets")), "rank-parts")
    live = values.select(*keys, F.lit("").alias("part"), "value")
    done = []
    while True:
        ready = parts.where(F.col("n") <= small)
        held = (live.join(ready.select(*at, "targets"), at).groupBy(*at)
                .agg(F.sort_array(F.collect_list("value")).alias("sorted"), F.first("targets").alias("targets"))
                .select(*keys, "sorted", F.explode("targets").alias("t"))
                .select(*keys, "t.rank", F.get("sorted", F.col("t.left").cast("int")).alias("value")))
        done.append(write_table(held, "ranks"))
        parts = parts.where(F.col("n") > small)
        if not parts.limit(1).count():
            break
        live = live.join(parts.select(*at), at)
        share = [(i + 1) / (splitters + 1) for i in range(splitters)]
        cut = live.groupBy(*at).agg(F.array_distinct(F.percentile_approx("value", share, 8 * splitters)).alias("cut"))
        # an odd number is a splitter itself, an even one lies between two
        place = 2 * F.size(F.filter("cut", lambda c: c < F.col("value"))) + F.array_contains("cut", F.col("value")).cast("int")
        placed = live.join(cut, at).select(*at, "value", place.alias("bucket"))
        counts = placed.groupBy(*at, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))
        before = F.sum("n").over(Window.partitionBy(*at).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("below", F.coalesce(before, F.lit(0)))
        hit = (counts.join(parts.select(*at, "targets"), at)
               .withColumn("targets", F.transform(
                   F.filter("targets", lambda t: (t["left"] >= F.col("below")) & (t["left"] < F.col("below") + F.col("n"))),
                   lambda t: F.struct(t["rank"].alias("rank"), (t["left"] - F.col("below")).alias("left"))))
               .where(F.size("targets") > 0))
        hit = write_table(hit, "rank-buckets")
        equal = F.col("bucket") % 2 == 1
        done.append(hit.where(equal).select(*keys, F.explode("targets").alias("t"), "least").select(*keys, "t.rank", F.col("least").alias("value")))
        chosen = hit.where(~equal)
        longer = F.concat_ws(".", "part", F.col("bucket").cast("string"))
        live = write_table(placed.join(chosen.select(*at, "bucket"), [*at, "bucket"]).withColumn("part", longer).drop("bucket"), "rank-values")
        parts = chosen.select(*keys, longer.alias("part"), "n", "targets")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9),
                    splitters: int = SPLITTERS, small: int = SMALL) -> DataFrame:
    """keys..., n, median (mean of the middle values) and for each p ``q<percent>``: the smallest value with a share p at or below it.

    Null values and groups with a null key are left out; NaN is the largest value.
    """
    keys = list(keys)
    known = F.col(value).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    values = df.where(known).select(*keys, F.col(value).cast("double").alias("value"))
    sizes = write_table(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    wanted = sizes.select(*keys, "n", _ranks(F.col("n"), probs, True).alias("ranks"))
    found = select_ranks(values, keys, wanted, splitters, small)
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))
    n = F.col("n")
    pick = lambda r: F.element_at("v", r.cast("long"))                                        # noqa: E731
    median = pick(F.floor((n - 1) / 2)) * 0.5 + pick(F.ceil((n - 1) / 2)) * 0.5
    return by_rank.join(sizes, keys).select(
        *keys, "n", median.alias("median"),
        *[pick(F.greatest(n - F.floor(n - F.lit(float(p)) * n), F.lit(1)) - 1).alias(f"q{round(p * 100):02d}") for p in probs])
