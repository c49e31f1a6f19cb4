"""Frequent itemsets over vertical bitmaps.

Baskets are numbered; an item is a row per chunk of 32,768 baskets with one bit for
each basket that holds it.  Itemsets grow level by level: the bitmaps of two frequent
itemsets that differ in their last item are and-ed chunk by chunk, their bits counted
and added up.  An item that is in every basket has as many rows as any other, one a
chunk, so no task holds a hot item's baskets, and no tree is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.session import write_table


def item_bitmaps(baskets: DataFrame) -> DataFrame:
    """items (array of one item), chunk, bits: which baskets of each chunk hold the item."""
    # numbers are fixed in the written table, so that retries agree
    numbered = write_table(baskets.select(F.monotonically_increasing_id().alias("basket"), "items"), "numbered-baskets")
    return (numbered.select("basket", F.explode("items").alias("item"))
            .groupBy("item", F.bitmap_bucket_number("basket").alias("chunk"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("basket")).alias("bits"))
            .select(F.array("item").alias("items"), "chunk", "bits"))


def _frequent(bitmaps: DataFrame, least: int) -> DataFrame:
    return (bitmaps.groupBy("items").agg(F.sum(F.bitmap_count("bits")).alias("freq")).where(F.col("freq") >= least))


def candidates(frequent: DataFrame, size: int) -> DataFrame:
    """items, left, right: itemsets of ``size`` items all of whose parts with one item less are frequent.

    ``left`` and ``right`` are the parts without the last and without the last but one item.
    """
    stem = F.slice("items", 1, size - 2)
    a = frequent.select(stem.alias("stem"), F.col("items").alias("left"), F.element_at("items", -1).alias("x"))
    b = frequent.select(stem.alias("stem"), F.col("items").alias("right"), F.element_at("items", -1).alias("y"))
    made = a.join(b, "stem").where("x < y").select(F.concat("left", F.array("y")).alias("items"), "left", "right")
    if size < 3:
        return made
    # the other parts leave out one of the first items
    parts = F.array(*[F.array_remove(F.col("items"), F.col("items")[i]) for i in range(size - 2)])
    held = (made.select("items", F.explode(parts).alias("part")).join(frequent.select(F.col("items").alias("part")), "part")
            .groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size - 2).select("items"))
    return made.join(held, "items", "left_semi")


def frequent_itemsets(baskets: DataFrame, min_support: float = K.MIN_SUPPORT, max_size: int | None = None) -> DataFrame:
    """items (sorted array), size, freq, support of every itemset with support >= ``min_support`` (of up to ``max_size`` items).

    ``baskets`` has an array of distinct ``items``; baskets without items count in the support's
    base.  Only the bitmaps of frequent itemsets of the last level are kept.
    """
    n = baskets.count()
    least = next((c for c in range(int(min_support * n), n + 1) if c and c / n >= min_support), 1) if n else 1
    level = write_table(item_bitmaps(baskets), "item-bitmaps")
    frequent = write_table(_frequent(level, least), "itemsets-1")
    found, size = [frequent], 1
    while frequent.limit(1).count() and (max_size is None or size < max_size):
        size += 1
        made = write_table(candidates(frequent, size), f"candidates-{size}")
        both = made.select("items", F.explode(F.array("left", "right")).alias("part"))
        held = level.select(F.col("items").alias("part"), "chunk", "bits")
        # a chunk in which one part has no basket has no common one
        joint = (both.join(held, "part").groupBy("items", "chunk")
                 .agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("parts"))
                 .where("parts = 2").select("items", "chunk", "bits").where(F.bitmap_count("bits") > 0))
        joint = write_table(joint, f"bitmaps-{size}")
        frequent = write_table(_frequent(joint, least), f"itemsets-{size}")
        level = joint.join(frequent.select("items"), "items", "left_semi")
        found.append(frequent)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("items", F.size("items").alias("size"), "freq", (F.col("freq") / F.lit(max(n, 1))).alias("support"))
