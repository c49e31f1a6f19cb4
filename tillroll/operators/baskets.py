"""Market-basket mining: baskets, frequent itemsets, association rules, pairs.

* Baskets: one row per basket key with the sorted set of items whose summed
  quantity is non-zero.  Lines are first reduced to distinct (basket, item)
  with a map-side partial sum, so a basket holding a third of all lines still
  becomes at most one entry per distinct item before ``collect_set``.
* Frequent itemsets: pattern growth over distinct item-sets with their counts
  (``mine``), level by level as joins and grouping; no tree in any task.
* Rules: consequents of each frequent itemset grow level by level from those
  that kept the confidence (a longer consequent never has more of it), supports
  are joined on the sorted item arrays; multi-item consequents, leverage and
  conviction included.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.functions.scalar import fixed, lift_priority, lift_strength, money_sum, strip

KEY_SEP = ", "


def paid_lines(lines: DataFrame, item: str = "item", qty: str = "qty", price: str = "price",
               exclude: Sequence[str] | DataFrame | None = K.EXCLUDED_ITEMS) -> DataFrame:
    """Lines with price > 0, item names stripped and upper-cased, excluded items dropped.

    ``exclude`` is a list of names, or a one-column DataFrame of names (an
    exclusion list kept as data), applied as an anti join; the planner
    broadcasts it when its size is under the broadcast threshold.
    """
    df = (lines.filter(F.col(price) > 0)
          .withColumn("item", F.upper(strip(item)))
          .withColumn("qty", F.col(qty)))
    if isinstance(exclude, DataFrame):
        names = exclude.select(F.upper(strip(exclude.columns[0])).alias("item"))
        df = df.join(names, "item", "left_anti")
    elif exclude:
        df = df.filter(~F.col("item").isin(list(exclude)))
    return df


def build_baskets(lines: DataFrame, keys: Sequence[str] = ("branch", "customer"),
                  **kw) -> DataFrame:
    """keys..., items (sorted distinct items with non-zero summed quantity)."""
    keys = list(keys)
    paid = paid_lines(lines, **kw)
    not_null = F.col("item").isNotNull()
    for k in keys:
        not_null = not_null & F.col(k).isNotNull()
    per_item = (paid.filter(not_null).groupBy(*keys, "item")
                .agg(F.sum("qty").alias("q")))
    return (per_item.groupBy(*keys)
            .agg(F.array_sort(F.collect_set(F.when(F.col("q") != 0, F.col("item"))))
                 .alias("items")))


def basket_count(baskets: DataFrame) -> DataFrame:
    """One row: n_baskets."""
    return baskets.agg(F.count("*").alias("n_baskets"))


def item_frequency(baskets: DataFrame) -> DataFrame:
    """Baskets per item and its support."""
    n = basket_count(baskets).scalar()
    return (baskets.select(F.explode("items").alias("item"))
            .groupBy("item").agg(F.count("*").alias("n_baskets_with_item"))
            .select("item", "n_baskets_with_item",
                    (F.col("n_baskets_with_item") / n).alias("support")))


def basket_stats(baskets: DataFrame) -> DataFrame:
    """One row: baskets, distinct items, non-zero cells and matrix sparsity."""
    per = baskets.select(F.size("items").alias("k"))
    n_items = (baskets.select(F.explode("items").alias("item"))
               .agg(F.countDistinct("item")).scalar())
    s = per.agg(F.count("*").alias("n_baskets"), F.coalesce(F.sum("k"), F.lit(0)).alias("nnz"))
    cells = F.col("n_baskets") * F.col("n_items")
    return (s.withColumn("n_items", n_items)
            .withColumn("sparsity", F.when(cells > 0, 1 - F.col("nnz") / cells)))


@dataclass
class Mined:
    """Frequent itemsets (materialised) and the number of baskets mined."""
    itemsets: DataFrame
    n_baskets: int


def mine(baskets: DataFrame, min_support: float = K.MIN_SUPPORT,
         num_partitions: int | None = None) -> Mined:
    """Pattern growth over the basket item-sets, level by level.

    Equal item-sets become one row with their number (a map-side sum), written
    once.  A level has rows (suffix, prefix, n): n baskets hold ``suffix`` and, of
    the items before it in order, the frequent ones in ``prefix``.  The items of
    the prefixes that are frequent with a suffix give the itemsets of the level;
    each of them becomes the suffix of a row whose prefix is what stands before
    it, and equal rows are added up again.  This is FP-growth with its trees kept
    as rows that are grouped and shuffled: no tree is built, merged or serialised
    in a task.  The frequent itemsets are written to the shared checkpoint folder,
    so every later use (rules, combos, overview) reads them.  ``num_partitions``
    spreads the item-sets over so many partitions.
    """
    from tillroll.session import write_table

    sets = baskets.groupBy("items").agg(F.count(F.lit(1)).alias("n"))
    if num_partitions:
        sets = sets.repartition(int(num_partitions))
    sets = write_table(sets.withColumn("id", F.monotonically_increasing_id()), "basket-sets")
    n = sets.agg(F.sum("n")).first()[0] or 0
    support = F.col("freq") / F.lit(max(n, 1))

    def frequent(rows: DataFrame, name: str, *by: str) -> DataFrame:
        return write_table(rows.groupBy(*by, "item").agg(F.sum("n").alias("freq")).filter(support >= float(min_support)), name)

    entries = sets.select("id", "n", F.explode(F.array_distinct("items")).alias("item"))
    single = frequent(entries, "items-1")
    found = [single.select(F.array("item").alias("items"), "freq")]
    # item-sets without their rare items; sets of one item grow no further
    level = (entries.join(single.select("item"), "item").groupBy("id")
             .agg(F.array_sort(F.collect_list("item")).alias("prefix"), F.first("n").alias("n"))
             .filter(F.size("prefix") > 1))
    level = _grown(level.withColumn("suffix", F.slice("prefix", 1, 0)))
    while True:
        level = write_table(level, f"projected-{len(found)}")
        pairs = frequent(level.select("suffix", "n", F.explode("prefix").alias("item")), f"items-{len(found) + 1}", "suffix")
        if not pairs.limit(1).count():
            break
        found.append(pairs.select(F.concat(F.array("item"), "suffix").alias("items"), "freq"))
        kept = pairs.groupBy("suffix").agg(F.collect_list("item").alias("kept"))
        level = _grown(level.join(kept, "suffix").withColumn("prefix", F.array_intersect("prefix", "kept")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return Mined(write_table(out.select("items", F.size("items").alias("size"), "freq", support.alias("support")), "itemsets"), n)


def _grown(level: DataFrame) -> DataFrame:
    """suffix, prefix, n: each item of a row's prefix joins its suffix, the items before it stay the prefix."""
    rows = level.select("suffix", "prefix", "n", F.posexplode("prefix").alias("p", "item")).filter(F.col("p") > 0)
    return (rows.select(F.concat(F.array("item"), "suffix").alias("suffix"), F.slice(F.col("prefix"), F.lit(1), F.col("p")).alias("prefix"), "n")
            .groupBy("suffix", "prefix").agg(F.sum("n").alias("n")))


def frequent_itemsets(baskets: DataFrame, min_support: float = K.MIN_SUPPORT,
                      num_partitions: int | None = None) -> DataFrame:
    """items (sorted array), size, freq, support — every itemset with support >= min_support."""
    return mine(baskets, min_support, num_partitions).itemsets


def association_rules(itemsets: DataFrame, min_lift: float = K.MIN_LIFT,
                      min_confidence: float = K.MIN_CONFIDENCE) -> DataFrame:
    """Rules A => C for every split of every frequent itemset of size >= 2.

    Columns: antecedents, consequents (sorted, ", "-joined), support,
    confidence, lift, leverage, conviction (infinite at confidence 1).
    Kept: lift >= min_lift and confidence >= min_confidence.  The support
    lookups are equi-joins on the sorted item arrays (an item's name may hold
    the text separator); AQE broadcasts the itemset side only when its runtime
    size is under the broadcast threshold.
    """
    from tillroll.session import write_table

    supports = itemsets.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))
    longest = itemsets.agg(F.max("size")).first()[0] or 0
    level = (itemsets.filter(F.col("size") >= 2)
             .select("items", "support", F.explode("items").alias("last")).withColumn("consequents", F.array("last")))
    levels = []
    for length in range(1, max(longest, 2)):
        kept = (level.filter(F.size("items") > length)
                .withColumn("antecedents", F.array_except("items", "consequents"))
                .join(supports, "antecedents")
                .withColumn("confidence", F.col("support") / F.col("antecedent_support"))
                .filter(F.col("confidence") >= min_confidence)
                .select("items", "support", "consequents", "last", "antecedents", "antecedent_support", "confidence"))
        if length < longest - 1:
            kept = write_table(kept, "rules")
        levels.append(kept)
        level = (kept.withColumn("next", F.explode(F.filter("items", lambda x: x > F.col("last"))))
                 .select("items", "support", F.col("next").alias("last"),
                         F.concat("consequents", F.array("next")).alias("consequents")))
    rules = levels[0]
    for kept in levels[1:]:
        rules = rules.unionByName(kept)
    c = supports.select(F.col("antecedents").alias("consequents"), F.col("antecedent_support").alias("consequent_support"))
    r = (rules.join(c, "consequents")
         .withColumn("lift", F.col("confidence") / F.col("consequent_support"))
         .withColumn("leverage", F.col("support")
                     - F.col("antecedent_support") * F.col("consequent_support"))
         .withColumn("conviction",
                     F.when(F.col("confidence") == 1, F.lit(float("inf")))
                     .otherwise((1 - F.col("consequent_support")) / (1 - F.col("confidence")))))
    return (r.filter(F.col("lift") >= min_lift)
            .select(F.array_join("antecedents", KEY_SEP).alias("antecedents"),
                    F.array_join("consequents", KEY_SEP).alias("consequents"), "support", "confidence", "lift",
                    "leverage", "conviction"))


def combo_top(rules: DataFrame, n_baskets: int, top_n: int = K.TOP_COMBOS,
              min_baskets: int = K.MIN_BASKETS) -> DataFrame:
    """Top rules by lift (ties by names) with 4-dp metrics, labels and a sentence.

    No rules when there are fewer than ``min_baskets`` baskets.
    """
    gate = F.lit(int(n_baskets) >= int(min_baskets))
    top = (rules.filter(gate)
           .orderBy(F.desc("lift"), "antecedents", "consequents").limit(int(top_n)))
    items = F.concat_ws(" + ", "antecedents", "consequents")
    conf4, lift4 = F.bround("confidence", 4), F.bround("lift", 4)
    return top.select(
        items.alias("items"), "antecedents", "consequents",
        F.bround("support", 4).alias("support"), conf4.alias("confidence"),
        lift4.alias("lift"),
        lift_strength(lift4).alias("strength"), lift_priority(lift4).alias("priority"),
        F.format_string("Bundle '%s' — %s%% of customers who buy one also buy the other "
                        "(lift %sx)", items, F.format_number(conf4 * 100, 0),
                        F.format_number(lift4, 2)).alias("recommendation"))


def combo_kpis(combos: DataFrame) -> DataFrame:
    """One row: rules shown, rules with lift >= 2 and their share, max lift, mean confidence."""
    return (combos.agg(F.count("*").alias("n_rules"),
                       F.count_if(F.col("lift") >= 2).alias("n_strong"),
                       F.max("lift").alias("max_lift"),
                       F.avg("confidence").alias("mean_confidence"))
            .withColumn("strong_share_pct",
                        F.when(F.col("n_rules") > 0,
                               F.col("n_strong") / F.col("n_rules") * 100).otherwise(0.0)))


def pair_counts(baskets: DataFrame, keys: Sequence[str] = ("branch", "customer"),
                chunk: int = 2048) -> DataFrame:
    """a, b (a < b), both: baskets containing both items.

    Baskets with at most ``chunk`` distinct items pair their items inside the
    basket's row (no shuffle).  A larger basket is split: its items are
    hashed into k = ceil(size / chunk) chunks and every chunk pair (i <= j)
    becomes one join key, so the pairs of a basket holding a third of all
    lines are produced by k(k+1)/2 tasks of at most chunk^2 pairs each.
    Counts are partially aggregated before the shuffle.
    """
    keys = list(keys)
    b = baskets.withColumn("d", F.size("items"))
    small = (b.filter(F.col("d") <= chunk)
             .select("items", F.posexplode("items").alias("p", "a"))
             .select("a", F.explode(F.slice("items", F.col("p") + 2, F.size("items")))
                     .alias("b")))
    k = F.ceil(F.col("d") / chunk)
    e = (b.filter(F.col("d") > chunk)
         .select(*keys, k.alias("k"), F.explode("items").alias("item"))
         .withColumn("c", F.pmod(F.xxhash64("item"), F.col("k"))))
    left = e.select(*keys, F.col("item").alias("a"), F.col("c").alias("ci"),
                    F.explode(F.sequence(F.col("c"), F.col("k") - 1)).alias("cj"))
    right = e.select(*keys, F.col("item").alias("b2"), F.col("c").alias("cj"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("c"))).alias("ci"))
    big = (left.join(right, [*keys, "ci", "cj"])
           .filter((F.col("ci") < F.col("cj")) | (F.col("a") < F.col("b2")))
           .select(F.least("a", "b2").alias("a"), F.greatest("a", "b2").alias("b")))
    return small.unionByName(big).groupBy("a", "b").agg(F.count("*").alias("both"))


def item_pairs(baskets: DataFrame, top_n: int | None = K.TOP_PAIRS,
               keys: Sequence[str] = ("branch", "customer"), chunk: int = 2048) -> DataFrame:
    """Most frequent co-occurring item pairs (the fallback when nothing is frequent).

    confidence is the larger of both directions; lift = P(b|a) / P(b).
    """
    n = basket_count(baskets).scalar()
    single = (baskets.select(F.explode("items").alias("item"))
              .groupBy("item").agg(F.count("*").alias("cnt")))
    pairs = pair_counts(baskets, keys, chunk)
    sa = single.select(F.col("item").alias("a"), F.col("cnt").alias("cnt_a"))
    sb = single.select(F.col("item").alias("b"), F.col("cnt").alias("cnt_b"))
    out = _pair_measures(pairs.join(sa, "a").join(sb, "b").withColumn("n_baskets", n))
    out = out.orderBy(F.desc("support"), "antecedents", "consequents")
    return out.limit(int(top_n)) if top_n else out


def top_pairs(baskets: DataFrame, top_n: int = K.TOP_PAIRS, keys: Sequence[str] = ("branch", "customer"),
              head: int = 64, chunk: int = 2048) -> DataFrame:
    """The ``top_n`` rows of ``item_pairs`` without forming the pairs of rare items.

    A pair occurs in no more baskets than its rarer item.  Items enter by falling
    count, first the ``head`` most frequent ones; the kth count found so far bounds from
    below what can still be among the first k, so items below it never enter, and
    the search ends when every item at or above it is in.  Items whose count equals
    the bound do enter: ties go by name, as in ``item_pairs``.  Each round is one job over
    the baskets, whose items carry their counts; only k rows reach the driver.
    """
    from tillroll.session import write_table

    keys = list(keys)
    entries = baskets.select(*keys, F.explode("items").alias("item"))
    single = write_table(entries.groupBy("item").agg(F.count("*").alias("cnt")), "item-counts")
    n = basket_count(baskets).collect()[0][0]
    counted = write_table(
        entries.join(single, "item").groupBy(*keys).agg(F.collect_list(F.struct("cnt", "item")).alias("items"))
        .where(F.size("items") > 1), "counted-baskets")
    spark = baskets.sparkSession
    first = single.orderBy(F.desc("cnt"), "item").limit(int(head)).agg(F.min("cnt")).collect()[0][0]
    found, least = [], first or 0
    while least:
        part = counted.select(*keys, F.transform(F.filter("items", lambda x: x["cnt"] >= F.lit(least)), lambda x: x["item"]).alias("items"))
        found = (pair_counts(part.where(F.size("items") > 1), keys, chunk)
                 .orderBy(F.desc("both"), "a", "b").limit(int(top_n)).collect())
        bound = found[-1].both if len(found) == int(top_n) else 1
        rest = single.where((F.col("cnt") < least) & (F.col("cnt") >= bound)).agg(F.max("cnt")).collect()[0][0]
        if rest is None:
            break
        least = max(bound, min(rest, least // 4))
    pairs = spark.createDataFrame([tuple(r) for r in found], f"a {_type_of(baskets)}, b {_type_of(baskets)}, both long")
    sa = single.select(F.col("item").alias("a"), F.col("cnt").alias("cnt_a"))
    sb = single.select(F.col("item").alias("b"), F.col("cnt").alias("cnt_b"))
    return _pair_measures(pairs.join(sa, "a").join(sb, "b").withColumn("n_baskets", F.lit(n))).orderBy(
        F.desc("support"), "antecedents", "consequents")


def _type_of(baskets: DataFrame) -> str:
    return baskets.schema["items"].dataType.elementType.simpleString()


def _pair_measures(j: DataFrame) -> DataFrame:
    """Support, confidence and lift of (a, b, both, cnt_a, cnt_b, n_baskets)."""
    conf_ab = F.col("both") / F.greatest(F.col("cnt_a"), F.lit(1))
    conf_ba = F.col("both") / F.greatest(F.col("cnt_b"), F.lit(1))
    return j.select(
        F.col("a").alias("antecedents"), F.col("b").alias("consequents"),
        (F.col("both") / F.col("n_baskets")).alias("support"),
        F.greatest(conf_ab, conf_ba).alias("confidence"),
        (conf_ab / F.greatest(F.col("cnt_b") / F.col("n_baskets"), F.lit(1e-9))).alias("lift"))


def top_items_by_qty(lines: DataFrame, top_n: int = 10, item: str = "item",
                     qty: str = "qty", price: str = "price") -> DataFrame:
    """Best-selling items by quantity over paid lines (charges are not excluded)."""
    paid = paid_lines(lines, item=item, qty=qty, price=price, exclude=None)
    return (paid.filter(F.col("item").isNotNull()).groupBy("item")
            .agg(F.sum("qty").alias("qty"))
            .orderBy(F.desc("qty"), "item").limit(int(top_n))
            .withColumn("recommendation",
                        F.format_string("Promote %s as a featured item (sold %s units)",
                                        F.col("item"), fixed("qty", 0))))


def top_items_by_revenue(sales: DataFrame, top_n: int = 20) -> DataFrame:
    """Top items by summed revenue."""
    return (sales.filter(F.col("item").isNotNull()).groupBy("item")
            .agg(money_sum("total_amount").alias("total_revenue"), F.sum("qty").alias("total_qty"))
            .orderBy(F.desc("total_revenue"), "item").limit(int(top_n)))


def combo_summary(rules: DataFrame, n_baskets: int, lines: DataFrame,
                  top_n: int = K.TOP_COMBOS, itemsets: DataFrame | None = None,
                  baskets: DataFrame | None = None) -> DataFrame:
    """method, items, support, confidence, lift, qty, recommendation.

    The top rules (``method`` = apriori); where no itemset is frequent, the most
    frequent item pairs take their place (needs ``itemsets`` and ``baskets``);
    when there is neither, the best-selling single items (``method`` =
    top_single_items).  The switches are scalar subqueries, decided inside the
    plan before the fallbacks' input is aggregated.
    """
    if itemsets is not None and baskets is not None:
        names = ["antecedents", "consequents", "support", "confidence", "lift"]
        n_frequent = itemsets.agg(F.count("*")).scalar()
        pairs = item_pairs(baskets.filter(n_frequent == 0), K.TOP_PAIRS)
        # pairs come by support; combos are ordered by lift, so the first top_n pairs are taken before
        rules = rules.select(*names).unionByName(pairs.select(*names).limit(int(top_n)))
    combos = combo_top(rules, n_baskets, top_n)
    n = combos.agg(F.count("*")).scalar()
    none = F.lit(None).cast("double")
    a = combos.select(
        F.lit("apriori").alias("method"), "items", "support", "confidence", "lift",
        none.alias("qty"), "recommendation")
    b = top_items_by_qty(lines.filter(n == 0), 10).select(
        F.lit("top_single_items").alias("method"), F.col("item").alias("items"),
        none.alias("support"), none.alias("confidence"), none.alias("lift"), "qty",
        "recommendation")
    return a.unionByName(b)
