"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or views Spark derives from them) in
full; a limit appears only where the query is a top-k report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.functions.scalar import clean_number, compact_cells, duration_hours, money, money_sum
from tillroll.operators import baskets, bins, branches, demand, itemsets, quantiles, segments, series, staffing, topics
from tillroll.plans import roundtrip
from tillroll.sources import reports
from tillroll.session import write_table
from tillroll.sources import tables as tb
from tillroll.sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
PLANS: dict[str, Callable[[Tables], DataFrame]] = {}


def query(name: str):
    def deco(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        PLANS[name] = fn
        return fn
    return deco


# --- staffing -----------------------------------------------------------------
@query("shift_assign")
def q_shift_assign(t: Tables) -> DataFrame:
    """Punch hour, shift bucket and weekday of every real attendance record."""
    return staffing.assign_shifts(tb.attendance(t)).select(
        "employee_id", "branch", "date", "punch_hour", "shift", "day_of_week")


@query("daily_headcount")
def q_daily_headcount(t: Tables) -> DataFrame:
    return staffing.daily_headcount(tb.attendance(t))


@query("shift_staffing")
def q_shift_staffing(t: Tables) -> DataFrame:
    return staffing.shift_staffing(tb.attendance(t))


@query("staffing_by_day")
def q_staffing_by_day(t: Tables) -> DataFrame:
    return staffing.staffing_by_day(tb.attendance(t))


@query("hours_by_branch")
def q_hours_by_branch(t: Tables) -> DataFrame:
    return staffing.hours_by_branch(tb.attendance(t))


@query("hours_histogram")
def q_hours_histogram(t: Tables) -> DataFrame:
    return staffing.hours_histogram(tb.attendance(t))


@query("staffing_kpis")
def q_staffing_kpis(t: Tables) -> DataFrame:
    return staffing.staffing_kpis(staffing.shift_staffing(tb.attendance(t)))


@query("staffing_alerts")
def q_staffing_alerts(t: Tables) -> DataFrame:
    return staffing.staffing_alerts(staffing.shift_staffing(tb.attendance(t)))


# --- demand -------------------------------------------------------------------
@query("demand_growth")
def q_demand_growth(t: Tables) -> DataFrame:
    return demand.demand_growth(tb.monthly_sales(t))


@query("demand_forecast")
def q_demand_forecast(t: Tables) -> DataFrame:
    return demand.demand_forecast(tb.monthly_sales(t), 3)


@query("forecast_branch")
def q_forecast_branch(t: Tables) -> DataFrame:
    """The forecast of one branch (the filter reaches the scan)."""
    return demand.forecast_branch(tb.monthly_sales(t), "BUILDING", 3)


@query("forecast_branch_missing")
def q_forecast_branch_missing(t: Tables) -> DataFrame:
    """A branch without data: one row with the error."""
    return demand.forecast_branch(tb.monthly_sales(t), "NO SUCH BRANCH", 3)


@query("demand_ranking")
def q_demand_ranking(t: Tables) -> DataFrame:
    return demand.demand_ranking(tb.monthly_sales(t), 3)


@query("demand_trend")
def q_demand_trend(t: Tables) -> DataFrame:
    return demand.demand_trend(tb.monthly_sales(t))


# --- segments -----------------------------------------------------------------


class SharedTables(Tables):
    """Tables of queries that run together: the classified line items are joined, summed and written once for all."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        # exact decimals, so that sums of the sums equal sums of the lines
        self.segment_items = write_table(_seg(Tables(spark, sf_dir)).groupBy("branch", "segment", "item").agg(
            F.sum("qty").alias("qty"), F.sum(money("total_amount")).alias("total_amount")), "segment-items")


def _seg(t: Tables) -> DataFrame:
    if isinstance(t, SharedTables):
        return t.segment_items
    return segments.classify(tb.item_sales(t), "item", tb.PART_MILKSHAKE_KEYWORDS,
                             tb.PART_COFFEE_KEYWORDS, tb.PART_CHIMNEY_KEYWORDS)


def _seg_items(t: Tables) -> DataFrame:
    """Classified lines summed by branch, segment and item, written once: reports that need
    several figures read this table instead of joining the lines again."""
    return write_table(_seg(t).groupBy("branch", "segment", "item")
                       .agg(F.sum("qty").alias("qty"), money_sum("total_amount").alias("total_amount")), "segment-items")


@query("segment_classify")
def q_segment_classify(t: Tables) -> DataFrame:
    """Segment of every distinct item name."""
    return _seg(t).select("item", "segment").distinct()


@query("segment_share")
def q_segment_share(t: Tables) -> DataFrame:
    return segments.segment_share(_seg(t))


@query("top_segment_items")
def q_top_segment_items(t: Tables) -> DataFrame:
    s = _seg_items(t)
    return (segments.top_segment_items(s, "coffee", 10)
            .unionByName(segments.top_segment_items(s, "milkshake", 10)))


@query("segment_comparison")
def q_segment_comparison(t: Tables) -> DataFrame:
    return segments.segment_comparison(_seg(t))


@query("segment_totals")
def q_segment_totals(t: Tables) -> DataFrame:
    return segments.segment_totals(_seg(t))


@query("segment_pivot")
def q_segment_pivot(t: Tables) -> DataFrame:
    return segments.segment_pivot(segments.segment_share(_seg(t)))


@query("segment_performance")
def q_segment_performance(t: Tables) -> DataFrame:
    return segments.segment_performance(segments.segment_share(_seg(t)))


@query("beverage_gap")
def q_beverage_gap(t: Tables) -> DataFrame:
    return segments.beverage_gap(segments.segment_share(_seg(t)))


@query("beverage_gap_network")
def q_beverage_gap_network(t: Tables) -> DataFrame:
    return segments.beverage_gap_network(segments.segment_totals(_seg(t)))


@query("growth_actions")
def q_growth_actions(t: Tables) -> DataFrame:
    s = _seg_items(t)
    return segments.growth_actions(s, segments.segment_share(s))


# --- branches / expansion -------------------------------------------------------
CHANNELS = tb.DRIVER_CHANNELS


def _kpis(t: Tables) -> DataFrame:
    return branches.branch_kpis(tb.monthly_sales(t), tb.branch_revenue(t),
                                tb.menu_channels(t), CHANNELS)


@query("branch_growth")
def q_branch_growth(t: Tables) -> DataFrame:
    return branches.branch_growth(tb.monthly_sales(t))


@query("channel_mix")
def q_channel_mix(t: Tables) -> DataFrame:
    return branches.channel_mix(tb.menu_channels(t), CHANNELS)


@query("branch_kpis")
def q_branch_kpis(t: Tables) -> DataFrame:
    return _kpis(t)


@query("expansion_signals")
def q_expansion_signals(t: Tables) -> DataFrame:
    return branches.expansion_signals(_kpis(t))


@query("score_candidates")
def q_score_candidates(t: Tables) -> DataFrame:
    """All candidate locations ranked (the top 3 are the report's picks)."""
    return branches.score_candidates(tb.candidate_sites(t),
                                     branches.expansion_signals(_kpis(t)))


# --- baskets --------------------------------------------------------------------
def _baskets(t: Tables) -> DataFrame:
    return tb.order_baskets(t)


@query("baskets")
def q_baskets(t: Tables) -> DataFrame:
    return _baskets(t).select("branch", "customer",
                              F.array_join("items", ", ").alias("items"),
                              F.size("items").alias("n_items"))


@query("item_frequency")
def q_item_frequency(t: Tables) -> DataFrame:
    return baskets.item_frequency(_baskets(t))


@query("basket_stats")
def q_basket_stats(t: Tables) -> DataFrame:
    return baskets.basket_stats(_baskets(t))


# Driver tables are uniform random (lift ~ 1), so the registered rule queries
# keep lift >= 1.0 and confidence >= 0.1 to have rules to compare; the
# operators' defaults are the analysed application's 1.2 / 0.3.
RULE_MIN_SUPPORT, RULE_MIN_LIFT, RULE_MIN_CONF = 0.02, 1.0, 0.1
FLAG_MIN_LIFT = 0.1       # few flags share an order's lines: they repel each other
# no itemset has this support, no rule this lift: the fallbacks are taken
NONE_FREQUENT, NO_LIFT = 0.9, 99.0


@query("frequent_itemsets")
def q_frequent_itemsets(t: Tables) -> DataFrame:
    fi = baskets.frequent_itemsets(_baskets(t), RULE_MIN_SUPPORT)
    return fi.select(F.array_join("items", ", ").alias("itemset"), "size", "freq", "support")


def _rules(t: Tables) -> tuple[DataFrame, int]:
    m = baskets.mine(_baskets(t), RULE_MIN_SUPPORT)
    return baskets.association_rules(m.itemsets, RULE_MIN_LIFT, RULE_MIN_CONF), m.n_baskets


@query("association_rules_triples")
def q_association_rules_triples(t: Tables) -> DataFrame:
    """Rules between return flags in an order: itemsets of three items, so longer consequents too."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("customer"), F.col("l_returnflag").alias("item"),
                              F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    m = baskets.mine(baskets.build_baskets(lines, ["customer"]), RULE_MIN_SUPPORT)
    return baskets.association_rules(m.itemsets, FLAG_MIN_LIFT, RULE_MIN_CONF)


@query("association_rules")
def q_association_rules(t: Tables) -> DataFrame:
    return _rules(t)[0]


@query("combo_top")
def q_combo_top(t: Tables) -> DataFrame:
    return baskets.combo_top(*_rules(t), 10)


@query("combo_kpis")
def q_combo_kpis(t: Tables) -> DataFrame:
    return baskets.combo_kpis(baskets.combo_top(*_rules(t), 10))


def _summary(t: Tables, min_support: float, min_lift: float) -> DataFrame:
    bk = write_table(_baskets(t), "baskets")
    m = baskets.mine(bk, min_support)
    return baskets.combo_summary(baskets.association_rules(m.itemsets, min_lift, RULE_MIN_CONF), m.n_baskets,
                                 tb.delivery_lines(t), 10, m.itemsets, bk)


@query("combo_summary")
def q_combo_summary(t: Tables) -> DataFrame:
    """Top rules; the most frequent pairs or the best-selling single items where there are none."""
    return _summary(t, RULE_MIN_SUPPORT, RULE_MIN_LIFT)


@query("combo_summary_pairs")
def q_combo_summary_pairs(t: Tables) -> DataFrame:
    """The summary where no itemset is frequent: item pairs."""
    return _summary(t, NONE_FREQUENT, RULE_MIN_LIFT)


@query("combo_summary_single")
def q_combo_summary_single(t: Tables) -> DataFrame:
    """The summary where itemsets but no rules are found: single items."""
    return _summary(t, RULE_MIN_SUPPORT, NO_LIFT)


@query("item_pairs")
def q_item_pairs(t: Tables) -> DataFrame:
    # written once: the basket count, the single counts and the pairs read the table
    return baskets.item_pairs(write_table(_baskets(t), "baskets"), 20)


@query("top_items_by_qty")
def q_top_items_by_qty(t: Tables) -> DataFrame:
    return baskets.top_items_by_qty(tb.delivery_lines(t), 10)


@query("top_items_by_revenue")
def q_top_items_by_revenue(t: Tables) -> DataFrame:
    return baskets.top_items_by_revenue(tb.item_sales(t), 20)


# --- report primitives over driver data ---------------------------------------



@query("clean_number")
def q_clean_number(t: Tables) -> DataFrame:
    """Prices rendered as report text ("12,345.67", quoted, "-" for zero) and parsed back."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    price_text = F.format_number("l_extendedprice", 2)
    disc_text = F.when(F.col("l_discount") == 0, F.lit("-")).otherwise(
        F.concat(F.lit('"'), F.format_number("l_discount", 2), F.lit('"')))
    return li.select("l_orderkey", "l_linenumber",
                     price_text.alias("price_text"), clean_number(price_text).alias("price"),
                     disc_text.alias("discount_text"), clean_number(disc_text).alias("discount"))


@query("duration_hours")
def q_duration_hours(t: Tables) -> DataFrame:
    """Punch times ("HH.mm.ss") and long spans ("H:MM:SS", H may exceed 24) to hours."""
    e = t.events.select("event_id", "ts", "value")
    h = F.floor("value")
    m = F.floor(F.col("value") * 60) % 60
    s = F.floor(F.col("value") * 3600) % 60
    span = F.format_string("%d:%02d:%02d", h, m, s)
    clock = F.date_format("ts", "HH.mm.ss")
    return e.select("event_id", clock.alias("clock_text"),
                    duration_hours(clock).alias("clock_hours"),
                    span.alias("span_text"), duration_hours(span).alias("span_hours"))


@query("compact_cells")
def q_compact_cells(t: Tables) -> DataFrame:
    """Order rows rendered as CSV report lines with blank and quoted cells, then compacted."""
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    line = F.concat_ws(",", F.lit(""), "o_orderpriority", F.lit(""),
                       F.concat(F.lit('"'), F.format_number("o_totalprice", 2), F.lit('"')),
                       F.lit("  "), "o_orderstatus", F.lit(""))
    vals = compact_cells(reports.csv_cells(line, 8))
    return o.select("o_orderkey", F.size(vals).alias("n_cells"),
                    F.array_join(vals, "|").alias("cells"))


@query("drop_boilerplate")
def q_drop_boilerplate(t: Tables) -> DataFrame:
    """Conversation turns as report rows; footer rows and page-header rows are dropped."""
    c = t.conversations.select("conv_id", "turn", "role", "text")
    rows_ = c.withColumn("cells", F.array("role", "text"))
    kept = reports.drop_boilerplate(rows_, "cells", header_keywords=["Page", "Total"])
    return kept.select("conv_id", "turn")


@query("forward_fill_context")
def q_forward_fill_context(t: Tables) -> DataFrame:
    """Customer context carried down a per-segment "report" of order lines.

    One report per market segment (a few hot groups); a header line per
    customer with a positive balance, none for the others, so their lines
    inherit the previous customer's name, also across block boundaries.
    Blocks are ranges of 16 customer keys.
    """
    cust = t.customer.select("c_custkey", "c_name", "c_acctbal",
                             F.col("c_mktsegment").alias("branch"))
    o = t.orders.select("o_orderkey", "o_custkey")
    li = t.lineitem.select("l_orderkey", "l_linenumber")
    detail = (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(cust, o.o_custkey == cust.c_custkey)
              .select("branch", F.col("o_custkey").alias("ck"), "l_orderkey", "l_linenumber",
                      F.lit(None).cast("string").alias("ctx")))
    header = (cust.filter(F.col("c_acctbal") > 0)
              .select("branch", F.col("c_custkey").alias("ck"),
                      F.lit(-1).cast("long").alias("l_orderkey"),
                      F.lit(-1).alias("l_linenumber"), F.col("c_name").alias("ctx")))
    lines = (detail.unionByName(header)
             .withColumn("block", (F.col("ck") / 16).cast("long"))
             .withColumn("seq", F.struct("ck", "l_orderkey", "l_linenumber")))
    # ranges of 4096 blocks: no window of the carry grows with the number of customers of a branch
    filled = reports.forward_fill_blocked(lines, ["ctx"], group="branch", span=4096)
    return (filled.filter(F.col("l_orderkey") >= 0)
            .select("branch", "l_orderkey", "l_linenumber", F.col("ctx").alias("customer")))


@query("result_sink")
def q_result_sink(t: Tables) -> DataFrame:
    """Shift staffing written as JSON lines to the shared folder and read back."""
    import uuid

    from tillroll.session import ensure_checkpoint_dir
    from tillroll.sources.sinks import write_result
    df = staffing.shift_staffing(tb.attendance(t))
    path = write_result(df, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/tillroll-results/{uuid.uuid4().hex}")
    return t.spark.read.schema(df.schema).json(path)


@query("dataset_profile")
def q_dataset_profile(t: Tables) -> DataFrame:
    """Row and column counts of every driver table."""
    from tillroll.sources.parsers import dataset_profile
    from tillroll.sources.tables import TABLE_NAMES
    return dataset_profile({n: getattr(t, n) for n in TABLE_NAMES})


@query("column_profile")
def q_column_profile(t: Tables) -> DataFrame:
    """Rows, nulls, least and greatest value of every plain column of every table, from Parquet footers."""
    from tillroll.sources.profile import column_profile
    from tillroll.sources.tables import TABLE_NAMES
    return column_profile(t.spark, {n: f"{t.sf_dir.rstrip('/')}/{n}.parquet" for n in TABLE_NAMES})


# --- topics ---------------------------------------------------------------------
@query("topic_classify")
def q_topic_classify(t: Tables) -> DataFrame:
    """Topic of every conversation turn."""
    c = t.conversations.select("conv_id", "turn", "text")
    return topics.classify_topics(c, "text").drop("text")


@query("topic_classify_documents")
def q_topic_classify_documents(t: Tables) -> DataFrame:
    """Topic of every document (whole texts)."""
    d = t.documents.select("doc_id", "text")
    return topics.classify_topics(d, "text").drop("text")


@query("topic_classify_one_pass")
def q_topic_classify_one_pass(t: Tables) -> DataFrame:
    """Topic of every conversation turn, all keywords found in one scan of the text."""
    c = t.conversations.select("conv_id", "turn", "text")
    return topics.classify_topics_one_pass(c, "text").drop("text")


@query("topic_counts")
def q_topic_counts(t: Tables) -> DataFrame:
    c = t.conversations.select("text")
    return topics.topic_counts(topics.classify_topics(c, "text"))


# --- text reports and overview ----------------------------------------------------
@query("demand_insight")
def q_demand_insight(t: Tables) -> DataFrame:
    return demand.demand_insight(tb.monthly_sales(t), 3)


@query("network_overview")
def q_network_overview(t: Tables) -> DataFrame:
    from tillroll.plans.overview import network_overview
    return network_overview(t)


# --- remaining report pieces ----------------------------------------------------
@query("top_slots")
def q_top_slots(t: Tables) -> DataFrame:
    """The four shift slots needing the most staff."""
    return staffing.top_slots(staffing.shift_staffing(tb.attendance(t)), 4)


@query("worst_decline")
def q_worst_decline(t: Tables) -> DataFrame:
    return demand.worst_decline(tb.monthly_sales(t))


@query("expansion_recommendations")
def q_expansion_recommendations(t: Tables) -> DataFrame:
    sig = branches.expansion_signals(_kpis(t))
    return branches.expansion_recommendations(
        sig, branches.score_candidates(tb.candidate_sites(t), sig), 2)


# --- operators that compose, refine or bound their work --------------------------
@query("top_item_pairs")
def q_top_item_pairs(t: Tables) -> DataFrame:
    """The most frequent item pairs by bound: items enter by falling count, pairs of rare items are never formed."""
    return baskets.top_pairs(tb.order_baskets(t))


@query("itemsets_vertical")
def q_itemsets_vertical(t: Tables) -> DataFrame:
    """Frequent itemsets by vertical bitmaps, joined to text as in ``frequent_itemsets``."""
    fi = itemsets.frequent_itemsets(_baskets(t), RULE_MIN_SUPPORT)
    return fi.select(F.array_join("items", ", ").alias("itemset"), "size", "freq", "support")


@query("staff_rollup")
def q_staff_rollup(t: Tables) -> DataFrame:
    """Distinct staff per shift and day, weekday, month, branch and in the network from one set of bitmaps."""
    return staffing.staff_rollup(tb.attendance(t))


@query("hours_quantiles")
def q_hours_quantiles(t: Tables) -> DataFrame:
    """Exact quantiles of worked hours per branch by bucket refinement."""
    real = tb.attendance(t).where(F.col("work_hours") > K.GHOST_PUNCH_HOURS)
    return quantiles.exact_quantiles(real, ["branch"], "work_hours")


@query("demand_fit")
def q_demand_fit(t: Tables) -> DataFrame:
    """Trend fit of every branch from one part a year, joined."""
    return series.fit(series.join_parts(series.fold(tb.monthly_sales(t))))


@query("demand_fit_appended")
def q_demand_fit_appended(t: Tables) -> DataFrame:
    """The same fit from a stored part of the years before the last one, and the months of the last year appended."""
    months = tb.monthly_sales(t)
    last = months.agg(F.max("year")).scalar()
    stored = write_table(series.join_parts(series.fold(months.where(F.col("year") < last))), "series-parts")
    return series.fit(series.append(stored, months.where(F.col("year") == last)))


@query("shift_bins")
def q_shift_bins(t: Tables) -> DataFrame:
    """Records per branch, day part and month by a table of bins: a general one, and own ones of some branches and months."""
    att = staffing.assign_shifts(tb.attendance(t)).where(F.col("branch").isNotNull()).withColumn("record", F.monotonically_increasing_id())
    span = att.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    middle = span.select(F.date_add("a", (F.datediff("b", "a") / 2).cast("int"))).scalar()
    general = t.spark.createDataFrame([(6, 14, "morning", 1), (14, 22, "afternoon", 1), (22, 6, "night", 1)],
                                      "from_hour int, to_hour int, label string, rank int")
    every = general.select(F.lit(None).cast("string").alias("branch"), F.lit(None).cast("date").alias("valid_from"),
                           F.lit(None).cast("date").alias("valid_to"), "from_hour", "to_hour", "label", "rank")
    # every branch has a rush hour of its own in the second half of the span, and the long day shadows it at noon
    own = att.select("branch").distinct().withColumn("h", F.pmod(F.ascii(F.substring("branch", 1, 1)), F.lit(20)).cast("int"))
    rush = own.select("branch", middle.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.col("h").alias("from_hour"),
                      (F.col("h") + 3).alias("to_hour"), F.lit("rush").alias("label"), F.lit(2).alias("rank"))
    noon = own.select("branch", F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
                      F.lit(12).alias("from_hour"), F.lit(13).alias("to_hour"), F.lit("noon").alias("label"), F.lit(1).alias("rank"))
    rows = bins.assign_bins(att, every.unionByName(rush).unionByName(noon), ["record"])
    return rows.groupBy("branch", "bin", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_records"))


@query("overview_sections")
def q_overview_sections(t: Tables) -> DataFrame:
    """The network overview as rows, with whole rankings."""
    from tillroll.plans.overview import overview_sections
    return overview_sections(t)


@query("report_catalog")
def q_report_catalog(t: Tables) -> DataFrame:
    """A mixed folder of all report layouts and a copy, found and parsed by content."""
    return roundtrip.report_catalog(t)


#: Reports that are published together.
PUBLISHED = ["shift_staffing", "staffing_by_day", "staffing_alerts", "demand_forecast", "demand_ranking", "demand_trend", "branch_kpis",
             "expansion_signals", "score_candidates", "segment_share", "segment_comparison", "segment_performance", "growth_actions", "combo_top"]


@query("published_reports")
def q_published_reports(t: Tables) -> DataFrame:
    """report, n_rows, n_columns, columns of every report, written, audited, published and counted in the published files."""
    from tillroll.session import ensure_checkpoint_dir
    from tillroll.sources.store import ResultStore
    import uuid
    store = ResultStore(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/tillroll-store/{uuid.uuid4().hex}")
    shared = SharedTables(t.spark, t.sf_dir)
    store.publish({name: PLANS[name](shared) for name in PUBLISHED}, "current")
    return store.catalog("current")


# --- report round trips (render driver data as report files, parse back) --------

for _name in ["report_monthly_sales", "report_branch_revenue", "report_item_sales",
              "report_delivery_lines", "report_customer_orders", "report_attendance",
              "report_menu_channels", "report_division_summary"]:
    query(_name)(getattr(roundtrip, _name))
