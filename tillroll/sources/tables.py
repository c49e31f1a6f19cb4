"""Driver tables and the retail domain views derived from them.

Each view is a lazy DataFrame over the parquet tables; Catalyst prunes the
columns each query needs and pushes filters into the scans.  Mapping:

==================  ==============================================================
domain view         built from
==================  ==============================================================
monthly_sales       orders x customer; branch = market segment; month of order date
branch_revenue      orders x customer; sum of order totals per branch
menu_channels       orders x customer; channel = order priority
delivery_lines      lineitem x orders x customer x part; basket = order, item = brand
item_sales          lineitem x orders x customer x part; item = part name
attendance          events; employee = user, branch = event type, hours = value
candidate_sites     nation x customer x supplier (per-nation derived scores)
==================  ==============================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.scalar import money_sum
from tillroll.session import write_table

TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]

# fixed values of the driver's tables: market segments (= branches) and order
# priorities (= menu channels)
DRIVER_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
DRIVER_CHANNELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# Keyword lists that map the driver's part names onto the product segments
# (cold drinks = milkshake, hot drinks = coffee, ring-shaped = chimney cake).
# "BLUE" sits in both drink lists to exercise the milkshake-first precedence.
PART_MILKSHAKE_KEYWORDS = ["COLD", "BLUE"]
PART_COFFEE_KEYWORDS = ["HOT", "RED", "BLUE"]
PART_CHIMNEY_KEYWORDS = ["RING"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fact tables: large at scale; spread over the cores when the session asks for
# it (see ``tillroll.session.spread``; a no-op on a cluster).
FACT_TABLES = {"lineitem", "orders", "events", "documents", "conversations", "pages"}


class Tables:
    """Lazy access to the driver tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            from tillroll.session import spread
            df = read_table(self.spark, self.sf_dir, name)
            return spread(df) if name in FACT_TABLES else df
        raise AttributeError(name)


class JoinedTables(Tables):
    """Tables of reports that are rendered together: orders and line items are joined and written once for all."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.orders_with_branch = self.lines_with_part = None
        self.orders_with_branch = write_table(_orders_with_branch(self), "orders-branch")
        self.lines_with_part = write_table(_lines_with_part(self), "lines-part")


def _orders_with_branch(t: Tables) -> DataFrame:
    if isinstance(t, JoinedTables) and t.orders_with_branch:
        return t.orders_with_branch
    c = t.customer.select("c_custkey", F.col("c_mktsegment").alias("branch"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                        "o_orderpriority")
    return o.join(c, o.o_custkey == c.c_custkey).drop("c_custkey")


def monthly_sales(t: Tables) -> DataFrame:
    """branch, year, month_num, month, total_sales — one row per branch-month."""
    o = _orders_with_branch(t)
    return (
        o.groupBy(
            "branch",
            F.year("o_orderdate").cast("int").alias("year"),
            F.month("o_orderdate").cast("int").alias("month_num"),
        )
        .agg(money_sum("o_totalprice").alias("total_sales"))
        .withColumn("month", F.date_format(F.make_date("year", "month_num", F.lit(1)), "MMMM"))
    )


def branch_revenue(t: Tables) -> DataFrame:
    """branch, revenue."""
    return (_orders_with_branch(t).groupBy("branch")
            .agg(money_sum("o_totalprice").alias("revenue")))


def menu_channels(t: Tables) -> DataFrame:
    """branch, menu_channel, num_customers, sales, avg_per_customer."""
    return (
        _orders_with_branch(t)
        .groupBy("branch", F.col("o_orderpriority").alias("menu_channel"))
        .agg(F.countDistinct("o_custkey").cast("double").alias("num_customers"),
             money_sum("o_totalprice").alias("sales"))
        .withColumn("avg_per_customer", F.col("sales") / F.col("num_customers"))
    )


def _lines_with_part(t: Tables) -> DataFrame:
    if isinstance(t, JoinedTables) and t.lines_with_part:
        return t.lines_with_part
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    o = _orders_with_branch(t).select("o_orderkey", "branch")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .join(o, li.l_orderkey == o.o_orderkey)
            .select("branch", "l_orderkey", "p_name", "p_brand", "p_type", "l_quantity", "l_extendedprice", "l_returnflag"))


def delivery_lines(t: Tables) -> DataFrame:
    """branch, customer (= basket key, the order), item (= brand), qty, price."""
    return _lines_with_part(t).select(
        "branch",
        F.col("l_orderkey").cast("string").alias("customer"),
        F.col("p_brand").alias("item"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
    )


def order_baskets(t: Tables) -> DataFrame:
    """branch, customer (= order key as text), items — the baskets of ``delivery_lines``.

    Equal to ``build_baskets(delivery_lines(t))`` but aggregated *before* the
    join with orders x customer: the order key determines the branch, so line
    items are reduced to one basket per order first and only the baskets are
    joined (the baskets come out partitioned by order key, which the join
    reuses).  This removes the shuffle of every line item for the join.
    """
    from tillroll.operators.baskets import build_baskets

    li = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    p = t.part.select("p_partkey", "p_brand")
    lines = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("order"), F.col("p_brand").alias("item"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    bk = build_baskets(lines, keys=["order"])
    o = _orders_with_branch(t).select("o_orderkey", "branch")
    return (bk.join(o, bk.order == o.o_orderkey)
            .filter(F.col("branch").isNotNull())
            .select("branch", F.col("order").cast("string").alias("customer"), "items"))


def item_sales(t: Tables) -> DataFrame:
    """branch, division (= part type), group (= brand), item (= part name), qty, total_amount."""
    return _lines_with_part(t).select(
        "branch",
        F.col("p_type").alias("division"),
        F.col("p_brand").alias("group"),
        F.col("p_name").alias("item"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("total_amount"),
    )


def attendance(t: Tables) -> DataFrame:
    """employee_id, employee_name, branch, date, punch_in, punch_out, work_hours."""
    e = t.events.select("user_id", "event_type", "ts", "value")
    return e.select(
        F.col("user_id").alias("employee_id"),
        F.format_string("Person_%04d", "user_id").alias("employee_name"),
        F.col("event_type").alias("branch"),
        F.to_date("ts").alias("date"),
        F.date_format("ts", "HH.mm.ss").alias("punch_in"),
        F.lit(None).cast("string").alias("punch_out"),
        F.col("value").alias("work_hours"),
    )


def candidate_sites(t: Tables) -> DataFrame:
    """location, growth_factor, demand_base, competition_risk — one per nation.

    growth_factor in [0.5, 1.5]: 0.5 + share of the nation's customers with a
    positive balance; demand_base in [60, 100]: scaled by customer count;
    competition_risk in [20, 60]: scaled by supplier count.
    """
    cust = (t.customer.groupBy(F.col("c_nationkey").alias("nk"))
            .agg(F.count("*").alias("n_cust"),
                 F.avg(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0)).alias("pos_share")))
    supp = (t.supplier.groupBy(F.col("s_nationkey").alias("nk"))
            .agg(F.count("*").alias("n_supp")))
    nat = t.nation.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("location"))
    per = (nat.join(cust, "nk", "left").join(supp, "nk", "left")
           .na.fill(0, ["n_cust", "n_supp"]).na.fill(0.0, ["pos_share"]))
    # global maxima as scalar subqueries (merged into one aggregate by the optimizer)
    max_cust = per.agg(F.max("n_cust")).scalar()
    max_supp = per.agg(F.max("n_supp")).scalar()
    return per.select(
        "location",
        (F.lit(0.5) + F.col("pos_share")).alias("growth_factor"),
        (F.lit(60.0) + F.lit(40.0) * F.coalesce(
            F.col("n_cust") / F.when(max_cust > 0, max_cust), F.lit(0.0)))
        .alias("demand_base"),
        (F.lit(20.0) + F.lit(40.0) * F.coalesce(
            F.col("n_supp") / F.when(max_supp > 0, max_supp), F.lit(0.0)))
        .alias("competition_risk"),
    )
