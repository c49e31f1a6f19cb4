"""Report round trips: driver data rendered as report files, then parsed back.

Each query renders a domain view as the text lines of one report layout,
writes them to the shared checkpoint folder (``spark.checkpoint.dir``) and
runs the layout's parser over the written files, so the parsers are exercised
on inputs that grow with the tables.

A report is made of *sections* (a branch, an employee-month, an order ...).
Every section carries its own hierarchy header lines, as reports repeat them
after a page break, so sections can be spread over many files: no single
file (and no single task) receives a hot branch.  Files hold whole sections,
lines sorted within each file.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions.scalar import money, money_sum
from tillroll.session import ensure_checkpoint_dir
from tillroll.sources import parsers as P
from tillroll.sources import tables as tb
from tillroll.sources.catalog import load_catalog
from tillroll.sources.reports import read_report_lines
from tillroll.sources.tables import Tables

SEGMENTS = tb.DRIVER_SEGMENTS
PRIORITIES = tb.DRIVER_CHANNELS


def csv_line(cells: Sequence[Column | str], width: int) -> Column:
    """Comma-joined cells padded with empty cells to ``width`` fields."""
    cols = [F.coalesce(F.lit(c) if isinstance(c, str) else c.cast("string"), F.lit(""))
            for c in cells]
    cols += [F.lit("")] * (width - len(cols))
    return F.concat_ws(",", *cols)


def quoted(amount: Column) -> Column:
    """``"12,345.67"``"""
    return F.concat(F.lit('"'), F.format_number(amount, 2), F.lit('"'))


def fixed2(x: Column) -> Column:
    """``%.2f``; whole numbers need no formatter."""
    return (F.when((x > 0) & (x < 1e15) & (x == F.floor(x)), F.concat(x.cast("long").cast("string"), F.lit(".00")))
            .otherwise(F.format_string("%.2f", x)))


def two_digits(x: Column) -> Column:
    """``%02d``; usual numbers need no formatter."""
    return F.when((x >= 0) & (x <= 99), F.lpad(x.cast("string"), 2, "0")).otherwise(F.format_string("%02d", x))


def write_report(lines: DataFrame, path: str | None = None) -> str:
    """Write ``text`` lines in their order."""
    path = path or f"{ensure_checkpoint_dir(lines.sparkSession).rstrip('/')}/tillroll-reports/{uuid.uuid4().hex}"
    lines.select("text").write.text(path)
    return path


@dataclass
class Rendered:
    """Rows of a report in sections, the line of a row and those before and after a section, and how they are parsed back."""

    spark: SparkSession
    rows: DataFrame
    section: Sequence[str]
    order: Sequence[str]
    line: Column
    parser: Callable[..., DataFrame]
    options: dict
    before: Sequence[Column] = ()
    after: Sequence[Column] = ()
    columns: Sequence[str] | None = None

    def lines(self) -> DataFrame:
        """text: whole sections, their rows sorted, made in one pass: the first and last row of a section bring its other lines."""
        w = Window.partitionBy(*self.section).orderBy(*self.order)
        none = F.array().cast("array<string>")
        rows = self.rows.select("*", (F.row_number().over(w) == 1).alias("_first"), F.lead(F.lit(False), 1, True).over(w).alias("_last"))
        rows = rows.withColumn("_line", self.line)               # made before lines are dealt out, as a generator makes what is equal anew
        parts = [F.array("_line")]
        if self.before:
            parts.insert(0, F.when(F.col("_first"), F.array(*self.before)).otherwise(none))
        if self.after:
            parts.append(F.when(F.col("_last"), F.array(*self.after)).otherwise(none))
        return rows.select(F.explode(F.concat(*parts)).alias("text"))

    def write(self, path: str | None = None) -> str:
        return write_report(self.lines(), path)

    def parse(self) -> DataFrame:
        out = self.parser(read_report_lines(self.spark, self.write()), **self.options)
        return out.select(*self.columns) if self.columns else out


#: Dataset of the catalog -> how its report is rendered from the driver's tables.
RENDERED: dict[str, Callable[[Tables], Rendered]] = {}


def round_trip(dataset: str):
    """A function that renders a report becomes one that writes it and parses it back."""
    def deco(fn: Callable[[Tables], Rendered]) -> Callable[[Tables], DataFrame]:
        RENDERED[dataset] = fn

        @wraps(fn)
        def run(t: Tables) -> DataFrame:
            return fn(t).parse()
        return run
    return deco


def report_catalog(t: Tables) -> DataFrame:
    """dataset, n_rows, n_columns of a mixed folder with every report and a copy of one, found by content."""
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/tillroll-reports/{uuid.uuid4().hex}"
    t = tb.JoinedTables(t.spark, t.sf_dir)
    rendered = {name: fn(t) for name, fn in RENDERED.items()}
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda item: item[1].write(f"{folder}/in-{item[0]}"), enumerate(rendered.values())))
    rendered["menu_avg_sales"].write(f"{folder}/again")
    found = load_catalog(t.spark, folder, {name: r.options for name, r in rendered.items()}).datasets
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
             for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@round_trip("monthly_sales")
def report_monthly_sales(t: Tables) -> Rendered:
    m = tb.monthly_sales(t)
    head = [csv_line([F.concat(F.lit("Branch Name: "), F.col("branch"))], 5), csv_line(["Month", "", "Year", "Total"], 5)]
    line = csv_line([F.col("month"), "", F.col("year"), quoted(F.col("total_sales"))], 5)
    foot = [csv_line(["REP_S_00334", "", "Copyright © 2026 report vendor"], 5)]
    return Rendered(t.spark, m, ["branch"], ["year", "month_num"], line, P.parse_monthly_sales, dict(), head, foot)


@round_trip("branch_revenue")
def report_branch_revenue(t: Tables) -> Rendered:
    head = [csv_line([F.concat(F.lit("Branch Name:  "), F.col("branch"))], 4)]
    line = csv_line(["Total By Branch", quoted(F.col("revenue")), "0.00"], 4)
    return Rendered(t.spark, tb.branch_revenue(t), ["branch"], ["revenue"], line, P.parse_branch_revenue, dict(), head)


@round_trip("sales_by_item")
def report_item_sales(t: Tables) -> Rendered:
    s = (tb.item_sales(t).groupBy("branch", "division", "group", "item")
         .agg(F.sum("qty").alias("qty"),
              money_sum("total_amount").alias("amt")))
    sec = ["branch", "division", "group"]
    head = [csv_line([F.concat(F.lit(label), F.col(c))], 5)
            for label, c in [("Branch: ", "branch"), ("Division: ", "division"), ("Group: ", "group")]]
    head.append(csv_line(["Description", "Barcode", "Qty", "Total Amount"], 5))
    line = csv_line([F.col("item"), "", fixed2(F.col("qty")), quoted(F.col("amt"))], 5)
    foot = [csv_line([F.concat(F.lit("Total by Group: "), F.col("group"))], 5)]
    return Rendered(t.spark, s, sec, ["item"], line, P.parse_item_sales, dict(), head, foot)


@round_trip("delivery_items")
def report_delivery_lines(t: Tables) -> Rendered:
    # a customer is an order
    d = tb._lines_with_part(t).select("branch", "l_orderkey", F.col("p_brand").alias("item"),
                                      F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    # sorted by a number first; sections without a branch begin a file, where no branch line stands above them
    d = d.withColumn("named", F.when(F.col("branch").isNotNull(), F.col("l_orderkey")))
    head = [csv_line([F.concat(F.lit("Branch :"), F.col("branch"))], 5),
            csv_line([F.concat(F.lit("Person_"), F.col("l_orderkey").cast("string"))], 5)]
    line = csv_line(["", fixed2(F.col("qty")), F.col("item"), quoted(F.col("price"))], 5)
    foot = [csv_line(["Total :", "", "", "0.00"], 5)]
    return Rendered(t.spark, d, ["named", "l_orderkey", "branch"], ["item", "qty", "price"], line, P.parse_delivery_lines, dict(), head, foot)


@round_trip("customer_orders")
def report_customer_orders(t: Tables) -> Rendered:
    o = t.orders.select("o_custkey", "o_orderdate", "o_totalprice")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey",
                          F.col("c_mktsegment").alias("branch"))
    per = (o.groupBy("o_custkey")
           .agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"),
                money_sum("o_totalprice")
                .alias("total"), F.count("*").alias("n"))
           .join(c, F.col("o_custkey") == F.col("c_custkey")))
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    # sections of 1024 customer keys, each opening with its branch line, so a
    # branch holding most customers still spreads over many files
    per = per.withColumn("chunk", (F.col("c_custkey") / 1024).cast("long"))
    line = csv_line([F.concat(F.lit("Person_"), F.col("c_custkey").cast("string")),
                     F.col("c_name"), F.concat(F.lit("+"), F.col("c_nationkey")),
                     stamp("first"), stamp("last"), quoted(F.col("total")), F.col("n")], 8)
    head = [csv_line([F.col("branch")], 8)]
    return Rendered(t.spark, per, ["branch", "chunk"], ["c_custkey"], line, P.parse_customer_orders, dict(branches=SEGMENTS), head)


@round_trip("attendance")
def report_attendance(t: Tables) -> Rendered:
    e = t.events.select("user_id", "event_type", "ts", "value")
    # one section per employee, branch and month (a monthly attendance report),
    # each opening with its employee and branch lines
    e = e.withColumn("month", F.date_trunc("month", "ts"))
    uid = F.col("user_id").cast("string")
    head = [csv_line(["", F.concat(F.lit("EMP ID :"), uid, F.lit(".0")), F.format_string("NAME :Person_%04d", "user_id")], 6),
            csv_line(["", F.concat(F.lit("Store "), F.col("event_type"))], 6),
            csv_line(["", F.date_format("month", "dd-MMM-yy"), "From Date: report period"], 6)]
    h = F.floor("value")
    m = F.floor(F.col("value") * 60) % 60
    s = F.floor(F.col("value") * 3600) % 60
    e = e.withColumn("day", F.date_format("ts", "dd-MMM-yy")).withColumn("clock", F.date_format("ts", "HH.mm.ss"))
    day, clock = F.col("day"), F.col("clock")
    line = csv_line([day, "", clock, day, clock, F.concat_ws(".", *map(two_digits, (h, m, s)))], 6)
    foot = [csv_line(["", "", "", "", "Total :", "0:00:00"], 6)]
    return Rendered(t.spark, e, ["user_id", "event_type", "month"], ["ts"], line, P.parse_attendance, dict(branch_markers=("Store ",)),
                    head, foot, ["employee_id", "employee_name", "branch", "date", "punch_in", "work_hours"])


@round_trip("menu_avg_sales")
def report_menu_channels(t: Tables) -> Rendered:
    head = [csv_line(["Menu Name", "# Cust", "Sales", "Avg Customer"], 5), csv_line([F.col("branch")], 5)]
    line = csv_line([F.col("menu_channel"), fixed2(F.col("num_customers")),
                     fixed2(F.col("sales")), fixed2(F.col("avg_per_customer"))], 5)
    foot = [csv_line(["Total By Branch:", "0.00", "0.00", "0.00"], 5)]
    return Rendered(t.spark, tb.menu_channels(t), ["branch"], ["menu_channel"], line, P.parse_menu_channels,
                    dict(branches=SEGMENTS, channels=PRIORITIES), head, foot)


@round_trip("division_summary")
def report_division_summary(t: Tables) -> Rendered:
    """Channel sales per (branch, category); branches A-F in the wide layout, others compact.

    Channels: DELIVERY = returned lines (R), TABLE = accepted (A), TAKE AWAY = open (N).
    """
    # exact decimals, so that sums of the sums equal sums of the lines
    amt = F.col("amount")
    s = (tb._lines_with_part(t).groupBy("branch", "p_type", "l_returnflag").agg(F.sum(money("l_extendedprice")).alias("amount"))
         .groupBy("branch", F.concat(F.initcap("p_type"), F.lit(" Delivery")).alias("category"))
         .agg(*[F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, amt)), F.lit(0))
                .cast("double").alias(n)
                for f, n in [("R", "delivery"), ("A", "dine_in"), ("N", "takeaway")]],
              F.sum(amt).cast("double").alias("total")))
    wide = F.col("branch") < "G"
    num = [fixed2(F.col(c)) for c in ["delivery", "dine_in", "takeaway", "total"]]
    line = F.when(wide, csv_line(["", F.col("category"), "", num[0], num[1], "", num[2],
                                  num[3]], 11)).otherwise(
        csv_line(["", F.col("category"), *num], 6))
    head = [csv_line(["Summary By Division"], 11), csv_line([F.col("branch")], 11),
            F.when(wide, csv_line(["", "", "", "DELIVERY", "TABLE", "", "TAKE AWAY", "TOTAL"], 11))
            .otherwise(csv_line(["", "", "DELIVERY", "TABLE", "TAKE AWAY", "TOTAL"], 6))]
    foot = [csv_line(["", "TOTAL", "0.00", "0.00", "0.00", "0.00"], 6)]
    return Rendered(t.spark, s, ["branch"], ["category"], line, P.parse_division_summary, dict(branches=SEGMENTS), head, foot)
