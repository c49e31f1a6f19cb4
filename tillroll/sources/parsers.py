"""Parsers for the eight report layouts (S7-S15) and the catalog loader (S16).

Each parser takes the line frame of ``read_report_lines`` and returns a typed
DataFrame.  A row is classified by an ordered ``when`` chain mirroring the
layout's rules; hierarchy rows emit their value into a context column that
is forward-filled (skew-safe, see ``reports.forward_fill_blocked``); detail
rows are then kept and projected.  Everything is a native expression.

Deliberate corrections (documented in README): the year of a month row is
its first 4-digit cell; attendance page-header rows (one time cell or none)
are not records; missing punch hours bucket as Unknown; division-summary
numbers are compacted, so the wide and compact layouts agree, and its page
header test compares whole cells so a "Delivery Service" category survives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.functions.scalar import clean_number, decimal_text, duration_hours, numbers_of, strip
from tillroll.sources.reports import (ORDER, drop_boilerplate, forward_fill_blocked, has_keyword, joined_text,
                                      read_report_lines, split_cells, strip_label, with_values)


def _rows(lines: DataFrame, footer: bool = True) -> DataFrame:
    df = split_cells(lines)
    if footer:
        df = drop_boilerplate(df, line="line")
    # what several conditions look at is a column of its own, so that it is made once a row; an empty row is
    # neither context nor detail of any layout, and a filter of them would make all values twice
    return with_values(df, empty=True).withColumn("low", F.lower(joined_text("cells")))


def _details(df: DataFrame, context: Sequence[str], detail: Column, **columns: Column) -> DataFrame:
    """The rows where ``detail`` holds: ``columns``, and the ``context`` of the rows above them.

    Columns are taken from the cells before the fill, which sorts and carries no cells.
    """
    rows = df.withColumn("_detail", F.coalesce(detail, F.lit(False)))
    rows = rows.select("place", *ORDER, *context, "_detail", *[F.when(F.col("_detail"), c).alias(n) for n, c in columns.items()])
    return forward_fill_blocked(rows, context, group="place", keep="_detail")


def _rest(vals: str = "vals") -> Column:
    """vals[1:]"""
    return F.slice(F.col(vals), 2, F.greatest(F.size(vals) - 1, F.lit(0)))


def _last(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def _nth(arr: Column, i: int) -> Column:
    return F.get(arr, i)


def _month_number(name: Column) -> Column:
    m = F.create_map(*[x for i, n in enumerate(K.MONTH_NAMES, 1)
                       for x in (F.lit(n.lower()), F.lit(i))])
    return m[F.lower(name)]


# --- S7 monthly sales ----------------------------------------------------------
def parse_monthly_sales(lines: DataFrame) -> DataFrame:
    """branch, month, year, total_sales, month_num."""
    df = _rows(lines)
    first = F.col("first")
    kind = (F.when(first.startswith("Branch Name"), "branch")
            .when(has_keyword("cells", K.MONTHLY_HEADERS, "low"), "skip")
            .otherwise("detail"))
    df = (df.withColumn("kind", kind)
            .withColumn("branch", F.when(F.col("kind") == "branch",
                                         strip_label(first, "Branch Name:"))))
    rest = _rest()
    year_pos = F.array_position(F.transform(rest, lambda x: x.rlike(r"^\d{4}$")), True)
    sales = _last(F.filter(
        F.transform(rest, lambda x, i: F.when(i + 1 != year_pos, clean_number(x))),
        lambda x: x > 0))
    month_ok = F.lower(first).isin([m.lower() for m in K.MONTH_NAMES])
    detail = ((F.col("kind") == "detail") & (F.size("vals") >= 2)
              & ~(first.contains("Total") | first.contains("Grand") | first.contains("REP_"))
              & month_ok)
    out = (_details(df, ["branch"], detail, month=first, total_sales=sales,
                    year=F.when(year_pos > 0, F.get(rest, year_pos - 1).try_cast("int")))
           .filter(F.col("branch").isNotNull() & (F.col("year") != 0) & F.col("total_sales").isNotNull())
           .select("branch", "month", "year", "total_sales"))
    return out.withColumn("month_num", _month_number(F.col("month")))


# --- S8 branch revenue ---------------------------------------------------------
def parse_branch_revenue(lines: DataFrame) -> DataFrame:
    """branch, revenue (second cell of each ``Total By Branch`` row)."""
    df = _rows(lines, footer=False)
    first = F.col("first")
    df = (df.withColumn("kind", F.when(first.contains("Branch Name"), "branch")
                        .when(first == "Total By Branch", "total"))
            .withColumn("branch", F.when(F.col("kind") == "branch",
                                         strip_label(first, "Branch Name:"))))
    revenue = F.when(F.size("vals") > 1, clean_number(_nth(F.col("vals"), 1)))
    return (_details(df, ["branch"], F.col("kind") == "total", revenue=revenue)
            .filter(F.col("branch").isNotNull()).select("branch", "revenue"))


# --- S9 item sales -------------------------------------------------------------
def parse_item_sales(lines: DataFrame) -> DataFrame:
    """branch, division, group, item, qty, total_amount."""
    df = _rows(lines)
    first = F.col("first")
    skip_cond = F.lit(False)
    for k in K.ITEM_HEADERS:
        skip_cond = skip_cond | first.startswith(k)
    kind = (F.when(first.startswith("Branch:"), "branch")
            .when(first.startswith("Division:"), "division")
            .when(first.startswith("Group:"), "group")
            .when(skip_cond, "skip").otherwise("detail"))
    df = df.withColumn("kind", kind)
    for name, label in [("branch", "Branch:"), ("division", "Division:"), ("group", "Group:")]:
        df = df.withColumn(name, F.when(F.col("kind") == name,
                                        strip(F.replace(first, F.lit(label), F.lit("")))))
    df = df.withColumn("nums", F.when(F.col("kind") == "detail", numbers_of(_rest())))
    nums = F.col("nums")
    detail = ((F.size("vals") >= 3) & ~(first.contains("Total") | first.contains("REP_")) & (F.size(nums) >= 1))
    return (_details(df, ["branch", "division", "group"], detail, item=first, qty=F.get(nums, 0),
                     total_amount=F.when(F.size(nums) >= 2, _last(nums)).otherwise(F.lit(0.0)))
            .filter(F.col("branch").isNotNull() & F.col("group").isNotNull())
            .select("branch", "division", "group", "item", "qty", "total_amount"))


# --- S10 delivery lines --------------------------------------------------------
def parse_delivery_lines(lines: DataFrame) -> DataFrame:
    """branch, customer, item, qty, price."""
    df = _rows(lines)
    first = F.col("first")
    kind = (F.when(first.startswith("Branch :"), "branch")
            .when(first.startswith("Person_") & first.rlike(r"^Person_\d+$"), "customer")
            .when(first.isin("Full Name", "Total :") | has_keyword("cells", K.DELIVERY_HEADERS, "low"), "skip")
            .otherwise("detail"))
    df = (df.withColumn("kind", kind)
            .withColumn("branch", F.when(F.col("kind") == "branch",
                                         strip(F.replace(first, F.lit("Branch :"), F.lit("")))))
            .withColumn("customer", F.when(F.col("kind") == "customer", first)))
    desc = F.get(F.col("vals"), 1)                      # values are stripped
    df = df.withColumn("qty", F.when(F.col("kind") == "detail", decimal_text(first)))
    detail = (F.col("qty").isNotNull() & (F.size("vals") >= 3) & (desc != "") & ~desc.startswith("Total"))
    return (_details(df, ["branch", "customer"], detail, item=desc, qty=F.col("qty"),
                     price=clean_number(_last(F.col("vals"))))
            .filter(F.col("branch").isNotNull() & F.col("customer").isNotNull())
            .select("branch", "customer", "item", "qty", "price"))


# --- S11 customer orders -------------------------------------------------------
def parse_customer_orders(lines: DataFrame,
                          branches: Sequence[str] = K.BRANCH_NAMES) -> DataFrame:
    """branch, customer, first_order, last_order, total, num_orders."""
    df = _rows(lines)
    first = F.col("first")
    kind = (F.when(has_keyword("cells", K.CUSTOMER_HEADERS, "low"), "skip")
            .when(first.isin(list(branches)), "branch")
            .otherwise("detail"))
    df = (df.withColumn("kind", kind)
            .withColumn("branch", F.when(F.col("kind") == "branch", first)))
    vals = F.col("vals")
    dates = F.filter(vals, lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}"))
    # wall-clock timestamps (no time zone), as the report prints them
    first_order = F.try_to_timestamp(F.get(dates, 0)).cast("timestamp_ntz")
    n_orders = decimal_text(_last(vals)).try_cast("int")
    last_order = (F.when(F.size(dates) > 1, F.try_to_timestamp(F.get(dates, 1)).cast("timestamp_ntz"))
                  .otherwise(first_order))
    detail = ((F.col("kind") == "detail") & first.rlike(r"^Person_\d+$")
              & (F.size("vals") >= 5) & n_orders.isNotNull())
    return (_details(df, ["branch"], detail, customer=first, first_order=first_order, last_order=last_order,
                     total=clean_number(F.try_element_at(vals, F.lit(-2))), num_orders=n_orders)
            .filter(F.col("branch").isNotNull())
            .select("branch", "customer", "first_order", "last_order", "total", "num_orders"))


# --- S12 attendance ------------------------------------------------------------
def parse_attendance(lines: DataFrame, branch_markers: Sequence[str] = K.ATTENDANCE_BRANCH_MARKERS
                     ) -> DataFrame:
    """employee_id, employee_name, branch, date, punch_in, punch_out, work_hours."""
    df = _rows(lines, footer=False)
    first, vals = F.col("first"), F.col("vals")
    marker = F.lit(False)
    for b in branch_markers:
        marker = marker | first.contains(b)
    kind = (F.when(first.contains("EMP ID"), "employee")
            .when(marker & ~first.rlike(r"^\d{2}-"), "branch")
            .when(first.rlike(r"^\d{2}-\w{3}-\d{2}"), "day"))
    emp_id = (F.regexp_extract(first, r"EMP ID\s*:\s*([\d.]+)", 1)
              .try_cast("double").try_cast("int"))        # digits and dots only
    name_cell = F.get(F.filter(vals, lambda x: x.contains("NAME")), 0)
    name = F.regexp_extract(name_cell, r"NAME\s*:\s*(Person_\d+)", 1)
    df = (df.withColumn("kind", kind)
            .withColumn("employee_id", F.when(F.col("kind") == "employee", emp_id))
            .withColumn("employee_name", F.when((F.col("kind") == "employee") & (name != ""),
                                                name))
            .withColumn("branch", F.when(F.col("kind") == "branch", strip(first)))
            .withColumn("times", F.when(F.col("kind") == "day", F.filter(vals, lambda x: x.rlike(r"^\d{2}[.:]\d{2}[.:]\d{2}"))))
            .withColumn("hours", F.when(F.size("times") >= 2, duration_hours(_last(vals)))))
    times, hours = F.col("times"), F.col("hours")
    detail = ((F.col("kind") == "day") & (F.size(times) >= 2) & hours.isNotNull()
              & ~F.exists(vals, lambda x: F.coalesce(x.contains("Total"), F.lit(False))))
    return (_details(df, ["employee_id", "employee_name", "branch"], detail,
                     date=F.to_date(F.try_to_timestamp(first, F.lit("dd-MMM-yy"))),
                     punch_in=F.get(times, 0), punch_out=F.get(times, 1), work_hours=hours)
            .select("employee_id", "employee_name", "branch", "date", "punch_in", "punch_out", "work_hours"))


# --- S14 menu channels ---------------------------------------------------------
def parse_menu_channels(lines: DataFrame, branches: Sequence[str] = K.BRANCH_NAMES,
                        channels: Sequence[str] = K.MENU_CHANNELS) -> DataFrame:
    """branch, menu_channel, num_customers, sales, avg_per_customer."""
    df = _rows(lines)
    first = F.col("first")
    kind = (F.when(has_keyword("cells", K.MENU_HEADERS, "low"), "skip")
            .when(first.isin(list(branches)), "branch")
            .when(first.isin(list(channels)), "channel"))
    df = (df.withColumn("kind", kind)
            .withColumn("branch", F.when(F.col("kind") == "branch", first)))
    nums = numbers_of(_rest())
    detail = (F.col("kind") == "channel") & (F.size("vals") >= 4) & (F.size(nums) >= 3)
    return (_details(df, ["branch"], detail, menu_channel=first, num_customers=F.get(nums, 0),
                     sales=F.get(nums, 1), avg_per_customer=F.get(nums, 2))
            .filter(F.col("branch").isNotNull())
            .select("branch", "menu_channel", "num_customers", "sales", "avg_per_customer"))


# --- S15 division summary ------------------------------------------------------
def parse_division_summary(lines: DataFrame, branches: Sequence[str] = K.BRANCH_NAMES
                           ) -> DataFrame:
    """branch, category, delivery, table, takeaway, total.

    Works on raw cell positions: branch in cell 0, category in cell 1, then
    the non-empty numbers (the wide layout's spacer cells are skipped).
    """
    df = _rows(lines)
    cells = F.col("cells")
    c0 = strip(F.get(cells, 0))
    header = (F.exists(cells, lambda x: F.coalesce(F.upper(strip(x)).isin(K.DIVISION_COLUMNS), F.lit(False)))
              | has_keyword("cells", K.DIVISION_HEADERS, "low"))
    df = (df.withColumn("branch", F.when(c0.isin(list(branches)), c0))
            .withColumn("is_header", header))
    cat = strip(F.get(cells, 1))
    bad_cond = F.lit(False)
    for b in K.DIVISION_NO_CATEGORY:
        bad_cond = bad_cond | cat.contains(b)
    nums = numbers_of(F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0))))
    detail = (~F.col("is_header") & (F.size(cells) >= 6) & cat.isNotNull() & (cat != "") & ~bad_cond
              & (F.size(nums) >= 3))
    total = (F.when(F.size(nums) > 3, F.get(nums, 3))
             .otherwise(F.get(nums, 0) + F.get(nums, 1) + F.get(nums, 2)))
    return (_details(df, ["branch"], detail, category=cat, delivery=F.get(nums, 0), table=F.get(nums, 1),
                     takeaway=F.get(nums, 2), total=total)
            .filter(F.col("branch").isNotNull())
            .select("branch", "category", "delivery", "table", "takeaway", "total"))


# --- declared schemas of the parsed datasets ------------------------------------------
SCHEMAS = {
    "monthly_sales": [("branch", "string"), ("month", "string"), ("year", "int"),
                      ("total_sales", "double"), ("month_num", "int")],
    "branch_revenue": [("branch", "string"), ("revenue", "double")],
    "sales_by_item": [("branch", "string"), ("division", "string"), ("group", "string"),
                      ("item", "string"), ("qty", "double"), ("total_amount", "double")],
    "delivery_items": [("branch", "string"), ("customer", "string"), ("item", "string"),
                       ("qty", "double"), ("price", "double")],
    "customer_orders": [("branch", "string"), ("customer", "string"),
                        ("first_order", "timestamp_ntz"), ("last_order", "timestamp_ntz"),
                        ("total", "double"), ("num_orders", "int")],
    "attendance": [("employee_id", "int"), ("employee_name", "string"), ("branch", "string"),
                   ("date", "date"), ("punch_in", "string"), ("punch_out", "string"),
                   ("work_hours", "double")],
    "menu_avg_sales": [("branch", "string"), ("menu_channel", "string"),
                       ("num_customers", "double"), ("sales", "double"),
                       ("avg_per_customer", "double")],
    "division_summary": [("branch", "string"), ("category", "string"), ("delivery", "double"),
                         ("table", "double"), ("takeaway", "double"), ("total", "double")],
}


# --- S16 catalog -------------------------------------------------------------------
# fixed values: report file names per dataset
REPORT_FILES = {
    "monthly_sales": ("rep_s_00334_1_SMRY.csv", parse_monthly_sales),
    "branch_revenue": ("REP_S_00194_SMRY.csv", parse_branch_revenue),
    "sales_by_item": ("rep_s_00191_SMRY.csv", parse_item_sales),
    "delivery_items": ("REP_S_00502.csv", parse_delivery_lines),
    "customer_orders": ("rep_s_00150.csv", parse_customer_orders),
    "attendance": ("REP_S_00461.csv", parse_attendance),
    "menu_avg_sales": ("rep_s_00435_SMRY.csv", parse_menu_channels),
    "division_summary": ("REP_S_00136_SMRY.csv", parse_division_summary),
}


def load_reports(spark: SparkSession, folder: str,
                 datasets: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Lazily parsed DataFrame per dataset whose report file exists in ``folder``.

    Files are selected by exact name (a glob would also pick up duplicate
    copies such as ``name (1).csv``).
    """
    from pyspark.errors import AnalysisException

    out = {}
    for name, (fname, parser) in REPORT_FILES.items():
        if datasets is not None and name not in datasets:
            continue
        path = f"{folder.rstrip('/')}/{fname}"
        try:
            lines = read_report_lines(spark, path)      # lists the file: fails if absent
        except AnalysisException as ex:
            if ex.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out[name] = parser(lines)
    return out


def dataset_profile(datasets: dict[str, DataFrame]) -> DataFrame:
    """dataset, n_rows, n_columns, columns — one row per dataset (S17)."""
    parts = [df.agg(F.count("*").alias("n_rows"))
             .select(F.lit(name).alias("dataset"), "n_rows",
                     F.lit(len(df.columns)).alias("n_columns"),
                     F.lit(", ".join(df.columns)).alias("columns"))
             for name, df in datasets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
