"""Report parsers on own fixture texts (edge cases of each layout)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import fixture_path, rows, srt
from tillroll.sources import parsers as P
from tillroll.sources.reports import forward_fill, forward_fill_blocked, read_report_lines


def lines(spark, name):
    return read_report_lines(spark, fixture_path(name))


def test_item_sales(spark):
    df = P.parse_item_sales(lines(spark, "item_sales.csv"))
    assert rows(df) == srt([
        ("North Cafe", "Drinks", "Hot", "Iced Latte", 2.0, 12000.5),
        ("North Cafe", "Drinks", "Hot", "Cappuccino Large", 4001.0, 1500.0),
        ("South Cafe", "Drinks", "Hot", "Vanilla Milkshake", 5.0, 2500.0),
        ("South Cafe", "Drinks", "Hot", "Chimney Classic", 0.0, 1000.0),
        ("South Cafe", "Drinks", "Hot", "Frappe Mocha", 1.0, 700.0),
    ])


def test_delivery_lines(spark):
    df = P.parse_delivery_lines(lines(spark, "delivery.csv"))
    assert rows(df) == srt([
        ("North Cafe", "Person_0001", "Iced Latte", 2.0, 1000.0),
        ("North Cafe", "Person_0001", "DELIVERY CHARGE", 1.0, 50.0),
        ("North Cafe", "Person_0001", "Free Dip", 1.0, 0.0),
        ("North Cafe", "Person_0001", "Chimney Classic", 1.0, 2000.0),
        ("North Cafe", "Person_0002", "iced latte", 1.0, 1000.0),
        ("North Cafe", "Person_0002", "Cappuccino", 3.0, 0.0),
    ])


def test_customer_orders(spark):
    df = P.parse_customer_orders(lines(spark, "customer_orders.csv"),
                                 branches=["North Cafe", "South Cafe"])
    T = dt.datetime
    assert rows(df) == srt([
        ("North Cafe", "Person_0001", T(2025, 8, 1, 10), T(2025, 12, 1, 9, 30), 12500.0, 7),
        ("North Cafe", "Person_0002", T(2025, 9, 15, 12), T(2025, 9, 15, 12), 800.0, 1),
        ("South Cafe", "Person_0004", T(2025, 11, 11, 11, 11, 11), T(2025, 12, 12, 12, 12, 12),
         0.0, 3),
    ])


def test_attendance(spark):
    df = P.parse_attendance(lines(spark, "attendance.csv"),
                            branch_markers=("Cafe",))
    got = rows(df, "employee_id", "employee_name", "branch", "date", "punch_in", "punch_out")
    D = dt.date
    assert got == srt([
        (1, "Person_0001", "Harbor Cafe", D(2025, 12, 1), "07.39.35", "19.37.56"),
        (1, "Person_0001", "Harbor Cafe", D(2025, 12, 2), "15.14.59", "00.51.33"),
        (1, "Person_0001", "Harbor Cafe", D(2025, 12, 3), "09.00.00", "09.00.00"),
        (1, "Person_0001", "Harbor Cafe", D(2025, 12, 4), "23.10.00", "07.20.00"),
        (2, "Person_0002", "Hill Cafe", D(2025, 12, 5), "13.00.00", "21.30.00"),
    ])
    hours = dict(((r.date.day), r.work_hours) for r in df.collect())
    assert hours[1] == pytest.approx(11 + 58 / 60 + 21 / 3600)
    assert hours[3] == 0.0
    assert hours[4] == pytest.approx(8 + 10 / 60)


def test_monthly_sales(spark):
    df = P.parse_monthly_sales(lines(spark, "monthly.csv"))
    assert rows(df, "branch", "month", "year", "total_sales", "month_num") == srt([
        ("Alpha", "August", 2025, 1000.0, 8),
        ("Alpha", "September", 2025, 2000.5, 9),
        ("Alpha", "october", 2025, 3000.0, 10),
        ("Beta", "December", 2025, 1234.0, 12),
        ("Beta", "January", 2026, 2026.0, 1),
    ])


def test_division_summary(spark):
    df = P.parse_division_summary(lines(spark, "division.csv"), branches=["Harbor Cafe", "Hill Cafe"])
    assert rows(df) == srt([
        ("Harbor Cafe", "Bev Add-ons", 0.0, 100.0, 0.0, 100.0),
        ("Harbor Cafe", "Delivery Service", 5.0, 10.0, 0.0, 15.0),
        ("Harbor Cafe", "free dip", 0.0, 7.0, 3.0, 9.0),
        ("Hill Cafe", "Shakes", 1.0, 2.0, 3.0, 6.0),
        ("Hill Cafe", "coffee type", 1.0, 0.0, 2.0, 3.0),
    ])


def test_blocked_fill_equals_single_window(spark):
    """Small splits (many blocks per file) give the same result as one window per file."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "96")
    try:
        ln = lines(spark, "attendance.csv")
        assert ln.select("block").distinct().count() > 3
        df = ln.withColumn("ctx", F.when(F.col("line").contains("EMP ID"), F.col("line")))
        a = forward_fill_blocked(df, ["ctx"])
        b = forward_fill(df, ["ctx"], ["file"], ["block", "seq"])
        assert rows(a, "line", "ctx") == rows(b, "line", "ctx")
        got = P.parse_attendance(lines(spark, "attendance.csv"),
                                 branch_markers=("Cafe",))
        assert got.count() == 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_catalog_and_profile(spark, tmp_path):
    import shutil
    shutil.copy(fixture_path("monthly.csv"), tmp_path / "rep_s_00334_1_SMRY.csv")
    shutil.copy(fixture_path("monthly.csv"), tmp_path / "rep_s_00334_1_SMRY (1).csv")
    cat = P.load_reports(spark, str(tmp_path))
    assert list(cat) == ["monthly_sales"]
    prof = P.dataset_profile(cat).collect()
    assert prof[0]["n_rows"] == 5 and prof[0]["n_columns"] == 5


@pytest.mark.parametrize("dataset,fixture,kw", [
    ("monthly_sales", "monthly.csv", {}),
    ("sales_by_item", "item_sales.csv", {}),
    ("delivery_items", "delivery.csv", {}),
    ("customer_orders", "customer_orders.csv", {"branches": ["North Cafe", "South Cafe"]}),
    ("attendance", "attendance.csv", {"branch_markers": ("Cafe",)}),
    ("division_summary", "division.csv", {"branches": ["Harbor Cafe", "Hill Cafe"]}),
    ("branch_revenue", "monthly.csv", {}),
    ("menu_avg_sales", "monthly.csv", {}),
])
def test_declared_schemas(spark, dataset, fixture, kw):
    parser = P.REPORT_FILES[dataset][1]
    assert parser(lines(spark, fixture), **kw).dtypes == P.SCHEMAS[dataset]


def test_byte_order_mark_and_crlf(spark, tmp_path):
    text = open(fixture_path("monthly.csv")).read().replace("North Cafe", "Branch Name: Zeta", 1)
    path = tmp_path / "bom.csv"
    path.write_bytes(("﻿" + text).replace("\n", "\r\n").encode("utf-8"))
    df = P.parse_monthly_sales(read_report_lines(spark, str(path)))
    # the first line now names a branch, so the early August row is kept under it
    assert ("Zeta", "August", 2025, 100.0, 8) in rows(df)
    assert len(rows(df)) == 6


def test_parsed_rows_are_sorted_once(spark):
    """Filled rows are written: what follows reads them, and no window sorts the cells again."""
    plan = P.parse_delivery_lines(lines(spark, "delivery.csv"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "raw" not in plan
