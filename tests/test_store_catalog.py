"""Result store, catalog by content and bins kept as a table."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import fixture_path
from tillroll.operators.bins import assign_bins
from tillroll.sources import parsers as P
from tillroll.sources.catalog import load_catalog
from tillroll.sources.reports import read_report_lines
from tillroll.sources.store import AuditError, ResultStore


# --- store ---------------------------------------------------------------------------------------
@pytest.fixture()
def store(spark, tmp_path):
    return ResultStore(spark, str(tmp_path / "store"))


def frames(spark, n):
    return {"a": spark.range(n).withColumn("s", F.array(F.struct(F.lit("x").alias("t")))), "b": spark.range(0).withColumn("d", F.lit(1.5))}


def test_all_reports_of_a_version_are_published_together(spark, store):
    assert store.versions() == [] and store.manifest() is None and store.catalog().count() == 0
    store.publish(frames(spark, 4), "2025-01")
    store.publish(frames(spark, 7), "2025-02")
    assert store.versions() == ["2025-01", "2025-02"]
    assert store.read("a").count() == 7 and store.read("a", "2025-01").count() == 4
    assert store.read("b").dtypes == [("id", "bigint"), ("d", "double")]
    assert sorted(map(tuple, store.catalog().collect())) == [("a", 7, 2, "id, s"), ("b", 0, 2, "d, id")]
    with pytest.raises(KeyError):
        store.read("c")
    with pytest.raises(ValueError):
        store.publish({}, "x")
    with pytest.raises(ValueError):
        store.publish(frames(spark, 1), "../x")


def test_a_rerun_replaces_its_own_version(spark, store, tmp_path):
    store.publish(frames(spark, 4), "v")
    store.publish(frames(spark, 9), "v")
    assert store.versions() == ["v"] and store.read("a").count() == 9
    assert len(list((tmp_path / "store" / "staging").iterdir())) == 1


def test_a_run_that_dies_between_write_and_publish_changes_nothing(spark, store, tmp_path, monkeypatch):
    store.publish(frames(spark, 4), "v")

    def killed(self, manifest):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(ResultStore, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            store.publish(frames(spark, 9), "v")
    assert store.read("a").count() == 4
    assert len(list((tmp_path / "store" / "staging").iterdir())) == 2
    assert len(store.sweep()) == 1 and store.sweep() == [] and store.read("a").count() == 4
    store.publish(frames(spark, 9), "v")
    assert store.read("a").count() == 9


def test_an_audit_that_fails_publishes_nothing(spark, store, monkeypatch):
    with pytest.raises(AuditError, match="check failed"):
        store.publish(frames(spark, 4), "v", {"b": lambda df: df.count() > 0})
    stage = ResultStore._stage

    def loses_rows(self, report, df, folder):
        return {**stage(self, report, df, folder), "rows": 5}
    with monkeypatch.context() as m:
        m.setattr(ResultStore, "_stage", loses_rows)
        with pytest.raises(AuditError, match="in place of 5"):
            store.publish(frames(spark, 4), "v")
    assert store.versions() == []


# --- catalog --------------------------------------------------------------------------------------
FIXTURE_OF = {"monthly_sales": "monthly.csv", "sales_by_item": "item_sales.csv", "delivery_items": "delivery.csv",
              "customer_orders": "customer_orders.csv", "attendance": "attendance.csv", "division_summary": "division.csv"}


def test_catalog_finds_layouts_by_content(spark, tmp_path):
    names = {}
    for i, (dataset, file) in enumerate(FIXTURE_OF.items()):
        names[dataset] = f"{chr(97 + i)}{i}.txt"
        (tmp_path / names[dataset]).write_bytes(open(fixture_path(file), "rb").read())
    (tmp_path / "below").mkdir()
    lines = open(fixture_path("monthly.csv")).read().splitlines()
    (tmp_path / "below" / "copy.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "below" / "other.csv").write_text("id,name\n1,x\n")
    found = load_catalog(spark, str(tmp_path))
    files = {r.file.rsplit("/", 1)[1]: r for r in found.files.collect()}
    assert {d: files[n].dataset for d, n in names.items()} == {d: d for d in names}
    assert files["other.csv"].dataset is None and files["other.csv"].copy_of is None and files["other.csv"].lines == 2
    copies = [r for r in (files["copy.csv"], files[names["monthly_sales"]]) if r.copy_of]
    assert len(copies) == 1 and copies[0].copy_of != copies[0].file
    assert set(found.datasets) == set(names)
    for dataset, file in FIXTURE_OF.items():
        want = P.REPORT_FILES[dataset][1](read_report_lines(spark, fixture_path(file)))
        assert sorted(map(repr, found.datasets[dataset].collect())) == sorted(map(repr, want.collect())), dataset


def test_catalog_of_no_known_report(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n")
    found = load_catalog(spark, str(tmp_path))
    assert found.datasets == {} and found.files.count() == 1


# --- bins -----------------------------------------------------------------------------------------
def test_bins_against_a_loop(spark):
    r = random.Random(5)
    day = date(2025, 1, 20)
    rows = [(i, r.choice(["x", "y", None]), day + timedelta(days=r.randrange(60)) if r.random() < 0.95 else None,
             r.choice([*range(24), None])) for i in range(300)]
    table = [(None, None, None, 6, 14, "morning", 1), (None, None, None, 22, 6, "night", 1), ("x", day + timedelta(days=10), day + timedelta(days=40), 5, 9, "rush", 3),
             ("x", None, None, 8, 10, "late rush", 2), (None, day + timedelta(days=30), None, 14, 14, "whole day", 9), ("y", None, day, 0, 12, "first day", 1),
             ("y", None, day, 0, 12, "a first day", 1), ("z", None, None, 0, 24, "no such branch", 0)]
    df = spark.createDataFrame(rows, "id int, branch string, date date, punch_hour int")
    bins = spark.createDataFrame(table, "branch string, valid_from date, valid_to date, from_hour int, to_hour int, label string, rank int")
    got = {x.id: x.bin for x in assign_bins(df, bins, ["id"]).collect()}
    for i, branch, when, hour in rows:
        fits = [(b is None, rank, label) for b, f, t, h0, h1, label, rank in table
                if when is not None and hour is not None and (b is None or b == branch) and (f is None or f <= when) and (t is None or when <= t)
                and (h0 <= hour < h1 if h0 < h1 else hour >= h0 or hour < h1)]
        assert got[i] == (min(fits)[2] if fits else "Unknown"), (branch, when, hour)


def test_bins_are_joined_by_equality(spark):
    from tillroll.plans.registry import QUERIES
    plan = QUERIES["shift_bins"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_catalog_parsers_read_their_own_files(spark, tmp_path, monkeypatch):
    """Each layout's parser gets the lines of its files only, cut from their text, whatever else lies in the folder."""
    from tillroll.sources import catalog as C
    (tmp_path / "a [1].csv").write_bytes(open(fixture_path("monthly.csv"), "rb").read())
    (tmp_path / "b c.csv").write_bytes(open(fixture_path("delivery.csv"), "rb").read())
    (tmp_path / "copy.csv").write_bytes(open(fixture_path("delivery.csv"), "rb").read())
    scanned = []
    read = C.read_report_lines

    def watched(*args, **kw):
        lines = read(*args, **kw)
        scanned.append({(r.file.rsplit("/", 1)[1], r.n) for r in lines.groupBy("file").agg(F.count("*").alias("n")).collect()})
        staged = [r.file for r in spark.read.parquet(*lines.inputFiles()).select("file").distinct().collect()]
        assert len(staged) == 1
        return lines
    monkeypatch.setattr(C, "read_report_lines", watched)
    found = load_catalog(spark, str(tmp_path))
    assert set(found.datasets) == {"monthly_sales", "delivery_items"} and len(scanned) == 2 and all(len(s) == 1 for s in scanned)
    for dataset, file in (("monthly_sales", "monthly.csv"), ("delivery_items", "delivery.csv")):
        want = P.REPORT_FILES[dataset][1](read_report_lines(spark, fixture_path(file)))
        assert sorted(map(repr, found.datasets[dataset].collect())) == sorted(map(repr, want.collect()))


def test_catalog_of_records_with_line_breaks(spark, tmp_path):
    """Records are counted and compared, not physical lines; the first records lie behind blank lines and many others."""
    head = "\n" * 3000 + "Branch :,Harbor,,,\n" + '"note, of\ntwo lines",,,,\n' * 30 + "Total :,,,0.00,\n"
    (tmp_path / "a.csv").write_text(head + "x,1\n" * 2500)
    (tmp_path / "b.csv").write_text("Branch :,Harbor,,,\n" + "x,1\n" * 2500 + "Total :,,,0.00,\n" + '"note, of\ntwo lines",,,,\n' * 30)
    (tmp_path / "c.csv").write_text("y,2\n" * 60 + "Branch :,Harbor,,,\n")
    files = {r.file.rsplit("/", 1)[1]: r for r in load_catalog(spark, str(tmp_path)).files.collect()}
    assert [files[f"{x}.csv"].lines for x in "abc"] == [2532, 2532, 61]
    assert files["a.csv"].dataset == files["b.csv"].dataset == "delivery_items" and files["c.csv"].dataset is None
    assert files["b.csv"].copy_of.endswith("/a.csv") and files["a.csv"].copy_of is None


# --- rendered reports -------------------------------------------------------------------------------
def test_rendered_sections_are_made_in_one_pass(spark):
    """The lines of a section stay together and in order, also of a null branch and an order that comes twice; rows are joined once."""
    from tillroll.plans import roundtrip as RT
    rows = spark.createDataFrame([("b", 1, "y", 2.0), (None, 1, "x", 1.5), ("b", 1, "x", 1.0), ("b", 1, "x", 1.0), ("a", 2, None, 1234.0)],
                                 "branch string, k long, item string, qty double")
    head, foot = [RT.csv_line([F.concat(F.lit("Branch :"), F.col("branch"))], 3)], [RT.csv_line(["Total :"], 2)]
    r = RT.Rendered(spark, rows, ["branch", "k"], ["item", "qty"], RT.csv_line([F.col("item"), RT.fixed2(F.col("qty"))], 3), None, {}, head, foot)
    text = [x.text for x in r.lines().coalesce(1).collect()]
    b = text.index("Branch :b,,")
    assert text[b:b + 5] == ["Branch :b,,", "x,1.00,", "x,1.00,", "y,2.00,", "Total :,"]
    assert sorted(text[:b] + text[b + 5:]) == sorted([",,", "x,1.50,", "Total :,", "Branch :a,,", ",1234.00,", "Total :,"])
    plan = r.lines()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("x", [0.0, -0.0, 1.0, -3.0, 12.345, 0.005, 1e14, 1e15, 123456789.0, float("nan"), float("inf"), None])
def test_numbers_print_as_the_formatter_prints_them(spark, x):
    from tillroll.plans import roundtrip as RT
    df = spark.createDataFrame([(x,)], "x double").withColumn("n", F.floor("x"))
    got = df.select(RT.fixed2(F.col("x")), F.format_string("%.2f", "x"), RT.two_digits(F.col("n")), F.format_string("%02d", "n")).first()
    assert got[0] == got[1] and got[2] == got[3]


def test_reports_of_the_catalog_share_one_join(spark):
    from conftest import SF, rows
    from tillroll.plans import roundtrip as RT
    from tillroll.sources import tables as tb
    t = tb.JoinedTables(spark, SF)
    for name in ("delivery_items", "sales_by_item", "division_summary"):
        shared = RT.RENDERED[name](t).lines()
        plan = shared._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "l_partkey" not in plan
        assert rows(shared) == rows(RT.RENDERED[name](tb.Tables(spark, SF)).lines())


def test_deliveries_without_a_branch_go_to_no_other_branch(spark):
    from tillroll.plans import roundtrip as RT
    from tillroll.sources import tables as tb

    class Joined(tb.JoinedTables):
        def __init__(self, lines):
            self.spark, self.lines_with_part = spark, lines
    data = [([None, "b", "c"][k % 3], k, "n", "x", "t", 2.0, 5.0, "R") for k in range(300)]
    lines = spark.createDataFrame(data, "branch string, l_orderkey long, p_name string, p_brand string, p_type string, "
                                        "l_quantity double, l_extendedprice double, l_returnflag string")
    got = {(r.branch, r.customer) for r in RT.RENDERED["delivery_items"](Joined(lines)).parse().collect()}
    assert got == {(b, f"Person_{k}") for b, k, *_ in data if b}
