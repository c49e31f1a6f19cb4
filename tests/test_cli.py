"""Command line over report folders: hand-made ones everywhere, the shipped one where present."""
import json
import os
import shutil

import pytest

from conftest import REFERENCE_DATA, fixture_path
from tillroll.sources.parsers import REPORT_FILES

shipped = pytest.mark.skipif(not os.path.isdir(REFERENCE_DATA), reason="reference report files not present")


def json_rows(folder):
    return [json.loads(x) for f in sorted(os.listdir(folder)) if f.endswith(".json") for x in open(os.path.join(folder, f))]


@pytest.fixture()
def reports(tmp_path):
    folder = tmp_path / "reports"
    folder.mkdir()
    for dataset, file in {"monthly_sales": "monthly.csv", "delivery_items": "delivery.csv", "sales_by_item": "item_sales.csv"}.items():
        shutil.copy(fixture_path(file), folder / REPORT_FILES[dataset][0])
    return str(folder)


def test_run_writes_the_analyses_of_the_reports_present(spark, tmp_path, reports, capsys):
    from tillroll.__main__ import main
    assert main(["run", reports, str(tmp_path / "out")]) == 0
    written = set(os.listdir(tmp_path / "out"))
    assert {"demand_forecast", "demand_ranking", "combo_top", "segment_share", "growth_actions"} <= written
    assert not {"shift_staffing", "branch_kpis"} & written                     # their reports are missing
    assert "attendance" in capsys.readouterr().err
    ranking = json_rows(tmp_path / "out" / "demand_ranking")
    # Alpha sells 1,000, 2,000.50 and 3,000: the line goes on with 4,000.17, 5,000.17 and 6,000.17
    assert ranking[0]["branch"] == "Alpha" and ranking[0]["avg_forecast"] == pytest.approx(5000.17, abs=0.01)
    best = json_rows(tmp_path / "out" / "top_items_by_qty")
    assert [r["item"] for r in sorted(best, key=lambda r: -r["qty"])][:1] == ["ICED LATTE"]


def test_ingest_writes_what_was_parsed(spark, tmp_path, reports):
    from tillroll.__main__ import main
    assert main(["ingest", reports, str(tmp_path / "out")]) == 0
    assert set(os.listdir(tmp_path / "out")) == {"monthly_sales", "delivery_items", "sales_by_item"}
    assert spark.read.parquet(str(tmp_path / "out" / "sales_by_item")).count() == 5
    assert spark.read.parquet(str(tmp_path / "out" / "delivery_items")).count() == 6


@shipped
def test_run_writes_available_analyses(spark, tmp_path):
    from tillroll.__main__ import main
    assert main(["run", REFERENCE_DATA, str(tmp_path)]) == 0
    written = sorted(os.listdir(tmp_path))
    assert "shift_staffing" in written and "branch_kpis" in written
    assert "segment_share" not in written          # its report is not shipped
    assert json_rows(tmp_path / "staffing_kpis") == [{"n_slots": 7, "total_recommended": 15, "n_at_risk": 7}]


@shipped
def test_ingest_writes_parsed_datasets(spark, tmp_path):
    from tillroll.__main__ import main
    assert main(["ingest", REFERENCE_DATA, str(tmp_path)]) == 0
    written = sorted(os.listdir(tmp_path))
    assert {"monthly_sales", "attendance", "division_summary"} <= set(written)
    assert "sales_by_item" not in written                 # its report is not shipped
    assert spark.read.parquet(str(tmp_path / "monthly_sales")).count() == 19
    assert spark.read.parquet(str(tmp_path / "attendance")).count() == 311
