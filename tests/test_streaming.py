"""Incremental report ingestion equals batch parsing, file by file."""
import shutil

from conftest import fixture_path, rows
from tillroll.sources import parsers as P
from tillroll.sources.reports import read_report_lines
from tillroll.streaming.reports import read_ingested, start_report_ingestion


def test_stream_ingests_new_files_once(spark, tmp_path):
    src, sink, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    src.mkdir()
    shutil.copy(fixture_path("monthly.csv"), src / "a.csv")
    q = start_report_ingestion(spark, str(src), P.parse_monthly_sales, str(sink), str(ckpt))
    q.awaitTermination(120)
    first = read_ingested(spark, str(sink))
    want = P.parse_monthly_sales(read_report_lines(spark, fixture_path("monthly.csv")))
    cols = ["branch", "month", "year", "total_sales", "month_num"]
    assert rows(first, *cols) == rows(want, *cols)

    # a second file arrives: only it is parsed by the next run
    text = open(fixture_path("monthly.csv")).read().replace("Alpha", "Gamma")
    (src / "b.csv").write_text(text)
    q = start_report_ingestion(spark, str(src), P.parse_monthly_sales, str(sink), str(ckpt))
    q.awaitTermination(120)
    both = read_ingested(spark, str(sink))
    assert both.select("batch").distinct().count() == 2
    assert both.count() == 2 * want.count()
    assert both.filter("branch = 'Gamma'").count() == want.filter("branch = 'Alpha'").count()


def test_continuous_trigger(spark, tmp_path):
    src, sink, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    src.mkdir()
    q = start_report_ingestion(spark, str(src), P.parse_monthly_sales, str(sink), str(ckpt),
                               available_now=False, processing_time="1 second")
    try:
        shutil.copy(fixture_path("monthly.csv"), src / "a.csv")
        q.processAllAvailable()
        assert read_ingested(spark, str(sink)).count() == 5
    finally:
        q.stop()
