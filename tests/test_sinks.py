"""Result sinks."""


def test_json_rows_sink(spark, tmp_path):
    from tillroll.sources.sinks import json_rows, write_result
    df = spark.createDataFrame([("a", 1.5, None)], "branch string, x double, y string")
    assert [r["json"] for r in json_rows(df).collect()] == ['{"branch":"a","x":1.5}']
    path = write_result(df, str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(path).count() == 1
