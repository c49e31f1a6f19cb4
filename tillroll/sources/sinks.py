"""Result sinks (S18): analyses written as JSON lines or parquet, one folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object per row (e.g. for an API response), built natively."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(column))


def write_result(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Write a result DataFrame (overwrite), ``json`` lines or ``parquet``."""
    writer = df.write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path
