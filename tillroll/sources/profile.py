"""Column profile of Parquet tables from their footers (S17).

Row counts, null counts and the least and greatest values of a column stand in the
footers of Parquet files.  Spark answers such aggregates from there when the
table is read by its second data source interface with aggregate push-down on; no
data page is read.  Both are options of a session, so the reads run in a sibling
session that shares the caller's cluster and leaves the caller's options alone.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types whose least and greatest value are given: footers hold prefixes of texts only.
ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that reads Parquet with aggregate push-down."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def table_profile(spark: SparkSession, own: SparkSession, name: str, path: str) -> DataFrame:
    """dataset, column, type, n_rows, n_nulls, least, greatest of each column that is not nested; one aggregate over footers.

    Writers leave the bounds out where a column holds NaN, or nothing but nulls in a row group; Spark then refuses
    to answer from the footers, and the table's plain columns are read.  A first look at the footers tells.
    """
    df = own.read.parquet(path)
    columns = [f for f in df.schema.fields if not isinstance(f.dataType, NESTED)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(columns):
        aggs.append(F.count(F.col(f"`{f.name}`")).alias(f"c{i}"))
        if isinstance(f.dataType, ORDERED):
            aggs += [F.min(F.col(f"`{f.name}`")).alias(f"a{i}"), F.max(F.col(f"`{f.name}`")).alias(f"b{i}")]
    # footers write a least value of 0 as -0
    bound = lambda c, f: F.col(c).cast("double") + 0.0 if isinstance(f.dataType, ORDERED) else F.lit(None).cast("double")     # noqa: E731
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n_rows"),
                     (F.col("n") - F.col(f"c{i}")).alias("n_nulls"), bound(f"a{i}", f).alias("least"), bound(f"b{i}", f).alias("greatest"))
            for i, f in enumerate(columns)]
    totals = df.agg(*aggs)
    try:
        totals.collect()
    except (Py4JJavaError, PySparkException):
        totals = spark.read.parquet(path).agg(*aggs)
    return totals.select(F.explode(F.array(*rows)).alias("r")).select(F.lit(name).alias("dataset"), "r.*")


def column_profile(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``table_profile`` of every table (name -> path)."""
    own = footer_session(spark)
    out = None
    for name, path in paths.items():
        part = table_profile(spark, own, name, path)
        out = part if out is None else out.unionByName(part)
    return out
