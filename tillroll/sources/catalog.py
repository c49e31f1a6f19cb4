"""Catalog of a mixed report folder by content (S16): names and formats of files do not matter.

All files are looked at in one scan of their text.  The first records of a file tell its
layout; files that hold the same lines as another one are copies and dropped; each parser
cuts and reads the files of its own layout and no others.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.session import write_table
from tillroll.sources.parsers import REPORT_FILES
from tillroll.sources.reports import ORDER, ends_inside, may_end_inside, read_report_lines, read_text_lines

#: Records at the start of a file that are looked at.
HEAD = 40
#: Lines whose places differ in their last bits only are one chunk.
CHUNK_BITS = 10

# fixed values: what the first records of each layout hold, as patterns over a line
SIGNATURES = {
    "monthly_sales": [r"^Monthly Sales\b", r"^Month,,Year,Total\b"],
    "branch_revenue": [r"^Tax Report\b", r"^Total By Branch,"],
    "sales_by_item": [r"^Division: ", r"^Group: ", r"^Description,Barcode,"],
    "delivery_items": [r"^Branch :", r"^Total :,"],
    "customer_orders": [r"^[^,]+,.*\d{4}-\d\d-\d\d \d\d:\d\d.*,\d{4}-\d\d-\d\d \d\d:\d\d"],
    "attendance": [r"Time & Attendance", r"\bEMP ID :", r",PUNCH IN,"],
    "menu_avg_sales": [r"^Average Sales By Menu\b", r"^Menu Name,# Cust"],
    "division_summary": [r"^Summary By Division\b", r",DELIVERY,TABLE,"],
}


@dataclass
class Catalog:
    """``files``: file, dataset (null: no layout, or several), copy_of (null: not a copy), lines; ``datasets``: parsed frames by name."""

    files: DataFrame
    datasets: dict[str, DataFrame]


def line_chunks(lines: DataFrame) -> DataFrame:
    """file, block, chunk, lines, size, prints, open (some line may end inside a quoted cell) of each run of lines: all
    that is taken from whole files, in one scan.

    Prints are sums over the lines: they merge map-side and do not depend on how a file is split.
    The halves of a hash are added apart: sums over a chunk fit a long.
    """
    prints = {"p": F.xxhash64("line"), "q": F.xxhash64(F.lit(1), "line")}
    halves = [F.sum(half).alias(f"{name}{i}") for name, h in prints.items() for i, half in enumerate((F.shiftright(h, 32), h.bitwiseAND(0xFFFFFFFF)))]
    return lines.groupBy("file", "block", F.shiftright("seq", CHUNK_BITS).alias("chunk")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("size"), F.max(may_end_inside(F.col("line"))).alias("open"), *halves)


def file_layouts(lines: DataFrame, chunks: DataFrame, signatures: dict[str, Sequence[str]] = SIGNATURES, head: int = HEAD) -> DataFrame:
    """file, dataset: the layout most of whose patterns the file's first records show; null for none and for ties."""
    # the first split holds a file's first lines, so the windows are bounded by a split; the chunks tell
    # where the first records end, and only lines up to there are sorted
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("chunk")) - F.col("lines")
    ends = (chunks.where("block = 0").select("file", "chunk", before.alias("before")).where(F.col("before") < head)
            .groupBy("file").agg(F.max("chunk").alias("last")))
    ends = write_table(ends, "report-heads")             # its size lets the join choose a broadcast
    w = Window.partitionBy("file").orderBy(*ORDER)
    first = (lines.where("block = 0").join(ends, "file").where(F.shiftright("seq", CHUNK_BITS) <= F.col("last"))
             .select("file", *ORDER, "line").withColumn("i", F.row_number().over(w)).where(F.col("i") <= head))
    seen = {name: [F.max(F.col("line").rlike(p).cast("int")) for p in patterns] for name, patterns in signatures.items()}
    score = [F.struct(sum(hits[1:], hits[0]).alias("score"), F.lit(name).alias("name")) for name, hits in seen.items()]
    best = F.sort_array(F.array(*score), asc=False)
    found, second = F.col("best")[0], F.col("best")[1]
    clear = (found["score"] > 0) & (found["score"] > second["score"])
    return first.groupBy("file").agg(best.alias("best")).select("file", F.when(clear, found["name"]).alias("dataset"))


def file_copies(chunks: DataFrame) -> DataFrame:
    """file, lines, copy_of: the smallest name of the files with the same lines, null for that file itself."""
    prints = ["p0", "p1", "q0", "q1"]
    whole = chunks.groupBy("file").agg(*[F.sum(c).alias(c) for c in ("lines", "size")],
                                       *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in prints])
    first = F.min("file").over(Window.partitionBy("lines", "size", *prints))
    return whole.withColumn("first", first).select("file", "lines", F.when(F.col("first") != F.col("file"), F.col("first")).alias("copy_of"))


def load_catalog(spark: SparkSession, paths: str | Sequence[str], options: dict[str, dict] | None = None) -> Catalog:
    """Every report below ``paths`` (folders of any depth, or files), by content.

    ``options`` are keyword arguments of a dataset's parser.  Files of unknown layout are listed and not parsed;
    a file with the same lines as another one, in whatever order, is its copy.
    """
    lines = read_text_lines(spark, paths, recursive=True)
    chunks = write_table(line_chunks(lines), "report-chunks")
    if chunks.where("open").limit(1).count() and lines.where(ends_inside(F.col("line"))).limit(1).count():
        lines = read_report_lines(spark, paths, recursive=True)
        chunks = write_table(line_chunks(lines), "report-chunks")
    files = write_table(file_copies(chunks).join(file_layouts(lines, chunks), "file", "left").select("file", "dataset", "copy_of", "lines"), "report-files")
    # names of files reach the driver, which has listed them anyway
    own = files.where(F.col("dataset").isNotNull()).select("dataset", F.when(F.col("copy_of").isNull(), F.col("file")).alias("file")).distinct().collect()

    def parsed(name: str) -> DataFrame:
        mine = read_report_lines(spark, paths, recursive=True, files=[r.file for r in own if r.dataset == name and r.file])
        return REPORT_FILES[name][1](mine, **(options or {}).get(name, {}))

    names = [name for name in REPORT_FILES if name in {r.dataset for r in own}]
    with ThreadPoolExecutor(4) as pool:                  # small reports do not wait for large ones
        return Catalog(files, dict(zip(names, pool.map(parsed, names))))
