"""Generic reading of paginated, hierarchical report files (S1-S6).

Reports are headerless CSV text where line order carries meaning: hierarchy
lines ("Branch Name: X") apply to the detail lines below them, page headers
and footers are interleaved with data.

Scale design
------------
* Files are read **line by line** with the splittable text source, never as
  whole-file strings, so a report file of any size is spread over many tasks.
* The physical order of a line is ``(file, block, seq)``: ``block`` is the
  start offset of the file split that read it (``_metadata.file_block_start``)
  and ``seq`` a ``monotonically_increasing_id`` taken straight after the scan,
  increasing within a split.  Re-running a lost task re-reads the same split
  and produces the same ids.
* The text is scanned and cut into cells **once**; the lines with their cells are
  written as a table, and everything after reads its columns.  A line without quotes,
  or with one quoted cell, is cut without patterns.
* A quoted cell may hold line breaks.  Whether a line begins inside such a cell
  depends on all lines before it: each line is a function from the state at its
  start to the state at its end, the functions of a split compose into one, and
  a table of one row per split carries the state across splits
  (``whole_records``).  Files without an open quote skip this.
* Hierarchy context is forward-filled in two phases: inside each split (a
  window bounded by the split size), then the last value of every split is
  carried into the following splits through a small one-row-per-split table.
  No window ever spans a whole file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions import constants as K
from tillroll.functions.scalar import col_, compact_cells, contains_any, strip
from tillroll.session import write_table

ORDER = ["block", "seq"]


def _physical_lines(spark: SparkSession, paths: str | Sequence[str], recursive: bool, files: Sequence[str] | None) -> DataFrame:
    """file, block, seq, line of the text."""
    df = spark.read.text([paths] if isinstance(paths, str) else list(paths), recursiveFileLookup=recursive)
    if files is not None:
        df = df.where(F.col("_metadata.file_path").isin(list(files)))            # other files are not opened
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def read_report_lines(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False,
                      files: Sequence[str] | None = None) -> DataFrame:
    """file, block, seq, line, raw, vals - one row per non-blank record, with its cells.

    A quoted cell may hold line breaks: such physical lines are one record, at
    the place of the first.  ``recursive`` takes files of folders below as well,
    ``files`` only those of these names (as ``file`` has them).
    """
    return report_records(_physical_lines(spark, paths, recursive, files))


def read_text_lines(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """file, block, seq, line - one row per non-blank physical line, straight from the text.

    These are the records where no quoted cell spans lines, that is where no line ``ends_inside`` one.
    """
    return _without_mark(_physical_lines(spark, paths, recursive, None)).filter(F.trim(F.col("line")) != "")


def _without_mark(lines: DataFrame) -> DataFrame:
    # a byte-order mark would hide the first line's label
    marked = F.col("line").startswith("\ufeff")
    return lines.withColumn("line", F.when(marked, F.substring("line", 2, 1 << 30)).otherwise(F.col("line")))


def report_records(lines: DataFrame) -> DataFrame:
    """Records of physical lines (file, block, seq, line): cut once, written, joined where a quoted cell spans lines.

    ``seq`` is unique over all lines and increases within a split.
    """
    staged = write_table(_with_cells(_without_mark(lines)), "report-lines")
    if staged.where("opens").limit(1).count():
        staged = whole_records(staged)
    return staged.filter(F.trim(F.col("line")) != "").select("file", *ORDER, "line", "n_fields", "raw").withColumn("vals", _values(F.col("line"), F.col("raw")))


# --- quotes ---------------------------------------------------------------------------------
# States between the pieces that quotes cut a line into.  A quote opens a cell only at the
# cell's start; elsewhere it is text.  LITERAL is added once a quote was text, or text followed
# a closing quote: such lines need more than every second piece.
CLOSED, INSIDE, LITERAL, TEXT, START = 0, 2, 4, 5, 8


def _pieces(line: Column) -> Column:
    """The text between quotes; NULL for a line without any."""
    return F.when(line.contains('"'), F.split(line, '"', -1))


def _after_quote(state: Column, piece: Column) -> Column:
    """The state behind the quote that follows ``piece``."""
    inside = (state == INSIDE) | (state == INSIDE + LITERAL)
    begins, ends, plain = piece.startswith(","), piece.endswith(","), state < LITERAL
    at_cell = ((state == START) | (state == CLOSED) | (state == CLOSED + LITERAL))
    return (F.when(inside, state - INSIDE)
            .when(ends & ((state == START) | (begins & plain)), F.lit(INSIDE))
            .when(ends, F.lit(INSIDE + LITERAL))
            .when((piece == "") & at_cell, F.when(state == CLOSED + LITERAL, INSIDE + LITERAL).otherwise(INSIDE))
            .otherwise(F.lit(TEXT)))


def _end_state(pieces: Column, start: int) -> Column:
    """The state before a line's last piece; NULL for a line without quotes."""
    return F.when(pieces.isNotNull(), F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.lit(start), _after_quote))


def _is_inside(state: Column) -> Column:
    return F.coalesce((state == INSIDE) | (state == INSIDE + LITERAL), F.lit(False))


def may_end_inside(line: Column) -> Column:
    """True for every line that ends inside a quoted cell, and few others: its last quote follows a comma, a quote or nothing."""
    before = F.substring(line, F.lit(1), F.length(line) - F.length(F.substring_index(line, '"', -1)) - 1)
    return line.contains('"') & ((before == "") | before.endswith(",") | before.endswith('"'))


def ends_inside(line: Column) -> Column:
    """Whether a line ends inside a quoted cell."""
    return may_end_inside(line) & _is_inside(_end_state(_pieces(line), START))


def _is_odd(pieces: Column, state: Column) -> Column:
    """Whether some quote of the line is text, or text follows a closing quote."""
    last = F.element_at(pieces, -1)
    return F.coalesce((state >= LITERAL) | ((state == CLOSED) & (last != "") & ~last.startswith(",")), F.lit(False))


# stands for a comma outside quotes while a line is split; no report holds it
CELL_END = "\x00"
# stands for a comma inside quotes while a line that does not hold it is split
INNER_COMMA = "\x01"


def _regular_cells(pieces: Column) -> Column:
    """Cells of a line whose quotes all open, close or escape: the pieces alternate outside and inside."""
    marked = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(","), F.lit(CELL_END))).otherwise(x))

    def unquote(x: Column) -> Column:
        inner = F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        return (F.when(x == "", F.lit(None).cast("string"))
                .when((F.length(x) >= 2) & x.startswith('"') & x.endswith('"'), inner)
                .otherwise(x))
    return F.transform(F.split(F.array_join(marked, '"'), CELL_END, -1), unquote)


def _odd_cells(pieces: Column) -> Column:
    """Cells of any line with quotes: opening and closing quotes go, escaped and other ones are text."""
    outside = lambda x: F.replace(x, F.lit(","), F.lit(CELL_END))                     # noqa: E731

    def step(acc: Column, piece: Column) -> Column:
        state = acc["state"]
        after = _after_quote(state, piece)
        escaped = (piece == "") & ((state == CLOSED) | (state == CLOSED + LITERAL))
        text = F.when(_is_inside(state), piece).otherwise(outside(piece))
        quote = F.when(escaped | (after == TEXT), F.lit('"')).otherwise(F.lit(""))
        return F.struct(after.alias("state"), F.concat(acc["text"], text, quote).alias("text"))

    start = F.struct(F.lit(START).alias("state"), F.lit("").alias("text"))
    last = F.element_at(pieces, -1)
    done = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step,
                       lambda acc: F.concat(acc["text"], F.when(_is_inside(acc["state"]), last).otherwise(outside(last))))
    return F.transform(F.split(done, CELL_END, -1), lambda x: F.nullif(x, F.lit("")))


# a line all of whose quoted cells close before a comma or its end, in one look; longer lines take the
# way by pieces, as a match goes one call deeper with every cell
CELL = r'"[^"]*+(?:""[^"]*+)*+"|[^",]*+'
CLOSED_LINE, CELLS, LONGEST = rf"^(?:{CELL})(?:,(?:{CELL}))*+\z", rf"(?<=^|,)({CELL})", 512


def _is_closed(line: Column) -> Column:
    """Whether a short line's quotes all open, close or escape, and every quoted cell ends in it."""
    return ~line.contains('"') | ((F.length(line) <= LONGEST) & line.rlike(CLOSED_LINE))


def _closed_cells(line: Column) -> Column:
    inner = lambda x: F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))        # noqa: E731
    return F.transform(F.regexp_extract_all(line, F.lit(CELLS), 1),
                       lambda x: F.when(x.startswith('"'), inner(x)).otherwise(F.nullif(x, F.lit(""))))


def _one_quoted(line: Column, pieces: Column) -> Column:
    """Whether a line has one quoted cell, which is not empty, between commas or the line's ends."""
    before, inner, after = (F.get(pieces, i) for i in range(3))
    return ((F.size(pieces) == 3) & ((before == "") | before.endswith(",")) & ((after == "") | after.startswith(","))
            & (inner != "") & ~line.contains(INNER_COMMA))


def _one_quoted_cells(pieces: Column) -> Column:
    before, inner, after = (F.get(pieces, i) for i in range(3))
    text = F.concat(before, F.replace(inner, F.lit(","), F.lit(INNER_COMMA)), after)
    return F.transform(F.split(text, ",", -1), lambda x: F.nullif(F.replace(x, F.lit(INNER_COMMA), F.lit(",")), F.lit("")))


def _cells(line: Column, pieces: Column, odd: Column) -> Column:
    """Cells of a line; ``pieces`` are NULL where ``_is_closed``."""
    plain = F.transform(F.split(line, ",", -1), lambda x: F.nullif(x, F.lit("")))
    closed = F.when(line.contains('"'), _closed_cells(line)).otherwise(plain)
    return F.when(pieces.isNull(), closed).when(odd, _odd_cells(pieces)).otherwise(_regular_cells(pieces))


def _values(line: Column, raw: Column) -> Column:
    """``compact_cells`` of a line's cells; where no cell can begin or end with a blank, only the empty ones go."""
    tidy = ~line.rlike(r"[^ -~]") & ~line.startswith(" ") & ~line.endswith(" ")
    for beside in (" ,", ", ", ' "', '" ', '""'):
        tidy = tidy & ~line.contains(beside)
    return F.when(tidy, F.filter(raw, lambda x: x.isNotNull())).otherwise(compact_cells(raw))


def csv_split(line: str | Column) -> Column:
    """Split one CSV text line into cells (quotes removed, ``""`` unescaped, '' -> NULL).

    A quote that does not stand at a cell's start is text, and so is what follows a closing quote.
    """
    pieces = F.when(~_is_closed(col_(line)), _pieces(col_(line)))
    return _cells(col_(line), pieces, _is_odd(pieces, _end_state(pieces, START)))


def _with_cells(lines: DataFrame) -> DataFrame:
    """``lines`` plus ``opens`` (ends inside a quoted cell), ``raw`` and their number, step by step so that nothing is cut twice."""
    line, cut, simple, state, pieces = (F.col(c) for c in ("line", "_cut", "_simple", "_state", "_pieces"))
    return (lines.withColumn("_cut", _pieces(line))
            .withColumn("_simple", F.coalesce(_one_quoted(line, cut), F.lit(False)))
            .withColumn("_pieces", F.when(cut.isNotNull() & ~simple & ~_is_closed(line), cut))
            .withColumn("_state", _end_state(pieces, START))
            .withColumn("opens", _is_inside(state))
            .withColumn("raw", F.when(simple, _one_quoted_cells(cut)).otherwise(_cells(line, pieces, _is_odd(pieces, state))))
            .withColumn("n_fields", F.size("raw"))
            .drop("_cut", "_simple", "_pieces", "_state"))


def whole_records(staged: DataFrame) -> DataFrame:
    """Lines (with ``opens``, ``raw``, ``n_fields``) whose quoted cells span lines become one record, in files that have such lines.

    State 1 is inside a quoted cell.  Each line maps the state before it to the state after
    it; within a split both outcomes are followed at once, across splits one row per split is
    composed.  A cell that is never closed opens nothing: its lines stay as they are.
    """
    files = staged.where("opens").select("file").distinct()
    clean = staged.join(files, "file", "left_anti")
    pieces = _pieces(F.col("line"))
    out0 = F.col("opens").cast("int")
    out1 = F.when(pieces.isNull(), F.lit(1)).otherwise(_is_inside(_end_state(pieces, INSIDE)).cast("int"))
    in_split = Window.partitionBy("file", "block").orderBy("seq")
    to_here = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = staged.join(files, "file", "left_semi").withColumn("_0", out0).withColumn("_1", out1)
    # the last line with one outcome sets the state, lines that turn it around since then flip it
    d = d.withColumn("_flips", F.sum(((F.col("_0") == 1) & (F.col("_1") == 0)).cast("int")).over(to_here))
    d = d.withColumn("_set", F.last(F.when(F.col("_0") == F.col("_1"), (F.col("_0") + F.col("_flips")) % 2), ignorenulls=True).over(to_here))
    for s in (0, 1):
        d = d.withColumn(f"_after{s}", (F.coalesce("_set", F.lit(s)) + F.col("_flips")) % 2)
    for s in (0, 1):
        d = d.withColumn(f"_before{s}", F.lag(f"_after{s}", 1, s).over(in_split))
    for s in (0, 1):
        d = d.withColumn(f"_head{s}", F.last(F.when(F.col(f"_before{s}") == 0, F.col("seq")), ignorenulls=True).over(to_here))
    d = write_table(d.drop("_0", "_1", "_flips", "_set"), "report-states")

    ends = d.groupBy("file", "block").agg(F.max_by(F.struct("_after0", "_after1", "_head0", "_head1"), F.col("seq")).alias("end")).select("file", "block", "end.*")
    by_file = Window.partitionBy("file").orderBy("block")
    so_far = by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same, flips = F.col("_after0") == F.col("_after1"), (F.col("_after0") == 1) & (F.col("_after1") == 0)
    ends = ends.withColumn("_flips", F.sum(flips.cast("int")).over(so_far))
    ends = ends.withColumn("_set", F.last(F.when(same, (F.col("_after0") + F.col("_flips")) % 2), ignorenulls=True).over(so_far))
    ends = ends.withColumn("_end", (F.coalesce("_set", F.lit(0)) + F.col("_flips")) % 2)
    ends = ends.withColumn("_begin", F.lag("_end", 1, 0).over(by_file))
    own = F.when(F.col("_begin") == 0, F.col("_head0")).otherwise(F.col("_head1"))
    ends = ends.withColumn("_head", F.when(own.isNotNull(), F.struct("block", own.alias("seq"))))
    ends = ends.withColumn("_carried", F.last("_head", ignorenulls=True).over(so_far))
    whole = by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.withColumn("_open", F.last(F.when(F.col("_end") == 1, F.col("_carried"))).over(whole))
    starts = ends.select("file", "block", "_begin", F.lag("_carried").over(by_file).alias("_earlier"), "_open")

    d = d.join(starts, ["file", "block"])
    chosen = lambda c: F.when(F.col("_begin") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))        # noqa: E731
    head = F.when(chosen("_head").isNotNull(), F.struct("block", chosen("_head").alias("seq"))).otherwise(F.col("_earlier"))
    part = ((chosen("_before") == 1) | (chosen("_after") == 1)) & ~F.coalesce(head == F.col("_open"), F.lit(False))
    d = d.select("file", *ORDER, "line", "raw", "n_fields", head.alias("_at"), part.alias("_part"))
    joined = (d.where("_part").groupBy("file", "_at")
              .agg(F.sort_array(F.collect_list(F.struct(*ORDER, "line"))).alias("lines"))
              .select("file", "_at.block", "_at.seq", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("line")))
    keep = ["file", *ORDER, "line", "raw", "n_fields"]
    return clean.select(keep).unionByName(d.where("not _part").select(keep)).unionByName(_with_cells(joined).select(keep))


def split_cells(lines: DataFrame) -> DataFrame:
    """Each line's ``cells`` (array<string>, NULL = empty cell) and ``vals``, and its file's ``place``.

    The width of a file is the field count of its first line; longer lines
    are dropped, shorter ones padded with NULL.  ``place``, the least ``seq`` of a
    file, is a number that stands for its name.
    """
    df = lines
    if "raw" not in df.columns:
        df = _with_cells(lines).withColumn("vals", _values(F.col("line"), F.col("raw")))
    # two levels of plain numbers, which are hashed; written, as its size lets the join choose a broadcast
    first = (df.groupBy("file", "block").agg(F.min_by("n_fields", "seq").alias("n_fields"), F.min("seq").alias("place"))
             .groupBy("file").agg(F.min_by("n_fields", "block").alias("width"), F.min("place").alias("place")))
    first = write_table(first, "report-widths")
    pad = F.array_repeat(F.lit(None).cast("string"),
                         F.greatest(F.col("width") - F.col("n_fields"), F.lit(0)).cast("int"))
    cells = F.when(F.col("n_fields") == F.col("width"), F.col("raw")).otherwise(F.concat("raw", pad))
    return (df.join(first, "file")
            .filter(F.col("n_fields") <= F.col("width"))
            .select("file", "place", "block", "seq", "line", cells.alias("cells"),
                    "vals"))


def csv_cells(line: str | Column, n_cells: int) -> Column:
    """Parse one CSV text line into exactly ``n_cells`` strings (NULL = empty)."""
    pad = F.array_repeat(F.lit(None).cast("string"), F.lit(n_cells))
    return F.slice(F.concat(csv_split(line), pad), 1, n_cells)


def joined_text(cells: str | Column) -> Column:
    """Cells joined by single spaces, empty cells skipped (for keyword tests)."""
    return F.array_join(col_(cells), " ")


def has_keyword(cells: str | Column, keywords: Sequence[str], low: str | Column | None = None) -> Column:
    """True when the joined row text contains any keyword, case-insensitively.

    ``low`` is that text in lower case, where it is a column already.
    """
    return contains_any(F.lower(joined_text(cells)) if low is None else col_(low), [kw.lower() for kw in keywords])


def is_footer(cells: str | Column, pattern: str = K.FOOTER_PATTERN) -> Column:
    """True when any cell matches the copyright / page footer pattern."""
    return F.exists(col_(cells), lambda x: F.coalesce(x.rlike(pattern), F.lit(False)))


def drop_boilerplate(df: DataFrame, cells: str = "cells",
                     header_keywords: Sequence[str] | None = None,
                     footer: bool = True, line: str | None = None) -> DataFrame:
    """Drop footer rows and (optionally) rows containing page-header keywords.

    With ``line`` (the raw CSV text) the footer pattern is tested once on the
    line instead of on every cell: the pattern never spans a comma and
    unquoting a cell cannot create a match, so both tests agree.
    """
    cond = F.lit(False)
    if footer and line:
        low = F.lower(F.col(line))
        cond = cond | F.coalesce(contains_any(low, K.FOOTER_WORDS) & F.col(line).rlike(K.FOOTER_PATTERN), F.lit(False))
    elif footer:
        cond = cond | is_footer(cells)
    if header_keywords:
        cond = cond | has_keyword(cells, header_keywords)
    return df.filter(~cond)


def with_values(df: DataFrame, empty: bool = False) -> DataFrame:
    """Add ``vals`` (stripped non-empty cells, unless present) and ``first``; drop empty rows, unless ``empty``."""
    if "vals" not in df.columns:
        df = df.withColumn("vals", compact_cells("cells"))
    if not empty:
        df = df.filter(F.size("vals") > 0)
    return df.withColumn("first", F.get(F.col("vals"), 0))


def forward_fill(df: DataFrame, columns: Sequence[str], partition: Sequence[str],
                 order: Sequence[str]) -> DataFrame:
    """Replace each NULL in ``columns`` by the last non-NULL value before it."""
    w = (Window.partitionBy(*partition).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df
    for c in columns:
        out = out.withColumn(c, F.last(c, ignorenulls=True).over(w))
    return out


def forward_fill_blocked(df: DataFrame, columns: Sequence[str], group: str = "file",
                         block: str = "block", seq: str = "seq", span: int | None = None, keep: str | None = None) -> DataFrame:
    """Skew-safe forward fill over ``(group, block, seq)`` order.

    ``block`` must be non-decreasing along the order (contiguous chunks);
    ``seq`` orders rows inside a block and may be any orderable column
    (a struct for compound orders).  Phase 1 fills inside each (group,
    block); phase 2 takes the last non-NULL value of every block, carries it
    forward over the blocks of the group (one row per block) and fills what
    phase 1 left NULL.  A group holding a third of all rows is spread over
    its blocks; no window spans a whole group.  ``span`` (for whole-number
    blocks that grow in number with the data) carries in two levels: within
    ranges of so many blocks, then over the ranges.  ``keep`` names a boolean
    column: only rows where it holds are returned, and others are not written.
    """
    columns = list(columns)
    # the filled value on a block's last row is the block's last non-NULL value; the filled
    # rows are written, so that they are sorted once and the last ones found by a mark
    is_last = F.lead(F.lit(False), 1, True).over(Window.partitionBy(group, block).orderBy(seq)).alias("_last")
    local = forward_fill(df.select("*", is_last), columns, [group, block], [seq])
    local = write_table(local.filter(F.col(keep) | F.col("_last")) if keep else local, "report-filled")
    tails = local.filter("_last").select(group, block, *columns)

    def carried(rows: DataFrame, keys: list[str], at: str, prefix: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"{prefix}{c}") for c in columns])

    if span:
        tails = carried(tails.withColumn("_range", F.floor(F.col(block) / span)), [group, "_range"], block, "_in_")
        ends = (tails.groupBy(group, "_range")
                .agg(*[F.max_by(F.coalesce(F.col(c), F.col(f"_in_{c}")), F.col(block)).alias(c) for c in columns]))
        ends = carried(ends, [group], "_range", "_out_").select(group, "_range", *[f"_out_{c}" for c in columns])
        carry = tails.join(ends, [group, "_range"]).select(
            group, block, *[F.coalesce(f"_in_{c}", f"_out_{c}").alias(f"_carry_{c}") for c in columns])
    else:
        carry = carried(tails, [group], block, "_carry_").select(group, block, *[f"_carry_{c}" for c in columns])
    # written: its size lets the join choose a broadcast
    local = local.filter(keep) if keep else local
    out = local.drop("_last").join(write_table(carry, "report-carry"), [group, block], "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_carry_{c}"))).drop(f"_carry_{c}")
    return out


def strip_label(c: str | Column, label: str) -> Column:
    """``first.replace(label, "").strip().strip(":").strip()``."""
    s = strip(F.replace(col_(c), F.lit(label), F.lit("")))
    return strip(F.regexp_replace(s, r"^:+|:+$", ""))
