"""Native column expressions (JVM-side, whole-stage codegen friendly).

No Python UDFs: every helper returns a ``Column`` built from
``pyspark.sql.functions``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions import constants as K


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters ``str.isspace()`` accepts, for ``strip``.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
              "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: str | Column) -> Column:
    """Strip leading/trailing whitespace the way ``str.strip()`` does (no regex)."""
    return F.trim(col_(c), F.lit(WHITESPACE))


# ten decimals lose nothing of an amount, 28 places before them hold totals of totals at 100 TB
MONEY_TYPE = "decimal(38,10)"


def money(c: str | Column, kind: str = MONEY_TYPE) -> Column:
    """A money amount as an exact DECIMAL."""
    return col_(c).cast(kind)


def money_sum(c: str | Column, kind: str = MONEY_TYPE) -> Column:
    """Exact sum of money amounts, returned as DOUBLE.

    Accumulating in DECIMAL makes the total independent of partitioning and
    aggregation order (a DOUBLE sum is not), so reruns and engines agree.
    """
    return F.sum(money(c, kind)).cast("double")


# what a decimal number as the reports print it is made of; type suffixes, hexadecimal digits,
# inner blanks and digit separators other than the comma are no numbers
NOT_DECIMAL = r"[^0-9eE+.\-]"
INFINITE = r"^[+-]?(?i:inf|infinity)$"
# the usual number, which needs no other look
PLAIN_DECIMAL, PLAIN_GROUPED = r"^-?[0-9]+(?:\.[0-9]+)?\z", r"^-?[0-9][0-9,]*(?:\.[0-9]+)?\z"


def decimal_text(c: str | Column) -> Column:
    """Plain decimal text -> DOUBLE, anything else NULL (blanks around it are allowed).

    One look for a character that no decimal number has; the cast decides the rest.
    """
    s = strip(c)
    return (F.when(col_(c).rlike(PLAIN_DECIMAL), col_(c).try_cast("double"))
            .when(~s.rlike(NOT_DECIMAL) | s.rlike(INFINITE), s.try_cast("double")))


def clean_number(c: str | Column) -> Column:
    """Report number text -> DOUBLE.

    Strip, drop thousands separators and quotes, strip again; ``-`` is 0;
    empty, NaN and any other text is NULL (``5F``, ``12d``, ``0x1p3`` and
    ``1_000`` are units or codes, not numbers).
    """
    s = strip(F.replace(F.replace(strip(c), F.lit(","), F.lit("")), F.lit('"'), F.lit("")))
    return (F.when(col_(c).rlike(PLAIN_GROUPED), F.replace(col_(c), F.lit(","), F.lit("")).try_cast("double"))
            .when(s == "-", F.lit(0.0)).otherwise(decimal_text(s)))


def compact_cells(cells: str | Column) -> Column:
    """Stripped, non-empty cells in their original order."""
    return F.filter(
        F.transform(col_(cells), lambda x: strip(x)),
        lambda x: x.isNotNull() & (x != ""),
    )


def numbers_of(cells: Column) -> Column:
    """Parsed numbers of an array of cells, unparsable cells dropped."""
    return F.filter(F.transform(cells, lambda x: clean_number(x)), lambda x: x.isNotNull())


def duration_hours(c: str | Column) -> Column:
    """``HH.MM.SS`` / ``HH:MM:SS`` (hours may exceed 24) -> decimal hours.

    Anything that does not split into three parts is 0.0; three parts that
    are not integers give NULL.
    """
    parts = F.split(F.replace(col_(c), F.lit("."), F.lit(":")), ":")
    h = F.get(parts, 0).try_cast("bigint")
    m = F.get(parts, 1).try_cast("bigint")
    s = F.get(parts, 2).try_cast("bigint")
    return F.when(F.size(parts) == 3, h + m / 60.0 + s / 3600.0).otherwise(F.lit(0.0))


def punch_hour(c: str | Column) -> Column:
    """Hour of a ``HH.MM.SS`` / ``HH:MM:SS`` punch; NULL when unparsable (or beyond 64 bits)."""
    s = strip(F.regexp_replace(col_(c), r"\.", ":"))
    return F.get(F.split(s, ":"), 0).try_cast("bigint")


def shift_of(hour: str | Column) -> Column:
    """Shift label of a punch hour: [6,14) morning, [14,22) afternoon, else night."""
    h = col_(hour)
    return (
        F.when(h.isNull(), F.lit(K.SHIFT_UNKNOWN))
        .when((h >= K.MORNING_HOURS[0]) & (h < K.MORNING_HOURS[1]), F.lit(K.SHIFT_MORNING))
        .when((h >= K.AFTERNOON_HOURS[0]) & (h < K.AFTERNOON_HOURS[1]), F.lit(K.SHIFT_AFTERNOON))
        .otherwise(F.lit(K.SHIFT_NIGHT))
    )


def shift_of_bins(hour: str | Column, bins: Sequence[tuple[str, int, int]],
                  fallback: str, unknown: str = K.SHIFT_UNKNOWN) -> Column:
    """Shift label from configurable [start, end) hour bins, tried in order.

    A bin with end > 24 wraps past midnight (e.g. ("Night", 22, 30) covers
    22-24 and 0-6); hours in no bin get ``fallback``, NULL gets ``unknown``.
    """
    h = col_(hour)
    out = F.when(h.isNull(), F.lit(unknown))
    for label, start, end in bins:
        cond = (h >= start) & (h < min(end, 24))
        if end > 24:
            cond = cond | (h < end - 24)
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(fallback))


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """True when ``text`` contains any keyword (plain substring)."""
    cond = F.lit(False)
    for kw in keywords:
        cond = cond | text.contains(kw)
    return cond


def count_present(text: Column, keywords: Sequence[str]) -> Column:
    """Number of keywords present in ``text`` as substrings (each counts once)."""
    total = F.lit(0)
    for kw in keywords:
        total = total + F.when(text.contains(kw), 1).otherwise(0)
    return total


def segment_of(item: str | Column,
               milkshake: Sequence[str] = K.MILKSHAKE_KEYWORDS,
               coffee: Sequence[str] = K.COFFEE_KEYWORDS,
               chimney: Sequence[str] = K.CHIMNEY_KEYWORDS) -> Column:
    """Product segment by upper-case substring, milkshake > coffee > chimney."""
    up = F.upper(col_(item))
    return (
        F.when(contains_any(up, milkshake), F.lit("milkshake"))
        .when(contains_any(up, coffee), F.lit("coffee"))
        .when(contains_any(up, chimney), F.lit("chimney_cake"))
        .otherwise(F.lit("other"))
    )


def trend3(growth_pct: str | Column) -> Column:
    g = col_(growth_pct)
    return F.when(g > 5, "growing").when(g < -5, "declining").otherwise("stable")


def trend5(growth_pct: str | Column) -> Column:
    g = col_(growth_pct)
    return (
        F.when(g > 10, "Strong Growth").when(g > 3, "Moderate Growth")
        .when(g > -3, "Stable").when(g > -10, "Moderate Decline")
        .otherwise("Sharp Decline")
    )


def network_growth_label(growth_pct: str | Column) -> Column:
    g = col_(growth_pct)
    return F.when(g > 3, "strong").when(g > 1, "moderate").when(g > 0, "slow").otherwise("negative")


def lift_strength(lift: str | Column) -> Column:
    x = col_(lift)
    return (
        F.when(x > 3, "very strong").when(x > 2, "strong")
        .when(x > 1.5, "moderate").otherwise("present")
    )


def lift_priority(lift: str | Column) -> Column:
    return F.when(col_(lift) >= 2, "HIGH").otherwise("MEDIUM")


def beverage_status(share_pct: str | Column,
                    target: float = K.BEVERAGE_TARGET_PCT,
                    amber_ratio: float = K.BEVERAGE_AMBER_RATIO) -> Column:
    s = col_(share_pct)
    return F.when(s >= target, "green").when(s >= amber_ratio * target, "amber").otherwise("red")


def fixed(x: str | Column, decimals: int) -> Column:
    """``f"{x:.Nf}"``: rounded half-even on the binary value, no thousands separators."""
    return F.replace(F.format_number(col_(x), decimals), F.lit(","), F.lit(""))


def signed(x: str | Column, decimals: int) -> Column:
    """``f"{x:+.Nf}"``: as ``fixed``, with a plus sign before numbers that are not negative."""
    text = fixed(x, decimals)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def month_label(year: str | Column, month: str | Column) -> Column:
    """``December 2025`` style label."""
    return F.date_format(F.make_date(col_(year), col_(month), F.lit(1)), "MMMM yyyy")


def column_suffix(value: str) -> str:
    """``TAKE AWAY`` -> ``take_away`` (for pivoted column names)."""
    out = "".join(ch.lower() if ch.isalnum() else "_" for ch in value.strip())
    while "__" in out:
        out = out.replace("__", "_")
    return out.strip("_")
