"""Column expressions for text dates, years and ratios.

Dates in the input look like ``Tue Mar 03 08:19:07 -0800 2015``.  Year and
month are cut out of the text as written (the UTC offset is ignored), so no
row moves across a year or month boundary because of time-zone conversion.
All casts are ``try_cast`` so malformed text becomes NULL under ANSI mode
instead of failing the job.

Parsing text is the main per-row cost of every operator.  The operators
therefore evaluate each parse once per row: a parsed value that is NULL or out
of range is kept as a NULL grouping key and that group is dropped *after* the
aggregate (``count(key) > 0``).  A ``where`` on the parsed value would be
pushed below the projection by the optimizer and parse the text again for
every predicate.  Where rows have to be filtered on a derived value after all,
``settled`` keeps the filter above the derivation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the source data's conventions)
# ---------------------------------------------------------------------------
# English month abbreviations in calendar order: position + 1 is the month.
MONTH_ABBREVIATIONS = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)
# Four digits at the very end of the text are the year.
TRAILING_YEAR_PATTERN = r"(\d{4})$"
# "Www Mmm d " prefix: weekday, month abbreviation, day of month.
MONTH_TOKEN_PATTERN = r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+\d{1,2}\s"
# A whole string of digits.
DIGITS_PATTERN = r"^[0-9]+$"
FOUR_DIGITS_PATTERN = r"^[0-9]{4}$"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def non_empty(col: str | Column) -> Column:
    """Not NULL and at least one character."""
    c = _c(col)
    return c.isNotNull() & (F.length(c) > 0)


def has_text(col: str | Column) -> Column:
    """Not NULL and something left after trimming spaces (tabs/newlines count as text)."""
    c = _c(col)
    return c.isNotNull() & (F.length(F.trim(c)) > 0)


def trailing_year(col: str | Column) -> Column:
    """Last four digits at the end of the text as int; NULL when there are none."""
    return F.regexp_extract(_c(col), TRAILING_YEAR_PATTERN, 1).try_cast("int")


def month_abbrev_to_num(col: str | Column) -> Column:
    """Month number 1..12 from the ``Www Mmm d`` prefix; NULL when absent or unknown.

    A literal map lookup keeps the token to one regex evaluation per row
    (a missing key gives NULL)."""
    token = F.regexp_extract(_c(col), MONTH_TOKEN_PATTERN, 1)
    lookup = F.create_map(
        *[x for i, m in enumerate(MONTH_ABBREVIATIONS, start=1) for x in (F.lit(m), F.lit(i))]
    )
    return lookup[token]


def yyyymm(year: str | Column, month: str | Column) -> Column:
    return _c(year) * 100 + _c(month)


def month_index(ym: str | Column) -> Column:
    """Running month number: floor(yyyymm / 100) * 12 + yyyymm % 100 - 1."""
    c = _c(ym)
    return F.floor(c / 100) * 12 + (c % 100) - 1


def months_between_idx(later: str | Column, earlier: str | Column) -> Column:
    """Whole months from ``earlier`` to ``later`` (both yyyymm) as int."""
    return (month_index(later) - month_index(earlier)).cast("int")


def safe_int(col: str | Column) -> Column:
    """Digits-only text to int; anything else (or an overflow) gives NULL."""
    c = _c(col)
    return F.when(c.rlike(DIGITS_PATTERN), c.try_cast("int"))


def four_digit_year(col: str | Column) -> Column:
    c = _c(col)
    return F.when(c.rlike(FOUR_DIGITS_PATTERN), c.try_cast("int"))


def share(numerator: str | Column, denominator: str | Column) -> Column:
    """numerator / denominator as double; NULL instead of an error on zero."""
    return F.try_divide(_c(numerator), _c(denominator))


def settled(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with ``cols`` (by default all) computed once per row: later filters on them stay above this point, and
    later expressions read the values instead of repeating what they were computed from.

    The columns pass through a one-element ``inline``, whose output the optimizer can't trace back; it runs inside the
    generated code, without a shuffle.  The other columns can be pruned and filtered as before."""
    names = list(cols) or df.columns
    out = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*out, F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in names])))).select(*[F.col(f"`{c}`") for c in df.columns])
