"""Column helpers that pin down the semantics the analytics need.

Every helper returns a ``Column`` built from built-in functions only, so it
stays inside whole-stage codegen.  Where the natural Spark function behaves
differently from what the analytics require, the helper says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_days(start: str | Column, end: str | Column) -> Column:
    """Whole days from ``start`` to ``end``, floored towards minus infinity.

    -12 h gives -1, +12 h gives 0, -25 h gives -2.  ``datediff`` counts date
    changes and ``timestampdiff(DAY)`` truncates, so neither is right.

    The difference of two zone-less timestamps is an exact day-time interval
    (no session time zone is involved; ``timestamp_diff`` would convert
    zone-less values to the session zone and be off by an hour across a
    daylight-saving change).  Its day field truncates towards zero and the
    remainder carries the sign, so a negative remainder takes one more day
    off.  NULL in, NULL out.
    """
    iv = col_(end) - col_(start)
    days = F.extract(F.lit("DAY"), iv).cast("long")
    negative = ((F.extract(F.lit("HOUR"), iv) < 0) | (F.extract(F.lit("MINUTE"), iv) < 0)
                | (F.extract(F.lit("SECOND"), iv) < 0))
    return days - negative.cast("long")


def ntz_text(c: str | Column, fraction: bool = True) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.ffffff]`` text of a zone-less timestamp, built
    from its fields (``date_format`` would pass through the session time
    zone and shift wall-clock times that fall into a daylight-saving gap)."""
    ts = col_(c)
    parts = [F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts)]
    if not fraction:
        return F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *parts)
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long") % 1_000_000
    return F.format_string("%04d-%02d-%02d %02d:%02d:%02d.%06d", *parts, micros)


def ntz_date_text(c: str | Column) -> Column:
    ts = col_(c)
    return F.format_string("%04d-%02d-%02d", F.year(ts), F.month(ts), F.dayofmonth(ts))


def ntz_month_text(c: str | Column) -> Column:
    """``yyyy-MM`` of a zone-less timestamp (NULL stays NULL)."""
    ts = col_(c)
    return F.when(ts.isNotNull(), F.format_string("%04d-%02d", F.year(ts), F.month(ts)))


def plus_days(ts: str | Column, days: int) -> Column:
    return col_(ts) + F.make_dt_interval(F.lit(days))


def flag(predicate: Column) -> Column:
    """A comparison where an unknown operand counts as False, not NULL."""
    return F.coalesce(predicate, F.lit(False))


def pct_true(c: str | Column) -> Column:
    """Share of true values among non-null ones, in percent."""
    return F.avg(col_(c).cast("double")) * F.lit(100.0)


def pct_not(c: str | Column) -> Column:
    """Share of false values among non-null ones, in percent."""
    return F.avg((~col_(c)).cast("double")) * F.lit(100.0)


# Money is exact to 1/1,000,000 of the currency unit.
MONEY_UNITS = 1_000_000


def _money_lanes(c: str | Column) -> tuple[Column, Column]:
    """A money amount as whole currency units and millionths, both long.

    The whole part is taken in the amount's own type (no detour through
    double for decimals) and the rest below one unit is exact in a double, so
    both lanes are exact for decimals of up to 6 decimals and for doubles that
    carry such amounts.
    """
    x = col_(c)
    whole = F.floor(x)
    return whole.cast("long"), F.rint((x - whole).cast("double") * F.lit(float(MONEY_UNITS))).cast("long")


def money_sum(c: str | Column) -> Column:
    """Exact money sum as ``decimal(38,6)``; 0 when there is nothing to sum.
    Independent of the order in which partitions are merged.

    Two long sums stay on Spark's fixed-width hash aggregation path (a decimal
    sum of more than 18 digits falls back to arbitrary precision).  The whole
    lane holds totals up to 9.2e18 currency units and the fraction lane 9.2e12
    rows; beyond that the sum raises (ANSI) instead of wrapping.
    """
    whole, part = _money_lanes(c)
    low = F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)") / F.lit(MONEY_UNITS)
    return (F.coalesce(F.sum(whole), F.lit(0)).cast("decimal(31,6)") + low.cast("decimal(31,6)")).cast("decimal(38,6)")


def money_mean(c: str | Column) -> Column:
    """Mean of a money column as a double: the exact sum, converted once,
    divided by the count of non-null values."""
    x = col_(c)
    return F.try_divide(F.when(F.count(x) > 0, money_sum(x)).cast("double"), F.count(x).cast("double"))


def first_non_null(value: str | Column, *order: str | Column) -> Column:
    """The first non-null ``value`` of a group, first by the given order.

    Rows whose value is NULL are ignored (their ordering key becomes NULL and
    ``min_by`` skips NULL keys).  Partial aggregation applies, so a hot group
    is reduced map-side.
    """
    v = col_(value)
    key = F.struct(*[col_(o) for o in order]) if len(order) > 1 else col_(order[0])
    return F.min_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), key))


def last_non_null_nulls_last(value: str | Column, sort_key: str | Column,
                             tiebreak: str | Column) -> Column:
    """The last non-null ``value`` after an ascending sort on ``sort_key``
    that places NULL keys at the end, so a row with a NULL key wins."""
    v, k = col_(value), col_(sort_key)
    order = F.struct(k.isNull(), k, col_(tiebreak))
    return F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), order))


def mode_low(c: str | Column) -> Column:
    """Most frequent non-null value; ties go to the smallest value."""
    return F.mode(col_(c), deterministic=True)


def title_words(c: str | Column) -> Column:
    """``snake_case`` → ``Title Case`` (underscores become spaces).

    A word starts at every letter that does not follow a letter, so also after
    hyphens, apostrophes and digits (``initcap`` starts words after spaces only):
    the text is cut into runs of letters and of anything else, and each run's
    first character is raised.
    """
    runs = F.regexp_extract_all(F.regexp_replace(col_(c), "_", " "), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                             F.lower(F.substring(r, 2, 1 << 20)))), "")


def fmt_grouped(c: str | Column, decimals: int) -> Column:
    """``{x:,.Nf}``: thousands separators, N decimals."""
    return F.format_number(col_(c), decimals)


def fmt_money(c: str | Column, decimals: int = 2) -> Column:
    return F.concat(F.lit("R$"), fmt_grouped(c, decimals))


def fmt_percent_of_one(c: str | Column) -> Column:
    """``{p:.0%}`` of a probability in [0, 1]."""
    return F.concat(F.format_number(col_(c) * F.lit(100.0), 0), F.lit("%"))


def fmt_percent(c: str | Column, decimals: int = 1) -> Column:
    """``{x:.1f}%`` of a value already in percent."""
    return F.concat(F.format_number(col_(c), decimals), F.lit("%"))


def str_of_rounded(c: str | Column, decimals: int) -> Column:
    """``str(round(x, n))`` for a double, e.g. ``12.0``, ``3.5``."""
    return F.bround(col_(c), decimals).cast("double").cast("string")
