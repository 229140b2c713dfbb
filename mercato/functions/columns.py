"""Column expressions: durations, calendar labels, guarded arithmetic, bands.

Everything here is a built-in Spark expression, so it stays inside generated
JVM code and can be used in any ``select``, ``filter`` or ``agg``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

SECONDS_PER_DAY = 86400
WEEKDAY_SHORT = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
WEEKDAY_LONG = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- durations and calendar -------------------------------------------------


def floor_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole elapsed days, rounded towards minus infinity.

    18 hours early is -1 and 12 hours late is 0.  ``datediff`` counts
    midnights instead and gives other answers.
    """
    seconds = F.unix_seconds(_col(later)) - F.unix_seconds(_col(earlier))
    return F.floor(seconds / SECONDS_PER_DAY)


def month_label(ts: Column | str) -> Column:
    """``2018-01``; null stays null."""
    return F.date_format(_col(ts), "yyyy-MM")


def week_label(ts: Column | str) -> Column:
    """Monday-to-Sunday week as ``2018-01-01/2018-01-07``."""
    monday = F.date_trunc("week", _col(ts)).cast("date")
    return F.concat_ws(
        "/",
        F.date_format(monday, "yyyy-MM-dd"),
        F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"),
    )


def weekday_name(day: Column | str, long: bool = False) -> Column:
    """Name of a weekday number, Monday being 0."""
    names = F.array(*[F.lit(n) for n in (WEEKDAY_LONG if long else WEEKDAY_SHORT)])
    return F.get(names, _col(day).cast("int"))


def months_between_labels(later: Column | str, earlier: Column | str) -> Column:
    """Whole months between two ``yyyy-MM`` labels."""

    def ordinal(label: Column) -> Column:
        return F.substring(label, 1, 4).cast("int") * 12 + F.substring(label, 6, 2).cast("int")

    return (ordinal(_col(later)) - ordinal(_col(earlier))).cast("int")


# --- sums and guarded division ------------------------------------------------


#: Bits of each of the three parts below 1 that ``exact_sum`` adds up.
PART_BITS = 26


def _parts(c: Column | str) -> list[Column]:
    """A double as whole numbers that count 1, ``2 ** -26``, ``2 ** -52`` and ``2 ** -78``."""
    base = float(1 << PART_BITS)
    value = F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))
    # Scaling by a power of two and the differences of near whole numbers are exact.
    steps = [F.rint(value * base**k if k else value) for k in range(4)]
    parts = [steps[0], *(fine - coarse * base for coarse, fine in zip(steps, steps[1:]))]
    return [part.cast("bigint") for part in parts]


def _nearest(whole: Column, high: Column, middle: Column, low: Column) -> Column:
    """The double nearest to the sum of added-up parts."""

    def carry(part: Column) -> Column:
        return F.shiftright(part, PART_BITS)

    base, mask = float(1 << PART_BITS), (1 << PART_BITS) - 1
    middle = middle + carry(low)
    high = high + carry(middle)
    whole = whole + carry(high)
    low, middle, high = (part.bitwiseAND(mask) for part in (low, middle, high))
    # Both operands of each addition are exact, or odd in a bit far below the result's last one, so it rounds rightly.
    upper, lower = whole * (1 << PART_BITS) + high, middle * (1 << PART_BITS) + low
    small = upper.cast("double") / base + lower.cast("double") / base**3
    below = high * (1 << PART_BITS + 1) + middle * 2
    large = whole.cast("double") + below.bitwiseOR((low > 0).cast("bigint")).cast("double") / (2 * base**2)
    rest = high.bitwiseAND(mask >> 2).bitwiseOR(lower)
    quarters = (whole * 4 + F.shiftright(high, PART_BITS - 2)).bitwiseOR((rest > 0).cast("bigint"))
    size = F.abs(whole)
    return F.when(size < 1 << 27, small).when(size < 1 << 53, large).otherwise(quarters.cast("double") / 4)


def exact_sum(c: Column | str) -> Column:
    """Aggregate: the sum of doubles rounded once, at the end; null when every value is null.

    Each value is cut, without loss down to ``2 ** -78``, into a whole number
    and three whole numbers of 26 bits, which are added as 64-bit integers.  So
    the sum is the double nearest to the true one whatever the order in which
    tasks finish, and later steps (thresholds, ranks, edges, top-k) compare the
    same digits.  NaN counts as null.  Sums beyond ``2 ** 61`` or of more than
    ``2 ** 37`` rows in one group overflow, with an error.
    """
    return _nearest(*map(F.sum, _parts(c)))


def part_sums(c: Column | str, name: str) -> list[Column]:
    """Aggregates that ``exact_sum`` rounds, kept as columns; ``merged_sum`` adds up those of many groups."""
    return [F.sum(part).alias(f"{name}__{k}") for k, part in enumerate(_parts(c))]


def merged_sum(name: str, over: WindowSpec | None = None) -> Column:
    """Aggregate, or with ``over`` a window function: the total of the groups' ``part_sums``, 0.0 when every value is null."""
    sums = [F.sum(f"{name}__{k}") for k in range(4)]
    return F.coalesce(_nearest(*(x.over(over) if over else x for x in sums)), F.lit(0.0))


def merged_row(name: str) -> Column:
    """The total of one group's ``part_sums``."""
    return F.coalesce(_nearest(*(F.col(f"{name}__{k}") for k in range(4))), F.lit(0.0))


def total(c: Column | str) -> Column:
    """Aggregate: ``exact_sum``, 0.0 when every value is null."""
    return F.coalesce(exact_sum(c), F.lit(0.0))


def count_total(c: Column | str) -> Column:
    """Aggregate: sum of whole numbers, 0 when there are none."""
    return F.coalesce(F.sum(_col(c)), F.lit(0)).cast("bigint")


def count_when(condition: Column) -> Column:
    """Aggregate: number of rows on which ``condition`` is true."""
    return F.count(F.when(condition, F.lit(1)))


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Quotient; null when the divisor is 0 or either side is null."""
    return F.try_divide(_col(top).cast("double"), _col(bottom).cast("double"))


def safe_div(top: Column | str, bottom: Column | str, default: float = 0.0) -> Column:
    """Quotient, or ``default`` when the divisor is 0."""
    b = _col(bottom).cast("double")
    return F.when(b == 0, F.lit(float(default))).otherwise(F.try_divide(_col(top).cast("double"), b))


def percent(top: Column | str, bottom: Column | str) -> Column:
    """``100 * top / bottom``, 0 when the divisor is not positive."""
    return F.when(_col(bottom) > 0, ratio(top, bottom) * 100).otherwise(F.lit(0.0))


def growth(current: Column | str, previous: Column | str) -> Column:
    """Percentage growth, 0 when the previous value is 0."""
    cur, prev = _col(current).cast("double"), _col(previous).cast("double")
    return F.when(prev == 0, F.lit(0.0)).otherwise(F.try_divide(cur - prev, prev) * 100)


# --- bins and bands -----------------------------------------------------------


def cut(
    value: Column | str,
    edges: Sequence[float],
    labels: Sequence,
    include_lowest: bool = False,
) -> Column:
    """Label of the half-open bin ``(edge[i], edge[i+1]]`` holding ``value``.

    A value outside the edges, or on the lowest edge unless
    ``include_lowest``, gets null.  ``float('inf')`` leaves a side open.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("cut needs one label fewer than edges")
    v = _col(value)
    first = v >= edges[0] if include_lowest else v > edges[0]
    out = F.when(v.isNull() | ~first, F.lit(None))
    for upper, label in zip(edges[1:], labels):
        out = out.when(F.lit(True) if upper == float("inf") else v <= upper, F.lit(label))
    return out


def cut_at(value: Column | str, uppers: Sequence[Column], labels: Sequence) -> Column:
    """Like :func:`cut` with computed upper edges; the last bin is open.

    Equal edges are allowed: the value then falls to the lowest such bin.
    """
    v = _col(value)
    out = F.when(v.isNull(), F.lit(None))
    for upper, label in zip(uppers, labels):
        out = out.when(v <= upper, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


# Names of the score bands of the net promoter score.
NPS_BANDS = (
    (70, "World Class"),
    (50, "Excellent"),
    (30, "Great"),
    (10, "Good"),
    (0, "Needs Improvement"),
)


def nps_band(nps: Column | str) -> Column:
    """Name of the band a net promoter score falls into."""
    v = _col(nps)
    out = F.when(v.isNull(), F.lit(None))
    for floor, name in NPS_BANDS:
        out = out.when(v >= floor, F.lit(name))
    return out.otherwise(F.lit("Critical"))
