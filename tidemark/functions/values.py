"""Column functions for dates, numbers and text, with the strictness that point-in-time data needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "."
BANDS = ("Normal", "Watch", "Elevated", "High")
CONFIDENCE = ("Verified", "Provisional", "Stale", "Unverified", "Conflicting")


def strict_date(text: Column) -> Column:
    """The date of a YYYY-MM-DD text, or null: a bare cast would also take 2020-1-5."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def utc_timestamp(text: Column) -> Column:
    """The timestamp of a canonical UTC text (Z, whole seconds or microseconds), or null."""
    return F.when(
        text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{6})?Z$"), text.try_cast("timestamp")
    )


def month_of(day: Column) -> Column:
    """year * 12 + month - 1."""
    return F.year(day) * 12 + F.month(day) - 1


def month_text(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def month_start(index: Column) -> Column:
    return F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1))


def quarter_of(day: Column) -> Column:
    """year * 4 + quarter - 1."""
    return F.year(day) * 4 + F.quarter(day) - 1


def quarter_text(index: Column) -> Column:
    return F.format_string("%d-Q%d", F.floor(index / 4).cast("int"), (index % 4 + 1).cast("int"))


def number(text: Column) -> Column:
    """A plain finite decimal text as a double, else null; the missing mark and odd spellings are no numbers."""
    value = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def loose_number(text: Column) -> Column:
    """The client's parser: trimmed; a dot or nothing is null; else a double."""
    bare = F.trim(text)
    return F.when((bare != MISSING) & (bare != ""), bare).try_cast("double")


def six_places(value: Column) -> Column:
    """Six decimal places, half to even, without a negative zero."""
    return F.bround(value, 6) + F.lit(0.0)


def clamp(value: Column, limit: float) -> Column:
    """Null stays null: least() and greatest() alone would pass over it."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(-limit)), F.lit(limit)))


def safe_path(path: Column) -> Column:
    """Whether a text is a relative POSIX path that doesn't climb."""
    return (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def classify(value: Column, p70: Column, p85: Column, p95: Column) -> Column:
    """The band of a value: only the upper edge of the third band belongs to it."""
    return (
        F.when(value < p70, BANDS[0]).when(value < p85, BANDS[1]).when(value <= p95, BANDS[2]).when(value > p95, BANDS[3])
    )


def exact_percentile(sorted_micros: Column, percent: int) -> Column:
    """The linear percentile of ascending whole millionths, exactly, half to even at six places.

    Binary percentiles miss by half a quantum; here the interpolation runs on decimals.
    """
    n = F.size(sorted_micros)
    at = (n - 1) * percent
    first = F.floor(at / 100).cast("int")
    low, high = F.get(sorted_micros, first), F.get(sorted_micros, F.least(first + 1, n - 1))
    scaled = low.cast("decimal(20,0)") * 100 + (high - low).cast("decimal(20,0)") * (at % 100).cast("decimal(3,0)")
    exact = scaled.cast("decimal(24,0)") * F.lit("0.00000001").cast("decimal(9,8)")
    return F.when(n > 0, F.bround(exact, 6).cast("double"))


def regime(month_idx: Column, window: int = 6) -> tuple[Column, Column]:
    """Business-cycle regime and turning-point context of a month."""
    # Recessions as (peak, trough), in months.
    spans = [(2007 * 12 + 11, 2009 * 12 + 5), (2020 * 12 + 1, 2020 * 12 + 3)]
    inside, turning = F.lit(False), F.lit(False)
    for peak, trough in spans:
        inside |= month_idx.between(peak, trough)
        for edge in (peak, trough):
            turning |= F.abs(month_idx - edge) <= window
    return F.when(inside, "recession").otherwise("expansion"), F.when(turning, "turning_point").otherwise("trend")


def positive(band: Column, abstained: Column) -> Column:
    """The signal of a band: null without a band or if the composite abstained."""
    return F.when(~abstained & band.isNotNull(), band.isin(*BANDS[1:]))


def worst_label(labels: Column) -> Column:
    """The worst of an array of confidence labels, in a fixed order of rank."""
    order = F.array(*[F.lit(c) for c in CONFIDENCE])
    ranks = F.transform(labels, lambda x: F.array_position(order, x))
    return F.element_at(order, F.array_max(ranks).cast("int"))


def verification_label(discrepancies: Column, records: Column, debts: Column) -> Column:
    return (
        F.when(discrepancies > 0, "Conflicting")
        .when(records == 0, "Unverified")
        .when(debts > 0, "Provisional")
        .otherwise("Verified")
    )
