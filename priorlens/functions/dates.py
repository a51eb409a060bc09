"""Dates with explicit precision, bounds, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, strip

# Which source is believed first when two dates tie.
SOURCE_PRIORITY = {
    "arxiv_v1": 0,
    "preprint_v1": 0,
    "openreview_first_public": 1,
    "accepted_manuscript": 2,
    "publisher_online": 2,
    "crossref_published_online": 3,
    "crossref_issued": 3,
    "proceedings": 4,
    "publication": 5,
    "year_only": 99,
}
UNKNOWN_SOURCE_PRIORITY = 50
SHORT_WINDOW_DAYS = 548


def source_priority(source: Column) -> Column:
    pairs = [F.lit(x) for item in SOURCE_PRIORITY.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(source, F.lit(""))), F.lit(UNKNOWN_SOURCE_PRIORITY))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_date(c: Column | str) -> Column:
    """``struct(parsed, precision, lower_bound, upper_bound)`` of a textual date.

    A year or a month is never turned into a day; it only has bounds.
    """
    c = _col(c).cast("string")

    def first_day(text: Column) -> Column:
        written = text.rlike(r"^\d{4}(-\d{1,2}){0,2}$")
        dashes = F.when(written, F.length(F.translate(text, "0123456789", "")))
        return F.struct(dashes.alias("dashes"), F.when(written & ~text.startswith("0000-"), text.try_cast("date")).alias("day"))

    def bounds(first: Column) -> Column:
        day, dashes = first["day"], first["dashes"]
        precision = (
            F.when(c.isNull() | (c == ""), "missing")
            .when(dashes == 0, "year")
            .when((dashes == 1) & day.isNotNull(), "month")
            .when((dashes == 2) & day.isNotNull(), "day")
            .otherwise("invalid")
        )
        return F.struct(
            F.when(dashes == 2, day).alias("parsed"),
            precision.alias("precision"),
            day.alias("lower_bound"),
            F.when(dashes == 2, day).when(dashes == 1, F.last_day(day)).otherwise(F.date_sub(F.add_months(day, 12), 1)).alias("upper_bound"),
        )

    return _once(_once(strip(c), first_day), bounds)


def full_day(c: Column | str) -> Column:
    """DATE of a ten-character ISO day, null for anything else."""
    c = _col(c).cast("string")
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def observation_window(date_a: Column, date_b: Column, cutoff: Column) -> Column:
    """Days from the newer endpoint to the cutoff; null when any date is missing."""
    known = date_a.isNotNull() & date_b.isNotNull() & cutoff.isNotNull()
    return F.when(known, F.date_diff(cutoff, F.greatest(date_a, date_b)))


def window_status(days: Column, cutoff: Column) -> Column:
    return (
        F.when(cutoff.isNull(), "NO_CUTOFF")
        .when(days.isNull(), "ENDPOINT_DATE_UNRESOLVED")
        .when(days < 0, "POST_CUTOFF_ENDPOINT")
        .when(days < SHORT_WINDOW_DAYS, "BELOW_DIAGNOSTIC_THRESHOLD")
        .otherwise("MEETS_DIAGNOSTIC_THRESHOLD")
    )


def window_bin(days: Column) -> Column:
    return (
        F.when(days.isNull(), "UNKNOWN")
        .when(days < 0, "POST_CUTOFF_PRIOR")
        .when(days <= 180, "0_TO_6_MONTHS")
        .when(days <= 365, "6_TO_12_MONTHS")
        .when(days <= 548, "12_TO_18_MONTHS")
        .when(days <= 1095, "18_TO_36_MONTHS")
        .otherwise("OVER_36_MONTHS")
    )
