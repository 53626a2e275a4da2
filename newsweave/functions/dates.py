"""Dates as Column expressions. Unparseable text gives null; text without a zone is UTC."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc822(c: Column, strict: bool = False) -> Column:
    """RFC 822 date to a timestamp. strict: zone names such as GMT aren't read, as a plain offset parser wouldn't."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    if not strict:
        bare = F.regexp_replace(bare, r" (GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")))


def lenient(c: Column) -> Column:
    """RFC 822, else ISO with or without zone."""
    return F.coalesce(rfc822(c), F.try_to_timestamp(F.trim(c)))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def lenient_any(c: Column) -> Column:
    """``lenient``, else the written forms that feeds use: day first with dashes, dots or slashes, and month names."""
    t = F.regexp_replace(F.trim(c), r"^[A-Za-z]+,?\s+(?=\d)", "")
    forms = ("d-M-yyyy HH:mm[:ss]", "d.M.yyyy HH:mm[:ss]", "d/M/yyyy HH:mm[:ss]", "d MMMM yyyy HH:mm[:ss]", "d MMM yyyy HH:mm[:ss]", "d-M-yyyy", "d MMMM yyyy")
    return F.coalesce(lenient(c), *[F.try_to_timestamp(t, F.lit(f)) for f in forms])


# The view's quick ranges, in days; None is the whole.
QUICK = {"30d": 30, "90d": 90, "1y": 365, "all": None}


def quick_range(name: str, lo, hi) -> tuple:
    """The last days before hi, not before lo."""
    days = QUICK[name]
    return (lo, hi) if days is None else (max(lo, hi - timedelta(days=days)), hi)


def clamp_range(wanted: tuple | None, lo, hi) -> tuple:
    """Each bound into [lo, hi]; a malformed or inverted range gives the whole."""
    try:
        a, b = (max(lo, min(hi, x)) for x in wanted)
    except TypeError:
        return lo, hi
    return (a, b) if a <= b else (lo, hi)
