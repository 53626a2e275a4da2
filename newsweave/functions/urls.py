"""URL canonicalisation and article ids, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a query as a tracker's.
TRACKERS = "utm_|fbclid=|gclid="


def canonical_url(url: Column) -> Column:
    """Without fragment; without its whole query if that holds a tracker; without slashes at the end. Null gives ''."""
    bare = F.split_part(F.trim(F.coalesce(url, F.lit(""))), F.lit("#"), F.lit(1))
    head = F.substring_index(bare, "?", 1)
    query = F.substring(bare, F.length(head) + F.lit(2), F.length(bare))
    kept = F.when(F.instr(bare, "?") == 0, bare).when(F.lower(query).rlike(TRACKERS), head).otherwise(bare)
    return F.regexp_replace(kept, "/+$", "")


def article_id(canonical: Column) -> Column:
    return F.sha2(canonical, 256)
