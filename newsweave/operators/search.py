"""Boolean text search and the filters of the view, as Columns.

Query: blanks part terms, quotes keep a phrase, ``OR`` (in any case) or ``|`` makes both neighbours alternatives, a leading ``-``
excludes. A row passes if every plain term stands in some text column, at least one alternative does (if there are any)
and no excluded term does. Terms are literal and case-insensitive; columns are searched one by one, not across.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_query(q: str) -> tuple[list[str], list[str], list[str]]:
    """(all, any, none)."""
    if q.count('"') % 2:
        raise ValueError("unbalanced quote")
    parts = [(m[1] or "") + (m[2] if m[2] is not None else m[3]) for m in re.finditer(r'(-?)(?:"([^"]*)"|(\S+))', q)]
    every, either, none = [], [], []
    is_or = [p.upper() in ("OR", "|") for p in parts]
    for i, p in enumerate(parts):
        if is_or[i] or not p.strip("-"):
            continue
        if p[0] == "-":
            none.append(p[1:].lower())
        elif (i and is_or[i - 1]) or (i + 1 < len(parts) and is_or[i + 1]):
            either.append(p.lower())
        else:
            every.append(p.lower())
    return every, either, none


def matches(q: str, columns: list[Column]) -> Column:
    every, either, none = parse_query(q)
    hay = F.lower(F.concat_ws("\u0001", *columns))
    has = lambda t: F.contains(hay, F.lit(t))
    out = F.lit(True)
    for t in every:
        out &= has(t)
    if either:
        some = has(either[0])
        for t in either[1:]:
            some |= has(t)
        out &= some
    for t in none:
        out &= ~has(t)
    return out


@dataclass
class FilterSpec:
    """A saved filter; an empty field doesn't filter."""

    text: str = ""
    feeds: list[str] = field(default_factory=list)
    min_score: float = 0.0
    sectors: list[str] = field(default_factory=list)
    places: str = ""
    dates: tuple[str, str] | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, s: str) -> FilterSpec:
        return cls(**json.loads(s))

    def apply(self, df: DataFrame, text: list[str], feed: str = "feed", score: str = "score", sector: str = "sector", mentioned: str = "sectors", places: str = "locations", date: str = "date") -> DataFrame:
        """One conjunctive filter, which the optimiser pushes to the scan as far as it can."""
        if self.text.strip():
            df = df.where(matches(self.text, [F.col(c).cast("string") for c in text]))
        if self.feeds:
            df = df.where(F.col(feed).isin(*self.feeds))
        if self.min_score > 0:
            df = df.where(F.coalesce(F.col(score), F.lit(0.0)) >= self.min_score)
        if self.sectors:
            df = df.where(F.col(sector).isin(*self.sectors) | F.coalesce(F.arrays_overlap(mentioned, F.array(*map(F.lit, self.sectors))), F.lit(False)))
        if tags := [t.strip().lower() for t in self.places.split(",") if t.strip()]:
            hit = lambda x: F.exists(F.array(*map(F.lit, tags)), lambda t: F.contains(F.lower(x), t))
            df = df.where(F.coalesce(F.exists(places, hit), F.lit(False)))
        if self.dates:
            df = df.where(F.to_date(date).between(*[F.lit(x).cast("date") for x in self.dates]))
        return df
