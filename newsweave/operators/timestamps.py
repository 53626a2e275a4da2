"""Timestamps of many formats, precisions and zones to one UTC instant.

A value is reduced to its shape mask (digits to ``9``, letters to ``a``). Each distinct mask is mapped to a parser
once; the parser is a set of character slices, so all values of one mask are converted together with numpy. Wall-clock
times go through transition tables, one per zone, that carry the version of the zone data they were made from.

Defined results: null, empty, relative or placeholder text and bare dates give null, as do impossible dates and a
wall-clock time whose zone is unknown. A time that occurs twice takes the earlier instant; one that a zone skips
is read with the offset before the change. Fractions are cut off, missing seconds are 00.
"""

from __future__ import annotations

import datetime as dt
import re
import zoneinfo
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and abbreviations, Dutch and English.
MONTHS = {
    "januari": 1, "februari": 2, "maart": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "augustus": 8,
    "september": 9, "oktober": 10, "november": 11, "december": 12,
    "january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "august": 8, "october": 10,
    "jan": 1, "feb": 2, "mrt": 3, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9,
    "okt": 10, "oct": 10, "nov": 11, "dec": 12,
}
# Offsets in minutes of zone names, used where the feed's own zone doesn't define the name.
ZONE_NAMES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60,
    "mest": 120, "eet": 120, "eest": 180, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360,
    "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_TIME = r"(?P<h>9{1,2})[:.](?P<mi>99)(?::(?P<s>99)(?:[.,]9+)?)?"
_ZONE = r"(?: ?(?:(?P<zn>a+)|(?P<off>[+-]99:?(?:99)?)))?"
#: Shapes over masks; the spans of the groups are the slices of the parser.
_SHAPES = {
    "iso": re.compile(rf"(?P<y>9999)-(?P<m>99)-(?P<d>99)(?:a|,? ){_TIME}{_ZONE}"),
    "basic": re.compile(r"(?P<y>9999)(?P<m>99)(?P<d>99)a(?P<h>99)(?P<mi>99)(?P<s>99)(?:[.,]9+)?" + _ZONE),
    "day_first": re.compile(rf"(?P<d>99?)-(?P<m>99?)-(?P<y>9999),? {_TIME}{_ZONE}"),
    "named": re.compile(rf"(?:(?P<wd>a+)\.?,? )?(?P<d>99?) (?P<mon>a+)\.? (?P<y>9999)(?:,? (?P<om>a+)|,)? {_TIME}(?: (?P<ap>aa)(?!a))?{_ZONE}"),
    "named_us": re.compile(rf"(?:(?P<wd>a+)\.?, )?(?P<mon>a+)\.? (?P<d>99?), (?P<y>9999),? (?:(?P<om>a+) )?{_TIME}(?: (?P<ap>aa)(?!a))?{_ZONE}"),
    "epoch_s": re.compile(r"(?P<n>9{10})"),
    "epoch_ms": re.compile(r"(?P<n>9{13})"),
    "epoch_us": re.compile(r"(?P<n>9{16})"),
}
# What 9 and a stand for. Other characters keep themselves.
_MASK = str.maketrans({c: "9" for c in "0123456789"} | {c: "a" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZéûÉÛ"})


def shape_mask(value: str) -> str:
    return value.translate(_MASK)


@lru_cache(maxsize=4096)
def parser_for(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """The parser of a mask: the kind and the character slices of its fields; None if the mask fixes no instant."""
    for kind, shape in _SHAPES.items():
        if m := shape.fullmatch(mask):
            return kind, {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def zone_data_version() -> str:
    """Version of the zone data that the transition tables are made from."""
    for root in zoneinfo.TZPATH:
        for name in ("+VERSION", "tzdata.zi"):
            try:
                with open(f"{root}/{name}") as f:
                    return f.readline().strip().replace("# version ", "")
            except OSError:
                continue
    return "unknown"


@lru_cache(maxsize=512)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray, dict[str, int]] | None:
    """Thresholds in wall-clock seconds, the offsets between them, and the zone's own names with their offsets."""
    try:
        tz = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    at = lambda t: int(dt.datetime.fromtimestamp(t, dt.UTC).astimezone(tz).utcoffset().total_seconds())
    lo, hi, step = -2_208_988_800, 4_102_444_800, 7 * 86_400
    offsets, limits, names, before = [at(lo)], [], {}, at(lo)
    for t in range(lo + step, hi, step):
        if (now := at(t)) == before:
            continue
        a, b = t - step, t
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if at(mid) == before else (a, mid)
        limits.append(b + max(before, now))
        offsets.append(now)
        if b > 0:
            for u in (b - 1, b):
                d = dt.datetime.fromtimestamp(u, dt.UTC).astimezone(tz)
                names[d.tzname().lower()] = int(d.utcoffset().total_seconds())
        before = now
    d = dt.datetime(2020, 1, 1, tzinfo=tz)
    names.setdefault(d.tzname().lower(), int(d.utcoffset().total_seconds()))
    return np.array(limits, "i8"), np.array(offsets, "i8"), names


def _numbers(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), "i8")
    for i in range(*span):
        out = out * 10 + (chars[:, i].astype("i8") - 48)
    return out


def _texts(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = np.ascontiguousarray(chars[:, span[0] : span[1]])
    return part.view(f"U{span[1] - span[0]}").ravel()


def _lookup(texts: np.ndarray, f) -> np.ndarray:
    """f of each distinct text once; None counts as missing."""
    keys, inv = np.unique(texts, return_inverse=True)
    got = [f(str(k).lower()) for k in keys]
    return np.array([np.nan if g is None else float(g) for g in got])[inv]


def _convert(values: list[str], zones: np.ndarray, kind: str, at: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of values of one mask, and which of them are valid."""
    n, width = len(values), len(values[0])
    chars = np.array(values, f"U{width}").view("U1").reshape(n, width).view("u4").reshape(n, width)
    text = chars.view("U1").reshape(n, width)
    if kind.startswith("epoch"):
        return _numbers(chars, at["n"]) // {"epoch_s": 1, "epoch_ms": 1000, "epoch_us": 1_000_000}[kind], np.ones(n, bool)
    get = lambda k: _numbers(chars, at[k]) if k in at else np.zeros(n, "i8")
    y, d, h, mi, s = (get(k) for k in ("y", "d", "h", "mi", "s"))
    ok = np.ones(n, bool)
    if "mon" in at:
        m = _lookup(_texts(text, at["mon"]), MONTHS.get)
        ok &= ~np.isnan(m)
        m = np.where(ok, m, 1).astype("i8")
    else:
        m = get("m")
    if "om" in at:
        ok &= np.isin(np.char.lower(_texts(text, at["om"])), ["om", "at"])
    zone_at = dict(at)
    if "ap" in at:
        half = np.char.lower(_texts(text, at["ap"]))
        is_half = np.isin(half, ["am", "pm"])
        ok &= is_half & (h >= 1) & (h <= 12)
        h = h % 12 + 12 * (half == "pm")
    ok &= (y >= 1900) & (y < 2100) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= 31) & (h < 24) & (mi < 60) & (s < 60)
    m, d, y = np.where(ok, m, 1), np.where(ok, d, 1), np.where(ok, y, 1970)
    days = ((y - 1970).astype("M8[Y]").astype("M8[M]") + (m - 1).astype("m8[M]")).astype("M8[D]") + (d - 1).astype("m8[D]")
    ok &= days.astype("M8[M]").astype("i8") == (y - 1970) * 12 + m - 1
    wall = days.astype("i8") * 86_400 + h * 3600 + mi * 60 + s
    if "off" in zone_at:
        a, b = zone_at["off"]
        digits = [i for i in range(a + 1, b) if not (text[:, i] == ":").all()]
        off = np.zeros(n, "i8")
        hh = _numbers(chars[:, digits[:2]], (0, 2))
        mm = _numbers(chars[:, digits[2:]], (0, len(digits) - 2)) if len(digits) > 2 else 0
        off = (hh * 60 + mm) * 60 * np.where(text[:, a] == "-", -1, 1)
        return wall - off, ok & (hh < 19)
    out = wall.copy()
    named = _texts(text, zone_at["zn"]) if "zn" in zone_at else None
    for zone in pd.unique(zones):
        here = zones == zone
        table = transitions(zone) if zone else None
        if named is not None:
            own = table[2] if table else {}
            off = _lookup(named[here], lambda k: own.get(k, ZONE_NAMES[k] * 60 if k in ZONE_NAMES else None))
            ok[here] &= ~np.isnan(off)
            out[here] = wall[here] - np.nan_to_num(off).astype("i8")
        elif table is None:
            ok[here] = False
        else:
            out[here] = wall[here] - table[1][np.searchsorted(table[0], wall[here], side="right")]
    return out, ok


def utc_texts(values: pd.Series, zones: pd.Series) -> pd.Series:
    """``yyyy-MM-ddTHH:mm:ssZ`` or None for each value; zones holds the zone of wall-clock times, None if unknown."""
    out = np.full(len(values), None, object)
    groups: dict[str, list[int]] = {}
    clean: list[str] = []
    for i, v in enumerate(values):
        v = " ".join(v.split()) if isinstance(v, str) else ""
        clean.append(v)
        if v:
            groups.setdefault(shape_mask(v), []).append(i)
    tz = zones.where(zones.notna(), None).to_numpy(object)
    tz = np.array([z or "" for z in tz], object)
    for mask, rows in groups.items():
        if (p := parser_for(mask)) is None:
            continue
        secs, ok = _convert([clean[i] for i in rows], tz[rows], *p)
        text = np.char.add(np.datetime_as_string(secs.astype("M8[s]"), unit="s"), "Z")
        idx = np.array(rows)
        out[idx[ok]] = text[ok]
    return pd.Series(out, dtype=object)


def to_utc(value: Column, zone: Column) -> Column:
    """Column of UTC texts; see the module's text for the results of odd values."""

    @F.pandas_udf("string")
    def convert(v: pd.Series, z: pd.Series) -> pd.Series:
        return utc_texts(v, z)

    return convert(value, zone)


def normalise(df: DataFrame, columns: dict[str, Column], suffix: str = "_utc") -> DataFrame:
    """df with a column ``<name><suffix>`` for each of columns (name to the zone of its wall-clock times). Rows and
    other columns stay as they are; an empty df gives an empty result."""
    return df.withColumns({f"{c}{suffix}": to_utc(F.col(c), z.cast("string")) for c, z in columns.items()})


def mask_census(df: DataFrame, column: str) -> DataFrame:
    """Rows per distinct mask with the parser kind it maps to (null: fixes no instant); counted before any shuffle."""

    @F.pandas_udf("string")
    def kind(masks: pd.Series) -> pd.Series:
        return masks.map(lambda m: None if m is None else (parser_for(m) or (None,))[0])

    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZéûÉÛ"
    text = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    masks = df.select(F.translate(text, "0123456789" + letters, "9" * 10 + "a" * len(letters)).alias("mask"))
    return masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).withColumn("parser", kind("mask"))
