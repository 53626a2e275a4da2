"""Visually identical text to one consistent form.

Ignorable characters are deleted, compatibility forms and separate accents are composed, and every token that holds a
look-alike letter becomes a lattice: each position may keep its character or take the Latin letter that it looks like.
Viterbi finds the best path under character bigrams of the corpus (for Latin), a flat score per letter (for other
scripts) and a charge for each change of script, so a word stays in one script. Values without any character outside
the ordinary ones never leave the JVM.

Defined results: null stays null, empty stays empty; plain other spellings (case, doubled spaces) are left alone;
typographic quotes, dashes, ellipses, fractions, currency signs, emoji with their joiners and words meant in another
script are left alone. A value of any length is processed whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d",
    "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ё": "ë", "ї": "ï", "г": "r", "в": "b", "к": "k", "м": "m", "т": "t", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ё": "Ë", "Ї": "Ï", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "ү": "y",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "τ": "t", "η": "n", "ω": "w", "ε": "e", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian and letters kept for phonetics
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ɡ": "g", "ɑ": "a", "ı": "i", "ʏ": "y", "ɩ": "i", "ꜱ": "s",
}
# Signs that look like an ordinary punctuation mark.
SIGNS = {
    "‐": "-", "‑": "-", "−": "-", "﹣": "-", "⁃": "-", ";": ";", "։": ":", "∶": ":", "꞉": ":", "․": ".", "∕": "/",
    "ǃ": "!", "ʼ": "'", "ˈ": "'", "‚": ",", "٫": ",", "∗": "*", "﹡": "*", "❘": "|", "ǀ": "|", "‹": "‹", "›": "›",
}
SIGNS = {k: v for k, v in SIGNS.items() if k != v and k != "‚"}
# Characters that are ordinary though they have a compatibility form, or look unusual.
ORDINARY = set("‘’‚‛“”„‟«»‹›–—―…½¼¾⅓⅔⅛€£¥¢§°•·†‡™®©ªº¹²³´¨¸µ№′″")
IGNORABLE = set("\u00ad\u200b\u200c\u200d\u2060\u2061\u2062\u2063\u2064\ufeff\u180e\u034f\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u061c\u115f\u1160\u3164\uffa0\ufe00\ufe01\ufe0e\ufe0f")
#: What may stay in the JVM: ASCII, composed Latin letters, common typographic signs.
PLAIN = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ‘’‚“”„«»–—…€£½¼¾°•]*$"
SWITCH, SWAP, FOREIGN = 6.0, 0.5, math.log(60)

_TOKEN = re.compile(r"[^\W\d_]+(?:[^\W_]*)")


def _emoji(c: str) -> bool:
    return c > "←" and (unicodedata.category(c) in ("So", "Sk") or "\U0001f3fb" <= c <= "\U0001f3ff")


def fold_compatibility(v: str) -> str:
    """v without ignorable characters, with compatibility forms of Latin text and separate accents composed."""
    out: list[str] = []
    for i, c in enumerate(v):
        if c in IGNORABLE:
            prev, nxt = v[i - 1 : i], v[i + 1 : i + 2]
            if c == "\u200d" and prev and nxt and (_emoji(prev) or prev == "\ufe0f") and _emoji(nxt) or c == "\ufe0f" and prev and _emoji(prev):
                out.append(c)
            continue
        if c < "\u0080" or c in ORDINARY:
            out.append(c)
        elif unicodedata.category(c) in ("Zs", "Zl", "Zp"):
            out.append(" ")
        elif c in SIGNS:
            out.append(SIGNS[c])
        elif unicodedata.decomposition(c).startswith("<"):
            out.append(unicodedata.normalize("NFKC", c))
        else:
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def _script(c: str) -> int:
    if c < "ɐ" or "Ḁ" <= c <= "ỿ":
        return 0
    return 1 + ord(c) // 256


def best_path(token: str, bigrams: dict[str, float]) -> str:
    """The Viterbi path of a token through its look-alike lattice; bigrams: -log P(b|a) of lower-case pairs."""
    floor = bigrams["?"]
    lattice = [[(c, 0.0)] + ([(LOOKALIKES[c], SWAP)] if c in LOOKALIKES else []) for c in token]
    states: list[tuple[float, str, tuple]] = [(0.0, "^", ())]
    for options in lattice:
        nxt = []
        for c, charge in options:
            s, low = _script(c), c.lower()
            best = None
            for cost, prev, path in states:
                ps = s if prev == "^" else _script(prev)
                step = (SWITCH if ps != s else 0.0) + charge
                step += FOREIGN if s else bigrams.get((prev.lower() if ps == 0 or prev == "^" else "^") + low, floor)
                if best is None or cost + step < best[0]:
                    best = (cost + step, c, (path, c))
            nxt.append(best)
        states = nxt
    ends = [(cost + (0.0 if _script(c) else bigrams.get(c.lower() + "$", floor)), path) for cost, c, path in states]
    path = min(ends, key=lambda x: x[0])[1]
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def consistent(v: str | None, bigrams: dict[str, float]) -> str | None:
    """The consistent form of one value."""
    if not v or v.isascii():
        return v
    v = fold_compatibility(v)
    return _TOKEN.sub(lambda m: best_path(m[0], bigrams) if any(c in LOOKALIKES for c in m[0]) else m[0], v)


def letter_bigrams(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """-log P(b|a) of the lower-case Latin letter pairs of all values, with ^ and $ for the ends of words. Counted in
    every partition first; at most 400 x 400 pairs (letters below U+0180) reach the driver, whatever the input."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(400 * 400, "i8")
        for b in batches:
            text = " ".join(" ".join(x for x in b[c] if x) for c in b.columns).lower()
            a = np.frombuffer((" " + text + " ").encode("utf-32-le"), "u4").astype("i8")
            letter = ((a >= 97) & (a <= 122)) | ((a >= 0xDF) & (a < 0x180) & (a != 0xF7))
            other = (a > 127) & ~letter
            a = np.where(letter, a, np.where(other, 399, 0))
            pairs = a[:-1] * 400 + a[1:]
            total += np.bincount(pairs[(a[:-1] != 399) & (a[1:] != 399)], minlength=160_000)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"pair": k, "n": total[k]})

    rows = df.select(*columns).mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts: dict[tuple[int, int], int] = {divmod(r.pair, 400): r.n for r in rows if r.pair}
    first: dict[int, int] = {}
    for (a, _), n in counts.items():
        first[a] = first.get(a, 0) + n
    out = {(chr(a) if a else "^") + (chr(b) if b else "$"): -math.log((n + 0.1) / (first[a] + 20)) for (a, b), n in counts.items()}
    return out | {"?": 9.0}


def consistent_column(value: Column, bigrams: dict[str, float]) -> Column:
    @F.pandas_udf("string")
    def form(v: pd.Series) -> pd.Series:
        known: dict = {}
        for x in v:
            if x not in known:
                known[x] = consistent(x, bigrams)
        return v.map(known)

    return form(value)


def to_consistent(df: DataFrame, columns: list[str], suffix: str = "_form") -> DataFrame:
    """df with ``<name><suffix>`` for each column. Only values with unusual characters go through Python."""
    bigrams = letter_bigrams(df, columns)
    odd = df
    for c in columns:
        odd = odd.withColumn(f"{c}{suffix}", consistent_column(F.when(~F.col(c).rlike(PLAIN), F.col(c)), bigrams))
    return odd.withColumns({f"{c}{suffix}": F.when(F.col(c).rlike(PLAIN), F.col(c)).otherwise(F.col(f"{c}{suffix}")) for c in columns})


def lookalike_fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field) of each value that the consistent form changes."""
    bigrams = letter_bigrams(df, columns)
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x"))
    odd = long.select(key, "x.field", "x.value").where(~F.col("value").rlike(PLAIN))
    return odd.where(consistent_column(F.col("value"), bigrams) != F.col("value")).select(key, "field")
