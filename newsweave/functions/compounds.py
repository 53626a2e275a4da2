"""Compounds and hashtags split into known words, by the cheapest way through word costs.

Null and empty compounds give no words; a compound without any known word comes back whole; ties go to fewer words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in the table of costs, the most frequent ones; the longest word that is tried.
WORDS, LONGEST = 50_000, 30


def word_costs(counts: DataFrame, most: int = WORDS) -> dict[str, float]:
    """Costs of the most frequent words from (term, n): -log of their share. At most ``most`` rows are held."""
    top = counts.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(most).toPandas()
    whole = float(top["n"].sum())
    return {t: math.log(whole) - math.log(n) for t, n in zip(top["term"], top["n"])}


def cheapest(word: str, costs: dict[str, float], per_letter: float = 10.0) -> list[str]:
    """The split of a lower-case word with the least cost; a letter of no known word costs ``per_letter``."""
    best = [(0.0, 0, 0)]
    for i in range(1, len(word) + 1):
        ways = [(best[i - 1][0] + per_letter, best[i - 1][1] + 1, 1)]
        for k in range(1, min(LONGEST, i) + 1):
            c = costs.get(word[i - k : i])
            if c is not None:
                ways.append((best[i - k][0] + c, best[i - k][1] + 1, k))
        best.append(min(ways))
    out: list[str] = []
    i = len(word)
    unknown = ""
    while i:
        k = best[i][2]
        piece = word[i - k : i]
        if k == 1 and piece not in costs:
            unknown = piece + unknown
        else:
            if unknown:
                out.append(unknown)
                unknown = ""
            out.append(piece)
        i -= k
    return [*([unknown] if unknown else []), *out[::-1]]


def split_compound(c: Column, costs: dict[str, float], df: DataFrame) -> Column:
    """The words of a compound without its sign, as an array; df: any frame of the session."""
    share = df.sparkSession.sparkContext.broadcast(costs)  # at most WORDS entries

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, list[str]] = {}
        for v in batches:
            out = []
            for s in v:
                w = (s or "").lstrip("#@").lower()
                if w not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[w] = cheapest(w, share.value) if w else []
                out.append(memo[w])
            yield pd.Series(out)

    return split(c)
