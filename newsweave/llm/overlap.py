"""Pairs of texts whose similarity can reach a threshold, by the rarest words of their units.

The words of a unit (a sentence) stand in one order that holds for all texts, from rare to frequent. Its keys are the
sets of ``TOGETHER`` of its first ``FIRST`` words. An edit takes at most one word out of a unit and puts one in, so after
an edit four of the first five words are still among them: units within one edit of each other share a key. Texts that
share keys meet if the units in which they do hold ``SHARE`` of the longer one's runs, and are verified. At a similarity
of 0.5 a text has at most one edit in nine words; a unit of up to 26 words escapes if it has two or more, and a pair of
texts only if nearly all of its units do (figures in the README).

No key is left out for being shared by many. A text leaves out its most frequent units only while what it leaves out is
under ``LEFT_OUT`` of its runs, so units that a third of all texts share are looked at only in texts that consist of
such units for the most part. What is frequent is counted in all texts, in tables of fixed size: words and keys that
fall into one slot are counted together, which can change the order and what is left out, but drops no text or key.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.texts import flat_codes, run_counts, runs, shared

#: Slots that the words and keys of all texts are counted in, and slots that are summed at once.
WORD_SLOTS, KEY_SLOTS, BLOCK = 1 << 20, 1 << 22, 1 << 14
#: A word or key is frequent if it stands LEAST times or more, and once in RARE or SHARED texts; rare words are in no order of
#: frequency, or words that are new to the history would always come first.
LEAST, RARE, SHARED = 3, 6_000, 1_000
FIRST, TOGETHER, LEFT_OUT, SHARE = 5, 4, 0.4, 0.1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Order(NamedTuple):
    """Slots of frequent words and keys, each sorted, and how often they stand in all texts."""

    words: np.ndarray
    word_counts: np.ndarray
    keys: np.ndarray
    key_counts: np.ndarray


def _slots(of: np.ndarray, slots: int) -> np.ndarray:
    return of.view("u4") & np.uint32(slots - 1)


def _dense(order: Order) -> np.ndarray:
    """How often the frequent words stand, by slot."""
    out = np.zeros(WORD_SLOTS, "u8")
    out[order.words] = order.word_counts
    return out


def _counts(of: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(of), "i8")
    at = np.minimum(np.searchsorted(known, of), len(known) - 1)
    return np.where(known[at] == of, counts[at], 0)


def unit_keys(codes: list[np.ndarray], often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the text and the unit of each, and the words of each unit, of many texts at once. often: how often frequent
    words stand, by slot."""
    flat, text = flat_codes(codes)
    unit = np.concatenate([[0], np.cumsum(flat == 0)[:-1]])
    word = flat != 0
    flat, text, unit = flat[word], text[word], unit[word]
    size = np.bincount(unit)
    u = flat.view("u4").astype("u8")
    with np.errstate(over="ignore"):
        rank = (often[_slots(flat, WORD_SLOTS)] << np.uint64(32)) | (u * _MIX >> np.uint64(32))
    at = np.lexsort((rank, unit))
    unit, rank, u, text = unit[at], rank[at], u[at], text[at]
    new = np.concatenate([[True], (unit[1:] != unit[:-1]) | (rank[1:] != rank[:-1])])
    unit, u, text = unit[new], u[new], text[new]
    begin = np.concatenate([[True], unit[1:] != unit[:-1]])
    start = np.flatnonzero(begin)
    many = np.diff(np.append(start, len(unit)))
    keys, texts, units = [], [], []
    sets = [(c, many > c[-1]) for c in itertools.combinations(range(FIRST), TOGETHER)]
    sets += [(c, (many > c[-1]) & (many < FIRST)) for c in itertools.combinations(range(FIRST - 1), 2)]
    for places, has in sets:
        s = start[has]
        h = np.zeros(len(s), "u8")
        with np.errstate(over="ignore"):
            for x in np.sort(np.stack([u[s + i] for i in places]), axis=0):
                h = ((h ^ x) + np.uint64(len(places))) * _MIX
                h ^= h >> np.uint64(29)
        keys.append((h >> np.uint64(32)).astype("u4").view("i4")), texts.append(text[s]), units.append(unit[s])
    return np.concatenate(keys), np.concatenate(texts), np.concatenate(units), size


def _packed(n: np.ndarray) -> bytes:
    """Counts of a block in the fewest bytes each, compressed; most are 0 or 1."""
    kind = next(k for k in ("u1", "u2", "u4") if n.max() <= np.iinfo(k).max)
    return zlib.compress(n.astype(kind).tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    raw = zlib.decompress(b)
    return np.frombuffer(raw, f"u{len(raw) // BLOCK}").astype("i8")


def _census(rows: DataFrame, values, slots: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the values of all rows of codes that stand least times or more, and how often they do; values: those
    of a list of codes. A partition is counted in a table of fixed size before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(slots, "u4")
        for b in batches:
            if len(b):
                n += np.bincount(_slots(values(list(b["codes"])), slots), minlength=slots).astype("u4")
        blocks = n.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        if len(some):
            yield pd.DataFrame({"block": some.astype("i4"), "n": [_packed(blocks[i]) for i in some]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, n in zip(b["block"], b["n"]):
                x = _unpacked(n)
                sums[block] = sums[block] + x if block in sums else x
        for block, n in sums.items():
            at = np.flatnonzero(n >= least)
            yield pd.DataFrame({"v": (at + block * BLOCK).astype("i4"), "c": n[at]})

    parts = rows.select("codes").mapInPandas(count, "block int, n binary").repartition("block")
    top = parts.mapInPandas(total, "v int, c bigint").toPandas()  # at most as many rows as slots
    at = np.argsort(top["v"].to_numpy("i4"))
    return top["v"].to_numpy("i4")[at], top["c"].to_numpy("i8")[at]


def frequent(rows: DataFrame) -> Order:
    """The order, counted in all rows (codes)."""
    texts = rows.count()
    words = _census(rows, lambda cs: (c := flat_codes(cs)[0])[c != 0], WORD_SLOTS, max(LEAST, texts // RARE))
    often = rows.sparkSession.sparkContext.broadcast(_dense(Order(*words, *words)))  # WORD_SLOTS numbers
    return Order(*words, *_census(rows, lambda cs: unit_keys(cs, often.value)[0], KEY_SLOTS, max(LEAST, texts // SHARED)))


SEGMENTS = "key int, text bigint, n int, unit int, size int"


def segments(rows: DataFrame, by: str, order: Order) -> DataFrame:
    """SEGMENTS of rows (by, codes): the keys of each text, its number of runs, the key's unit (its place in the text)
    and the unit's words."""
    table = rows.sparkSession.sparkContext.broadcast(order)  # WORD_SLOTS and KEY_SLOTS entries at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = table.value
        often = _dense(order)
        for b in batches:
            if not len(b):
                continue
            codes = list(b["codes"])
            key, text, unit, size = unit_keys(codes, often)
            if not len(key):
                continue
            of = np.full(len(size), -1)
            of[unit] = text
            n = run_counts(codes)
            kept = np.ones(len(size), bool)
            hot = np.full(len(size), np.iinfo("i8").max)
            np.minimum.at(hot, unit, _counts(_slots(key, KEY_SLOTS), order.keys, order.key_counts))
            some = np.flatnonzero((of >= 0) & (hot > 0))
            if len(some):  # of each text the most frequent units, as long as they are under LEFT_OUT of it
                some = some[np.lexsort((-hot[some], of[some]))]
                upto = np.cumsum(size[some])
                first = np.concatenate([[True], of[some][1:] != of[some][:-1]])
                before = np.maximum.accumulate(np.where(first, upto - size[some], 0))
                kept[some[upto - before <= LEFT_OUT * n[of[some]]]] = False
            place = np.arange(len(size)) - np.concatenate([[0], np.cumsum(np.bincount(of[of >= 0], minlength=len(codes)))])[np.maximum(of, 0)]
            k = kept[unit]
            text, key, unit = text[k], key[k], unit[k]
            at = np.lexsort((unit, key, text))
            text, key, unit = text[at], key[at], unit[at]
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])[: len(key)]
            text, key, unit = text[new], key[new], unit[new]
            out = {"key": key, "text": b["text"].to_numpy("i8")[text], "n": n[text], "unit": place[unit], "size": size[unit]}
            yield pd.DataFrame({c: v.astype("i8" if c == "text" else "i4") for c, v in out.items()})

    return rows.select(F.col(by).alias("text"), "codes").mapInPandas(run, SEGMENTS)


def _met(left: DataFrame, right: DataFrame, ordered: bool, t: float) -> DataFrame:
    """(a, b): texts of the joined sides whose common units are long enough; ordered: only a < b. The columns keep their
    names up to the join: the sides of a self-join are one plan then, and share a shuffle."""
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    different = l("text") < r("text") if ordered else l("text") != r("text")
    sizes = F.least(l("n"), r("n")) >= t * F.greatest(l("n"), r("n")) - 1e-6
    units = F.abs(l("size") - r("size")) <= 1
    met = left.alias("l").join(right.alias("r"), l("key") == r("key")).where(different & sizes & units)
    met = met.select(l("text").alias("a"), r("text").alias("b"), l("unit").alias("unit"), r("unit").alias("ub"), l("size").alias("sa"), F.greatest(l("n"), r("n")).alias("n"))
    # by both units, so that both sides of a self-join need the same columns and read one shuffle
    each = met.repartition("a", "b").groupBy("a", "b", "unit", "ub").agg(F.max("sa").alias("sa"), F.max("n").alias("n"))
    whole = each.groupBy("a", "b").agg(F.sum("sa").alias("s"), F.max("n").alias("n"))
    return whole.where(F.col("s") >= SHARE * F.col("n")).select("a", "b")


def within_one(each: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b: all pairs of texts of one table of segments that meet."""
    return _met(each, each, True, t)


def between(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(a, b), a <> b: all pairs of two tables of segments that meet."""
    return _met(left, right, False, t)


def stored(order: Order, spark) -> DataFrame:
    """The order as a table (kind, v, c)."""
    both = [("w", order.words, order.word_counts), ("k", order.keys, order.key_counts)]
    rows = pd.concat([pd.DataFrame({"kind": kind, "v": v, "c": c}) for kind, v, c in both])
    return spark.createDataFrame(rows, "kind string, v int, c bigint")


def read(table: DataFrame) -> Order:
    """What ``stored`` wrote; at most WORD_SLOTS and KEY_SLOTS rows."""
    t = table.orderBy("v").toPandas()
    of = lambda kind, c, dtype: t.loc[t["kind"] == kind, c].to_numpy(dtype)
    return Order(of("w", "v", "i4"), of("w", "c", "i8"), of("k", "v", "i4"), of("k", "c", "i8"))


def verified(pairs: DataFrame, t: float) -> DataFrame:
    """(a, b, sim) of pairs (a, b, ca, cb) whose exact similarity reaches the threshold: the runs to take out of or put
    into one text to get the other's are at most ``(1 - t) / (1 + t)`` of both texts' runs."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets: dict[int, np.ndarray] = {}
            sims = []
            for a, c, ca, cb in zip(b["a"], b["b"], b["ca"], b["cb"]):
                x = sets[a] if a in sets else sets.setdefault(a, runs(ca))
                y = sets[c] if c in sets else sets.setdefault(c, runs(cb))
                both = shared(x, y)
                sims.append(both / (len(x) + len(y) - both))
            out = pd.DataFrame({"a": b["a"], "b": b["b"], "sim": sims})
            out = out[out["sim"] >= t]
            if len(out):
                yield out

    return pairs.select("a", "b", "ca", "cb").mapInPandas(verify, "a bigint, b bigint, sim double")
