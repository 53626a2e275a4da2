"""Evaluation texts that leaked into a corpus, by greedy string tiling.

Seeds are found by running Karp-Rabin: the polynomial hashes of all windows of ``MIN_WORDS`` words of the items are held
against those of every document, computed for a whole batch at once with numpy. Only documents that hit a seed go on:
their longest matches are marked first, then the next longest that doesn't overlap a mark, in the document or in the
item, until none of ``MIN_WORDS`` words is left. Tiles count wherever they stand, so reordered passages are caught, and
their words over the item's give the coverage.

The items are few and known; their seeds are held by every worker only while there are at most ``MAX_SEEDS`` of them,
beyond that documents and items are joined on the seeds.

Defined results: null or empty texts hold no passage; items shorter than MIN_WORDS words can't leak; a document that
stands in the corpus twice is reported twice; texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_SEEDS = 15, 2_000_000
_WORD = re.compile(r"[^\W_]+")
_MARKS = {c: None for c in range(0x300, 0x370)}
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, accents disregarded."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFD", text).translate(_MARKS)
    return _WORD.findall(text)


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows of n codes."""
    if len(codes) < n:
        return np.empty(0, "u8")
    out = np.zeros(len(codes) - n + 1, "u8")
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _BASE + codes[k : k + len(out)]
    return out


def tiles(doc: list[str], item: list[str], least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the tiles, longest first; ties go to the earliest in the document."""
    seeds: dict[tuple, list[int]] = {}
    for j in range(len(item) - least + 1):
        seeds.setdefault(tuple(item[j : j + least]), []).append(j)
    runs: list[tuple[int, int, int]] = []
    ends: dict[int, int] = {}  # of the last run on each diagonal
    for i in range(len(doc) - least + 1):
        for j in seeds.get(tuple(doc[i : i + least]), ()):
            if i >= ends.get(i - j, 0):
                n = least
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                    n += 1
                ends[i - j] = i + n - least + 1
                runs.append((i, j, n))
    out: list[tuple[int, int, int]] = []
    used_d, used_i = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    while runs:
        runs.sort(key=lambda r: (-r[2], r[0], r[1]))
        i, j, n = runs.pop(0)
        free = ~(used_d[i : i + n] | used_i[j : j + n])
        if free.all():
            used_d[i : i + n] = used_i[j : j + n] = True
            out.append((i, j, n))
            continue
        # what is left of a run between marks may still be a tile
        at = 0
        while at < n:
            if not free[at]:
                at += 1
                continue
            end = at
            while end < n and free[end]:
                end += 1
            if end - at >= least:
                runs.append((i + at, j + at, end - at))
            at = end
    return out


def _codes(ws: list[str], known: dict[str, int]) -> list[int]:
    out = []
    for w in ws:
        c = known.get(w)
        if c is None:
            c = known[w] = xxhash.xxh64_intdigest(w)
        out.append(c)
    return out


_SCHEMA = "doc bigint, item bigint, tiles int, longest int, covered int, item_words int"


def _rows(doc: int, ws: list[str], item: int, iw: list[str]) -> tuple | None:
    if t := tiles(ws, iw):
        return doc, item, len(t), t[0][2], sum(x[2] for x in t), len(iw)
    return None


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item, tiles, longest, covered, item_words) of each document that holds a passage of an item. Documents are
    read once and not shuffled."""
    it = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where(F.length(text) >= 2 * MIN_WORDS - 1)
    # runs of letters or digits, as words() has them
    n_seeds = it.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+"))), F.lit(0))).first()[0]
    if n_seeds > MAX_SEEDS:
        return _leaks_by_join(d, it)
    known: dict[str, int] = {}
    item_words = {r.item: words(r.text) for r in it.collect()}  # at most MAX_SEEDS words
    parts = [(k, window_hashes(np.array(_codes(w, known), "u8"), MIN_WORDS)) for k, w in sorted(item_words.items())]
    seeds = np.concatenate([h for _, h in parts]) if parts else np.empty(0, "u8")
    owner = np.concatenate([np.full(len(h), k) for k, h in parts]) if parts else np.empty(0, "i8")
    order = np.argsort(seeds, kind="stable")
    seeds, owner = seeds[order], owner[order]
    small = np.unique(seeds)
    # a bit table of the low 20 bits rejects nearly every window before the search
    bits = np.zeros(1 << 20, bool)
    bits[small & np.uint64((1 << 20) - 1)] = True
    share = d.sparkSession.sparkContext.broadcast((seeds, owner, small, bits, item_words))  # at most MAX_SEEDS words

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, owner, small, bits, item_words = share.value
        codes: dict[str, int] = {}
        for b in batches:
            out = []
            for doc, t in zip(b["doc"], b["text"]):
                ws = words(t)
                if len(ws) < MIN_WORDS or not len(small):
                    continue
                h = window_hashes(np.array(_codes(ws, codes), "u8"), MIN_WORDS)
                h = h[bits[h & np.uint64((1 << 20) - 1)]]
                if not len(h):
                    continue
                lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
                for item in sorted({int(o) for a, z in zip(lo, hi) for o in owner[a:z]}):
                    if r := _rows(doc, ws, item, item_words[item]):
                        out.append(r)
            if len(codes) > 500_000:
                codes.clear()
            if out:
                yield pd.DataFrame(out, columns=["doc", "item", "tiles", "longest", "covered", "item_words"])

    return d.mapInPandas(scan, _SCHEMA)


def _leaks_by_join(d: DataFrame, it: DataFrame) -> DataFrame:
    """The way for item sets too large to hold: both sides as seed hashes, joined on the seed, then tiled."""

    def seed_rows(name: str):
        def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, hs = [], []
                for k, t in zip(b[name], b["text"]):
                    h = np.unique(window_hashes(np.array(_codes(words(t), {}), "u8"), MIN_WORDS)).view("i8")
                    ids.append(np.full(len(h), k)), hs.append(h)
                if ids:
                    yield pd.DataFrame({name: np.concatenate(ids), "seed": np.concatenate(hs)}).astype("int64")

        return f

    s_items = it.mapInPandas(seed_rows("item"), "item bigint, seed bigint")
    s_docs = d.mapInPandas(seed_rows("doc"), "doc bigint, seed bigint")
    pairs = s_docs.join(s_items, "seed").select("doc", "item").distinct()
    full = pairs.join(d, "doc").join(it.withColumnRenamed("text", "item_text"), "item")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for doc, t, k, i in zip(b["doc"], b["text"], b["item"], b["item_text"]) if (r := _rows(doc, words(t), k, words(i)))]
            if out:
                yield pd.DataFrame(out, columns=["doc", "item", "tiles", "longest", "covered", "item_words"])

    return full.select("doc", "text", "item", "item_text").mapInPandas(tile, _SCHEMA)
