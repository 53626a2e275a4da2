"""Vocabulary, TF-IDF and keywords, in long form (document, term, weight); nothing is dense and nothing is collected.

Documents without terms have no rows; scores are rounded before they are ranked, ties go to the term's order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.session import dropped, written

#: Frequent words that are held at once; beyond them, runs are counted by shuffling them all.
HELD = 200_000


def term_counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf). The document count is kept beside it by the caller where idf is needed."""
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, most: int = 10_000) -> DataFrame:
    """(term, n): the most frequent terms of the corpus."""
    return counts.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(most)


def tfidf(counts: DataFrame, key: str, n_docs: DataFrame, smooth: bool = False) -> DataFrame:
    """(key, term, w): L2-normalised; idf log10(N/df), or smooth: ln((1+N)/(1+df))+1. n_docs: one row with column n."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = n_docs.first()["n"]  # one number
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1 if smooth else F.log10(F.lit(float(max(n, 1))) / F.col("df"))
    w = counts.join(df, "term").withColumn("w", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", F.coalesce(F.try_divide("w", F.nullif(norm, F.lit(0.0))), F.lit(0.0)).alias("w"))


def _runs(words: pa.ListArray, known: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, run) of all runs of 1 to ``most`` known words; a run is a number of ``most`` digits, one a word, 0 for none."""
    code = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype("i8") + 1
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    base, ok, run, rows, runs = len(known) + 1, code > 0, np.zeros(len(code), "i8"), [], []
    for n in range(most):
        if n:  # longer by the word n places on, of the same row
            ok, run = ok[:-1] & (code[n:] > 0) & (row[n:] == row[: len(row) - n]), run[:-1]
        run = run + code[n:] * base ** (most - 1 - n)
        rows.append(row[: len(row) - n][ok])
        runs.append(run[ok])
    return np.concatenate(rows), np.concatenate(runs)


def frequent_runs(df: DataFrame, words: str, longest: int, most: int) -> list[str]:
    """The most frequent runs of 1 to ``longest`` words of the corpus, ties in the run's order. A run among them is made of
    words that are each at least as frequent as the last of the most frequent words: only such runs are counted."""
    counts = written(df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    least = counts.orderBy(F.desc("n")).limit(most).agg(F.min("n").alias("n")).first()["n"] or 0
    known = [r.term for r in counts.where(F.col("n") >= least).limit(HELD + 1).collect()]
    dropped(counts)
    if len(known) > HELD:
        from newsweave.functions.text import ngrams

        every = df.select(F.explode(ngrams(F.col(words), 1, longest)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
        return [r.term for r in vocabulary(every, most).collect()]

    def count(batches):
        held = pa.array(known, pa.string())
        base = len(known) + 1
        for b in batches:
            run, n = np.unique(_runs(b.column(0), held, longest)[1], return_counts=True)
            digits = [run // base ** (longest - 1 - i) % base for i in range(longest)]
            parts = [held.take(pa.array(d - 1, mask=d == 0)) for d in digits]
            yield pa.record_batch([pc.binary_join_element_wise(*parts, " ", null_handling="skip"), pa.array(n)], ["term", "tf"])

    return [r.term for r in vocabulary(df.select(words).mapInArrow(count, "term string, tf long"), most).collect()]


def run_vectors(df: DataFrame, key: str, words: str, longest: int = 3, most: int = 1000) -> tuple[DataFrame, list[str]]:
    """(key, t, w) and the terms: what ``tfidf`` with smooth gives for the runs of words among the most frequent ones, with
    arrays of places in the list of terms and of weights, one row a key. Counts are made within a row, so that only keys
    with several rows are shuffled. Rows without a key count, but aren't returned."""
    df = df.select(key, words)
    terms = frequent_runs(df, words, longest, most)
    known = sorted({w for t in terms for w in t.split(" ")})
    place = {w: i + 1 for i, w in enumerate(known)}
    base = len(known) + 1
    codes = np.array([sum(place[w] * base ** (longest - 1 - i) for i, w in enumerate(t.split(" "))) for t in terms], "i8")
    kind = df.schema[key].dataType.simpleString()

    def count(batches):
        held, order = pa.array(known, pa.string()), np.argsort(codes)
        for b in batches:
            row, run = _runs(b.column(1), held, longest)
            at = np.minimum(np.searchsorted(codes[order], run), max(len(codes) - 1, 0))
            hit = codes[order][at] == run if len(codes) else np.zeros(0, bool)
            each, tf = np.unique(row[hit] * max(len(codes), 1) + order[at[hit]], return_counts=True)
            row, t = each // max(len(codes), 1), each % max(len(codes), 1)
            at = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(at, pa.array(t, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))], [key, "t", "tf"])

    counts = written(df.mapInArrow(count, f"{key} {kind}, t array<int>, tf array<int>"))
    n = counts.count()
    several = counts.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k")
    if several.limit(1).count():
        same = F.col(key).eqNullSafe(F.col("_k"))
        each = counts.join(several, same, "left_semi").select(key, F.explode_outer(F.arrays_zip("t", "tf")).alias("x")).groupBy(key, "x.t").agg(F.sum("x.tf").cast("int").alias("tf"))
        pairs = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "tf"))))
        one = each.groupBy(key).agg(pairs.alias("x")).select(key, F.col("x.t").alias("t"), F.col("x.tf").alias("tf"))
        counts = written(counts.join(several, same, "left_anti").unionByName(one), counts)
    df_of = np.zeros(len(terms))
    for r in counts.select(F.explode("t").alias("t")).groupBy("t").count().collect():
        df_of[r.t] = r["count"]
    idf = np.log((1.0 + n) / (1.0 + df_of)) + 1

    def weigh(batches):
        for b in batches:
            t, tf = b.column(1), b.column(2)
            w = tf.flatten().to_numpy(zero_copy_only=False) * idf[t.flatten().to_numpy(zero_copy_only=False)]
            lens = pc.list_value_length(t).to_numpy(zero_copy_only=False)
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(lens)), lens), w * w, len(lens)))
            at = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
            w = pa.ListArray.from_arrays(at, pa.array(w / np.repeat(norm, lens)))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(at, t.flatten()), w], [key, "t", "w"])

    return counts.where(F.col(key).isNotNull()).mapInArrow(weigh, f"{key} {kind}, t array<int>, w array<double>"), terms


def top_terms(weights: DataFrame, key: str, k: int = 10, digits: int = 9) -> DataFrame:
    """(key, rank, term, w): at most k terms of each document, zero weights left out."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round("w", digits)), "term")
    r = weights.where(F.round("w", digits) > 0).withColumn("rank", F.row_number().over(order))
    return r.where(F.col("rank") <= k).select(key, "rank", "term", F.round("w", 6).alias("w"))


def global_top(top: DataFrame, k: int = 20) -> DataFrame:
    s = top.groupBy("term").agg(F.round(F.sum("w"), 6).alias("score"), F.count(F.lit(1)).alias("mentions"))
    return s.orderBy(F.desc("score"), F.desc("mentions"), "term").limit(k)


def trend(mentions: DataFrame, word: str, month: str, focus: list[str] | None = None, roll: int = 3) -> DataFrame:
    """(word, month, n, share, rolling, share_rolling) over the grid of words and of months in which some word occurs.
    The share is of the month's mentions of all words; rolling means are over rows, from one row on."""
    m = mentions.where(F.col(word).isin(*focus)) if focus else mentions
    per = m.groupBy(word, month).agg(F.count(F.lit(1)).alias("n"))
    # a calendar has few months: the grid is words x months by exploding the list of months
    months = per.agg(F.array_sort(F.collect_set(month)).alias("_ms")).first()["_ms"]
    grid = per.select(word).distinct().withColumn(month, F.explode(F.array(*map(F.lit, months)))) if months else per.select(word, month)
    full = grid.join(per, [word, month], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(month))
    share = F.col("n") / F.when(total == 0, 1).otherwise(total) * 100
    back = Window.partitionBy(word).orderBy(month).rowsBetween(-(max(roll, 1) - 1), 0)
    out = full.withColumn("share", share)
    out = out.withColumns({"rolling": F.round(F.avg("n").over(back), 6), "share_rolling": F.round(F.avg("share").over(back), 6)})
    return out.withColumn("share", F.round("share", 6))
