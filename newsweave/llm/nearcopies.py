"""Near-copies with small edits.

Bodies with equal words are one class and go through once. Classes meet by keys of the rarest words of their sentences
(``overlap``), several keys a sentence, of which one survives an edit anywhere in it. Pairs are verified by exact
similarity.

The keys aren't Golay codeword indices: an edit of a sentence flips up to two bits of its fingerprint, and what gives a
common index then, six indices a segment and pairs of three segments for 24 bits of selectivity, is 108 keys a sentence
instead of five (README).

Defined results: a row without a body, or with fewer than three words, is similar to none and is a group of its own;
repeated rows are similar with 1.0; null keys are dropped; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm import boilerplate, overlap, texts
from newsweave.session import cut, spread, written

THRESHOLD = 0.5


def encoded(df: DataFrame, key: str, full_text: str = "full_text", summary: str = "summary", host: str = "feed_key") -> DataFrame:
    """(key, body, codes) of each row with three words or more: the class of its body and its words. One pass in Python,
    no shuffle, after a pass that counts the lines of pages."""
    df, held = boilerplate.marked(df, host, full_text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        page = boilerplate.Reader(held.value)
        for b in batches:
            ids, codes = [], []
            for i, f, s, drop in zip(b["key"], b["f"], b["s"], b["_drop"]):
                c = texts.encode(texts.body_of(f, s, lambda t: page(t, drop)), known)  # noqa: B023
                if len(c) > 3:
                    ids.append(i), codes.append(c)
            if ids:
                yield pd.DataFrame({"key": ids, "body": [texts.body_key(c) for c in codes], "codes": codes})

    kind = dict(df.dtypes)[key]
    rows = spread(df.select(F.col(key).alias("key"), F.col(full_text).alias("f"), F.col(summary).alias("s"), "_drop").where(F.col(key).isNotNull()))
    return rows.mapInPandas(run, f"key {kind}, body bigint, codes array<int>")


def _classes(rows: DataFrame) -> DataFrame:
    """One row of each class. The others are taken out by their keys: where copies are few that is a small table, which
    Spark broadcasts, and the wide rows aren't shuffled; else they are, so the result is to be written and read back."""
    first = rows.groupBy("body").agg(F.min("key").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("body", "m")
    copies = rows.select("key", "body").join(first, "body").where(F.col("key") != F.col("m")).select("key").distinct()
    return rows.join(copies, "key", "left_anti")


def members_and_pairs(rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(key, body) of all rows, and (a, b, sim) of the classes whose exact similarity reaches the threshold, each pair
    once. rows: a written table, deleted when its classes are written. Classes are named by their row's key while they
    meet: ascending numbers, which a shuffle packs better than hashes."""
    name = "key" if dict(rows.dtypes)["key"] in ("tinyint", "smallint", "int", "bigint") else "body"
    # several passes read the classes; what they are made from is shuffled once for all of them
    classes = written(_classes(rows).select(F.col(name).cast("bigint").alias("text"), "body", "codes"))
    members = written(rows.select("key", "body"), rows)
    segments = written(overlap.segments(classes, "text", overlap.frequent(classes)))  # read back, both sides of the join share one shuffle
    pairs = written(overlap.within_one(segments, threshold), segments)
    side = lambda s: classes.select(F.col("text").alias(f"n{s}"), F.col("body").alias(s), F.col("codes").alias(f"c{s}"))
    # both sides are one plan and share a shuffle
    both = pairs.toDF("na", "nb").join(side("a"), "na").join(side("b"), "nb")
    return members, overlap.verified(both, threshold)


def row_pairs(df: DataFrame, key: str = "row_id", threshold: float = THRESHOLD) -> DataFrame:
    """(row_a, row_b), row_a < row_b: every pair of rows whose bodies reach the threshold. The pairs of classes are
    found first; only here are copies written out, as the result's form asks for."""
    member, pairs = members_and_pairs(written(encoded(df, key)), threshold)
    links = pairs.select("a", "b")
    far = links.join(member.select(F.col("key").alias("x"), F.col("body").alias("a")), "a").join(member.select(F.col("key").alias("y"), F.col("body").alias("b")), "b").select("x", "y")
    same = member.alias("l").join(member.alias("r"), (F.col("l.body") == F.col("r.body")) & (F.col("l.key") < F.col("r.key"))).select(F.col("l.key").alias("x"), F.col("r.key").alias("y"))
    return far.unionAll(same).select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))


def groups(df: DataFrame, key: str = "row_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, group_id, class_rows, links): the smallest key of a row's group (rows linked over any number of steps),
    the rows with the same words, and the number of other texts it is linked to. One row per row of df."""
    rows, pairs = members_and_pairs(written(encoded(df, key)), threshold)
    links = written(pairs.select("a", "b"))
    classes = rows.groupBy("body").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("class_rows"))
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    label = cut(classes.join(degree, classes["body"] == degree["a"], "left").select("body", "rep", "class_rows", F.coalesce("links", F.lit(0)).alias("links"), F.col("rep").alias("g")))
    last = label
    while True:
        near = both.join(label.select(F.col("body").alias("b"), F.col("g").alias("h")), "b").groupBy("a").agg(F.min("h").alias("h"))
        step = label.join(near, label["body"] == near["a"], "left").select("body", "rep", "class_rows", "links", "g", F.least("g", "h").alias("m"))
        # follow the group's own representative as well, which halves the way to the smallest key
        jump = step.select(F.col("rep").alias("m"), F.col("m").alias("j"))
        step = cut(step.join(jump, "m", "left").select("body", "rep", "class_rows", "links", "g", F.least("m", "j").alias("m")), last)
        last = step
        moved = step.where(F.col("m") < F.col("g")).limit(1).count()
        label = step.select("body", "rep", "class_rows", "links", F.col("m").alias("g"))
        if not moved:
            break
    linked = rows.join(label, "body").select("key", F.col("g").alias("group_id"), "class_rows", "links")
    all_rows = df.select(F.col(key).alias("key")).where(F.col(key).isNotNull())
    out = all_rows.join(linked, "key", "left")
    return out.select(F.col("key").alias(key), F.coalesce("group_id", "key").alias("group_id"), F.coalesce("class_rows", F.lit(1)).alias("class_rows"), F.coalesce("links", F.lit(0)).alias("links"))
