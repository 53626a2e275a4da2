"""Merging feeds into the accepted articles: ids, first seen, cursor overlap, state, counters.

Rows without a URL are dropped; an unparseable date never drops a row; ties in (source, position) go to the row's own
order column. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.functions.text import collapse, nfkc, without_format
from newsweave.functions.urls import article_id, canonical_url


def with_ids(df: DataFrame, url: str = "url") -> DataFrame:
    c = canonical_url(F.col(url))
    return df.withColumns({"canonical_url": c, "id": article_id(c)})


def with_url(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(F.trim(F.coalesce(F.col(url), F.lit(""))) != "")


def canonical_feed(df: DataFrame, aliases: DataFrame, feed: str = "feed") -> DataFrame:
    """df with ``canonical``: the alias table's name (columns alias, canonical) of the trimmed feed, itself if it has
    none, '' for null. Aliases are few; Spark broadcasts them while they are small."""
    a = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("canonical").alias("_canonical"))
    key = F.trim(F.coalesce(F.col(feed), F.lit("")))
    return df.join(a, key == F.col("_alias"), "left").withColumn("canonical", F.coalesce("_canonical", key)).drop("_alias", "_canonical")


def fuzzy_feed(c: Column, rules: list[tuple[str, str, str]], compat: bool = True) -> Column:
    """The name of a feed's spelling: compatibility forms, no format characters, single blanks; then the first rule
    (``starts`` or ``has``, what, name) that holds without regard to case, else the spelling itself."""
    s = collapse(without_format(nfkc(c) if compat else c))
    low, out = F.lower(s), F.lit(None).cast("string")
    for how, what, name in reversed(rules):
        hit = F.startswith(low, F.lit(what)) if how == "starts" else F.contains(low, F.lit(what))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.coalesce(out, s)


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order. Aggregated before the shuffle, so a hot key costs a row a task."""
    rest = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    if any(k.startswith("map") for _, k in df.dtypes):
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return df.groupBy(key).agg(F.min(rest).alias("_m")).select("_m._row.*")


def unseen(df: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


def within_overlap(df: DataFrame, cursors: DataFrame, source: str, ts: Column, cursor: Column, hours: int = 24) -> DataFrame:
    """Rows not older than the source's cursor less the overlap; a row without a date or a cursor is kept."""
    c = cursors.select(F.col(source).alias("_s"), cursor.alias("_cursor"))
    j = df.join(c, df[source] == F.col("_s"), "left")
    old = ts < F.col("_cursor") - F.expr(f"interval {hours} hours")
    return j.where(~F.coalesce(old, F.lit(False))).drop("_s", "_cursor")


def next_state(state: DataFrame, kept: DataFrame, source: str, ts: Column, literal: bool = False) -> DataFrame:
    """(source, cursor, added): the cursor after a run. literal: it may move backwards."""
    new = kept.groupBy(source).agg(F.max(ts).alias("_new"), F.count(F.lit(1)).alias("added"))
    j = state.join(new, source, "full_outer")
    cursor = F.coalesce("_new", "cursor") if literal else F.greatest("_new", "cursor")
    return j.select(source, cursor.alias("cursor"), F.coalesce("added", F.lit(0)).alias("added"))


def run_state(state: DataFrame, kept: DataFrame, source: str, ts: Column, run_ts: Column, files: DataFrame | None = None) -> DataFrame:
    """``next_state`` with the time of the run and, from files (source, last_file), the file that was read; a source that
    had no file keeps what it had."""
    out = next_state(state, kept, source, ts).withColumn("last_run_ts", run_ts)
    old = state.select(F.col(source).alias("_s"), *([F.col("last_file").alias("_f")] if "last_file" in state.columns else [F.lit(None).cast("string").alias("_f")]))
    out = out.join(old, out[source] == old["_s"], "left")
    if files is not None:
        f = files.groupBy(F.col(source).alias("_t")).agg(F.max("last_file").alias("_n"))
        out = out.join(f, out[source] == f["_t"], "left")
    return out.select(source, "cursor", "added", "last_run_ts", (F.coalesce("_n", "_f") if files is not None else F.col("_f")).alias("last_file"))


def seen_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """The distinct keys in order, as the snapshot of what has been accepted."""
    return df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(key)


def keyed_union(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Union in which new rows go before old ones; the first of each non-empty key stays."""
    both = new.withColumn("_p", F.lit(0)).unionByName(old.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return first_seen(both.where(F.coalesce(F.col(key), F.lit("")) != ""), key, ["_p"]).drop("_p")


def enrich_missing(df: DataFrame, cache: DataFrame, enrich, key: str = "id") -> DataFrame:
    """Cached rows as they are, the others through ``enrich``."""
    hit = cache.join(df.select(key).distinct(), key, "left_semi")
    return hit.unionByName(enrich(df.join(cache.select(key).distinct(), key, "left_anti")), allowMissingColumns=True)
