"""New batches against all history, by a stored segment index.

The index holds, of each accepted text, the segments of its units (sentences) under the unit's length and its place in
the text: a fixed number of segments a unit, sets of its rarest words instead of equal pieces of its string, of which a
bounded number of edits leaves one whole (``overlap``). A batch probes with its own segments; units meet if their lengths
allow the edit distance, texts if the units that met are long enough. What meets is verified by a bounded distance: the
runs of three words to put in or take out to get one text from the other.

A stored text is encoded and cut once, when it enters. What a batch adds is appended; the texts of the history aren't
read again but for those that a batch text met. The stored segments are scanned in narrow columns and dropped at once
unless the batch has them: a filter of fixed size (``SLOTS`` bits), which the batch's segments fill. A batch of many
millions of texts fills it up; then more stored segments are shuffled, and the result is the same.

The sequential rule (a row is accepted if it repeats nothing accepted before it) is solved in rounds over hubs, one for
each canonical URL and each class of equal bodies: rows whose hubs hold no earlier undecided row are accepted, rows
whose hubs hold an earlier accepted row are repeats. A hub keeps its least row only, so a URL or text that a third of
all rows share costs one row a round. Only rows that share a hub go into the rounds.

Defined results: null or empty URLs repeat nothing; rows without a body, or with fewer than three words, repeat by URL
only; equal (batch_no, pos) are taken in the order of row_id; an empty batch gives an empty result, an empty history
leaves the batch's own repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.functions.urls import article_id, canonical_url
from newsweave.llm import overlap, texts
from newsweave.session import dropped, shared_path, spread, written

THRESHOLD, SLOTS = 0.5, 1 << 24


def encoded(df: DataFrame, keep: list[str], full_text: str, summary: str) -> DataFrame:
    """keep, body, codes: the class of the body and its words; both null without three words. One pass in Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            if not len(b):
                continue
            codes = [texts.encode(texts.body_of(f, s), known) for f, s in zip(b["_f"], b["_s"])]
            codes = [c if len(c) > 3 else None for c in codes]
            bodies = pd.array([None if c is None else texts.body_key(c) for c in codes], "Int64")
            yield b.drop(columns=["_f", "_s"]).assign(body=bodies, codes=codes)

    rows = df.select(*keep, F.col(full_text).alias("_f"), F.col(summary).alias("_s"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", body bigint, codes array<int>"
    return spread(rows).mapInPandas(run, schema)


def _classes(rows: DataFrame, key: str) -> DataFrame:
    """(body, codes), one row of each class; the copies, few as a rule, are taken out by their keys."""
    some = rows.where("body is not null")
    first = some.groupBy("body").agg(F.min(key).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("body", "m")
    copies = some.select(key, "body").join(first, "body").where(F.col(key) != F.col("m")).select(key, "body").distinct()
    return some.join(copies, [key, "body"], "left_anti").select("body", "codes")


# --- the stored index -------------------------------------------------------------------------------------------------


def build_index(rows: DataFrame, path: str) -> None:
    """Store accepted articles (id, canonical_url and what ``encoded`` adds): their texts, their segments, and the order
    of the segments, which stays as it is from then on."""
    spark = rows.sparkSession
    rows.select("id", "canonical_url", "body", "codes").write.mode("overwrite").parquet(f"{path}/texts")
    stored = _stored(spark, path, "texts", "id string, canonical_url string, body bigint, codes array<int>")
    classes = _classes(stored, "id")
    order = overlap.frequent(classes)
    overlap.stored(order, spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/order")
    overlap.segments(classes, "body", order).write.mode("overwrite").parquet(f"{path}/segments")


def append_index(rows: DataFrame, path: str, segments: DataFrame | None = None) -> None:
    """Append newly accepted articles; of what stands in the index only the names of the bodies are read, so that a body
    isn't cut twice. segments: those of the new bodies, if they have been cut already."""
    spark = rows.sparkSession
    known = _stored(spark, path, "texts", "body bigint").where("body is not null").distinct()
    if segments is None:
        segments = overlap.segments(_classes(rows, "id").join(known, "body", "left_anti"), "body", _order(spark, path))
    else:
        new = rows.select(F.col("body").alias("text")).where("text is not null").distinct()
        segments = segments.join(new.join(known.withColumnRenamed("body", "text"), "text", "left_anti"), "text", "left_semi")
    segments.write.mode("append").parquet(f"{path}/segments")
    rows.select("id", "canonical_url", "body", "codes").write.mode("append").parquet(f"{path}/texts")


def _stored(spark, path: str, part: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{part}")


def _order(spark, path: str) -> overlap.Order:
    return overlap.read(_stored(spark, path, "order", "kind string, v int, c bigint"))


def _probed(stored: DataFrame, own: DataFrame) -> DataFrame:
    """The stored segments that the batch may have: a bit for each slot of keys, in words of 64, at most SLOTS bits."""
    slot = F.col("key").cast("bigint").bitwiseAND(SLOTS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int"))
    word = own.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits = np.zeros(SLOTS // 64, "i8")
    bits[word["w"].to_numpy("i8")] = word["bits"].to_numpy("i8")
    shared = stored.sparkSession.sparkContext.broadcast(bits.view("u1"))  # SLOTS / 8 bytes

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = shared.value
        for b in batches:
            at = b["key"].to_numpy("i4").view("u4") & np.uint32(SLOTS - 1)
            hit = (flags[at >> 3] >> (at & 7).astype("u1")) & 1 == 1
            if hit.any():
                yield b[hit]

    return stored.mapInPandas(keep, overlap.SEGMENTS)


def body_links(path: str, batch: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(a, b): every class of the batch (row_id, body, codes) and every other class, of the index or the batch, that
    reach the threshold; two classes of the batch come both ways round. Also the batch's segments."""
    spark = batch.sparkSession
    own = written(_classes(batch, "row_id"))
    cut = written(overlap.segments(own, "body", _order(spark, path)))
    stored = _stored(spark, path, "segments", overlap.SEGMENTS)
    probed = written(_probed(stored, cut))
    pairs = written(overlap.between(cut, probed.unionAll(cut), threshold), probed)
    wanted = pairs.select(F.col("b").alias("body")).distinct()
    old = _stored(spark, path, "texts", "body bigint, codes array<int>").where("body is not null")
    # a body that several accepted articles have is stored as often; any of its rows will do
    far = old.unionAll(own.select("body", "codes")).join(wanted, "body", "left_semi").dropDuplicates(["body"])
    met = pairs.join(own.toDF("a", "ca"), "a").join(far.toDF("b", "cb"), "b")
    links = written(overlap.verified(met, threshold).select("a", "b"), pairs)
    dropped(own)
    return links, cut


# --- the sequential rule ----------------------------------------------------------------------------------------------


def arrive(path: str, batch: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, kept_id) of each batch row that repeats an article of the index or an earlier accepted row; the accepted
    rows are appended to the index."""
    spark = batch.sparkSession
    b = batch.withColumns({"curl": canonical_url(F.col("url")), "o": F.struct("batch_no", "pos", "row_id")})
    new = written(encoded(b, ["row_id", "o", "curl"], "full_text", "summary"))
    rows = new.select("row_id", "o", F.when(F.col("curl") != "", F.col("curl")).alias("curl"), "body")
    old = _stored(spark, path, "texts", "id string, canonical_url string, body bigint")

    by_url = rows.join(old.where("canonical_url <> ''").select(F.col("canonical_url").alias("curl"), "id"), "curl").select("row_id", "id")
    ids = old.where("body is not null").groupBy("body").agg(F.min("id").alias("id"))
    by_text = rows.join(ids, "body").select("row_id", "id")
    plain = written(by_url.unionAll(by_text).groupBy("row_id").agg(F.min("id").alias("kept_id")))
    # what repeats by its URL or word for word is never accepted: nothing can repeat it, and it needs no more search
    open_rows = new.join(plain, "row_id", "left_anti")
    links, segments = body_links(path, open_rows, threshold)

    reach = links.join(ids.withColumnRenamed("body", "b"), "b").groupBy(F.col("a").alias("body")).agg(F.min("id").alias("kept_id"))
    left = rows.join(plain, "row_id", "left_anti")
    near = written(left.join(reach, "body").select("row_id", "kept_id"))
    inside = _in_order(left.join(near, "row_id", "left_anti"), links)
    repeated = written(plain.unionAll(near).unionAll(inside.select("row_id", "kept_id")))
    kept = new.join(repeated, "row_id", "left_anti").where("curl <> ''")
    append_index(kept.select(article_id(F.col("curl")).alias("id"), F.col("curl").alias("canonical_url"), "body", "codes"), path, segments)
    for x in (new, plain, near, links, segments):
        dropped(x)
    return repeated


def _in_order(left: DataFrame, links: DataFrame) -> DataFrame:
    """(row_id, kept_id) of the rows (row_id, o, curl, body) that repeat an earlier accepted one of them."""
    left = left.withColumn("u", F.xxhash64("curl"))
    mine = left.select(F.col("body").alias("b")).where("b is not null").distinct()
    near = written(links.join(mine, "b", "left_semi"))
    many = lambda c: left.where(f"{c} is not null").groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c)
    tied = left.where("curl is not null").join(many("u"), "u", "left_semi").select("row_id")
    tied = tied.unionAll(left.join(many("body").unionAll(near.select(F.col("a").alias("body"))).distinct(), "body", "left_semi").select("row_id")).distinct()
    # 0: undecided, 1: accepted, 2: repeat
    state = written(left.join(tied, "row_id", "left_semi").select("row_id", "o", F.when(F.col("curl").isNotNull(), F.col("u")).alias("u"), "body", F.lit(None).cast("bigint").alias("of"), F.lit(0).alias("done")))
    while True:
        live = state.where("done < 2")
        hub = lambda c: live.where(f"{c} is not null").groupBy(c).agg(F.min(F.when(F.col("done") == 0, F.col("o"))).alias("mu"), F.min(F.when(F.col("done") == 1, F.col("o"))).alias("ma"))
        own = hub("body")
        far = near.join(own.withColumnRenamed("body", "b"), "b").select(F.col("a").alias("body"), "mu", "ma")
        body_hub = own.unionAll(far).groupBy("body").agg(F.min("mu").alias("tu"), F.min("ma").alias("ta"))
        seen = state.join(hub("u"), "u", "left").join(body_hub, "body", "left")
        accepted = F.least("ma", "ta")
        earlier = accepted.isNotNull() & (accepted < F.col("o"))
        first = (F.col("mu").isNull() | (F.col("mu") >= F.col("o"))) & (F.col("tu").isNull() | (F.col("tu") >= F.col("o")))
        done = F.when(F.col("done") > 0, F.col("done")).when(earlier, 2).when(first, 1).otherwise(0)
        of = F.when((F.col("done") == 0) & earlier, accepted["row_id"]).otherwise(F.col("of"))
        state = written(seen.select("row_id", "o", "u", "body", of.alias("of"), done.alias("done")), state)
        if not state.where("done = 0").limit(1).count():
            break
    again = state.where("done = 2").select("row_id", "of")
    source = left.select(F.col("row_id").alias("of"), F.coalesce("curl", F.lit("")).alias("curl"))
    return again.join(source, "of").select("row_id", article_id(F.col("curl")).alias("kept_id"))


def repeats(cache: DataFrame, batch: DataFrame, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """(row_id, kept_id) of each batch row that repeats an accepted article. The index is made of cache and kept at path
    (else in the shared folder), where ``arrive`` takes the next batch without cache."""
    path = path or shared_path(batch.sparkSession, "segment-index")
    build_index(encoded(cache, ["id", "canonical_url"], "full_text", "summary"), path)
    return arrive(path, batch, threshold)


def accepted(cache: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch rows that repeat nothing, with canonical_url and id; ties and order as in ``repeats``."""
    again = repeats(cache, batch).select("row_id")
    url = canonical_url(F.col("url"))
    return batch.join(again, "row_id", "left_anti").withColumns({"canonical_url": url, "id": article_id(url)})
