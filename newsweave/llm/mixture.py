"""Mixing sources to target shares of all tokens, by capped water-filling.

Each source may give at most ``max_repeats`` times its own tokens. The shares are filled to a common level; a source
that would need more is clamped at its cap and what it lacks goes to the others in proportion to their targets, until
nothing changes. The amount of a source becomes a number of whole repetitions of all its documents and a part of one
more; that part is a seeded sample, exact to about one document: documents are ordered by a seeded hash, the tokens
are summed per hash bucket first, whole buckets are taken below the limit, and only the bucket at the limit is sorted.

Defined results: documents without a source, and sources without a target, get 0 repetitions; sources of the targets
without documents get 0 and their share goes to the others; null or empty texts have 0 tokens and follow their source;
repeated documents are drawn like any others. With no total given, the mixture is as large as the documents of the
targets' sources together: sources that are too small for their share of that are clamped, and their excess goes to the
others. ``full_total`` is the largest total that clamps none.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("NEWSWEAVE_TOKENIZERS", "/opt/tokenizers")
BUCKETS = 4096


def token_counts(df: DataFrame, text: str = "text", tokenizer: str | None = None, out: str = "tokens") -> DataFrame:
    """df with the number of tokens of each text; tokenizer: a ``tokenizer.json`` file of a public tokenizer."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = _encoder(path)
        for v in batches:
            yield pd.Series(encode([t or "" for t in v]), dtype="int64")

    return df.withColumn(out, count(F.col(text)))


def default_tokenizer() -> str:
    """The multilingual byte-level vocabulary of the folder."""
    return os.path.join(TOKENIZERS, "byte_bpe_multi_50k.tiktoken")


def _encoder(path: str):
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        # Fixed value: the public split pattern of byte-level vocabularies of this size.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def full_total(sizes: dict[str, float], targets: dict[str, tuple[float, int]]) -> float:
    """The largest total at which no source that has documents is clamped."""
    have = {s: (share, cap * sizes[s]) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and sizes.get(s)}
    weight = sum(share for share, _ in have.values())
    return min((room * weight / share for share, room in have.values()), default=0.0)


def water_fill(sizes: dict[str, float], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens to take of each source: shares of total, clamped at cap x size, the excess spread in proportion."""
    room = {s: cap * sizes.get(s, 0) for s, (_, cap) in targets.items()}
    out = {s: 0.0 for s in targets}
    free = {s for s, (share, _) in targets.items() if share > 0 and room[s] > 0}
    left = min(total, sum(room[s] for s in free))
    while free:
        weight = sum(targets[s][0] for s in free)
        over = {s for s in free if left * targets[s][0] / weight >= room[s]}
        if not over:
            for s in free:
                out[s] = left * targets[s][0] / weight
            break
        for s in over:
            out[s] = room[s]
            left -= room[s]
        free -= over
    return out


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, total: float | None = None, doc_id: str = "doc_id", source: str = "source", tokens: str = "tokens", exact: bool = False) -> DataFrame:
    """docs with ``repeats``, 0 where a document isn't drawn. exact: total is ``full_total``."""
    goal = {r.source: (r.target_share, r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").collect()}
    wanted = F.broadcast(targets.select(F.col("source").alias(source)).distinct())  # as many rows as targets
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(seed)), F.lit(BUCKETS * 1_000_000))
    d = docs.withColumns({"_draw": draw, "_bucket": (draw / 1_000_000).cast("int")})
    per = d.join(wanted, source, "left_semi").groupBy(source, "_bucket").agg(F.sum(tokens).alias("t"))
    sizes = {r[source]: r.t for r in per.groupBy(source).agg(F.sum("t").alias("t")).collect()}  # at most the targets' sources
    amount = water_fill(sizes, goal, total if total is not None else full_total(sizes, goal) if exact else sum(x or 0 for x in sizes.values()))
    plan = [(s, int(amount[s] // sizes[s]), float(amount[s] % sizes[s])) for s in goal if sizes.get(s)]
    plan = d.sparkSession.createDataFrame(plan, f"{source} string, _whole int, _part double")
    w = Window.partitionBy(source).orderBy("_bucket")
    upto = per.withColumn("_upto", F.sum("t").over(w)).join(F.broadcast(plan), source)
    # the bucket in which the limit lies; at most BUCKETS rows a source are ordered here
    edge = upto.where(F.col("_upto") > F.col("_part")).groupBy(source).agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("t")).alias("below"))).alias("e"))
    plan = plan.join(edge, source, "left").select(source, "_whole", "_part", F.coalesce("e._bucket", F.lit(BUCKETS)).alias("_edge"), F.coalesce("e.below", F.lit(0)).alias("_below"))
    j = d.join(F.broadcast(plan), source, "left")
    at_edge = j.where(F.col("_bucket") == F.col("_edge")).select(source, doc_id, "_draw", tokens, "_part", "_below")
    order = Window.partitionBy(source).orderBy("_draw", doc_id)
    taken = at_edge.withColumn("_sum", F.sum(tokens).over(order) + F.col("_below")).where(F.col("_sum") <= F.col("_part")).select(F.col(doc_id).alias("_id"), F.lit(1).alias("_in"))
    j = j.join(taken, j[doc_id] == taken["_id"], "left")
    extra = F.when(F.col("_bucket") < F.col("_edge"), 1).otherwise(F.coalesce("_in", F.lit(0)))
    repeats = F.when(F.col("_whole").isNull(), 0).otherwise(F.col("_whole") + extra).cast("int")
    return j.withColumn("repeats", repeats).drop("_draw", "_bucket", "_whole", "_part", "_edge", "_below", "_id", "_in")


def report(mixed: DataFrame, targets: DataFrame, source: str = "source", tokens: str = "tokens") -> DataFrame:
    """Per source of the targets: its documents and tokens, what was drawn, the times its tokens were read (epochs), the
    target and the actual share, the most repetitions of a document, and what became of the source: ``missing`` has no
    documents, ``clamped`` stands at its cap, ``filled`` took over what the others couldn't give."""
    per = mixed.groupBy(source).agg(
        F.count_if(F.col("repeats") > 0).alias("docs"), F.sum(tokens).alias("own_tokens"), F.sum(F.col(tokens) * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats")
    )
    per = targets.select(F.col("source").alias(source), "target_share", "max_repeats").join(per, source, "left").fillna(0, ["docs", "own_tokens", "mixed_tokens", "most_repeats"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # as many rows as targets
    state = F.when(F.col("own_tokens") == 0, "missing").when(F.col("mixed_tokens") >= F.col("own_tokens") * F.col("max_repeats"), "clamped").otherwise("filled")
    return per.withColumns({"epochs": F.round(F.try_divide("mixed_tokens", "own_tokens"), 4), "actual_share": F.round(F.try_divide("mixed_tokens", whole), 6), "state": state})
