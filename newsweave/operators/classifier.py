"""Lexical place classifier: 52 features of a word, logistic regression, and its report; fit and transform are apart."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Our own lists of frequent parts of Dutch place names: 33 ends and 9 beginnings.
SUFFIXES = "dam dijk burg berg hoven huizen kerk veen zijl drecht oord wijk stede horst loo broek voorde beek meer rade akker laar hout schot waard gaast koop lande ingen ven sluis poort mond".split()
PREFIXES = "nieuw oud noord zuid oost west groot klein sint".split()


def features(word: Column) -> list[Column]:
    low = F.lower(F.coalesce(word, F.lit("")))
    w = F.coalesce(word, F.lit(""))
    n = F.length(w)
    count = lambda p: F.regexp_count(w, F.lit(p)).cast("double")
    base = [
        n.cast("double").alias("f_len"), count("[aeiouy]").alias("f_vowels"), count("[A-Z]").alias("f_caps"), count("[0-9]").alias("f_digits"), count("-").alias("f_hyphens"),
        count(" ").alias("f_blanks"), F.coalesce(F.try_divide(count("[aeiouy]"), n), F.lit(0.0)).alias("f_vowel_share"), w.rlike("^[A-Z]").cast("double").alias("f_capital"),
        (w == F.upper(w)).cast("double").alias("f_upper"), count("[^A-Za-z -]").alias("f_other"),
    ]
    ends = [F.endswith(low, F.lit(s)).cast("double").alias(f"e_{s}") for s in SUFFIXES]
    return base + ends + [F.startswith(low, F.lit(p)).cast("double").alias(f"b_{p}") for p in PREFIXES]


def _featured(df: DataFrame, word: str, gazetteer: DataFrame | None = None) -> DataFrame:
    """df with its features; with a gazetteer (name) also whether the word is a known place, and whether a part of it is."""
    out = df.select("*", *features(F.col(word)))
    if gazetteer is None:
        return out
    names = gazetteer.select(F.lower("name").alias("_n")).distinct()
    parts = out.select(word, F.explode(F.split(F.lower(word), "[ -]")).alias("_n")).join(names, "_n", "left_semi").select(F.col(word).alias("_w")).distinct().withColumn("f_part", F.lit(1.0))
    whole = names.withColumn("f_known", F.lit(1.0))
    out = out.join(whole, F.lower(word) == F.col("_n"), "left").join(parts, F.col(word) == F.col("_w"), "left")
    return out.drop("_n", "_w").fillna(0.0, ["f_known", "f_part"])


def stratified(df: DataFrame, word: str = "word", label: str = "label", held: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, held out): the given percentage of each label's words, by rank of a seeded hash within a hundred buckets,
    so that equal words fall on one side and both labels are split alike."""
    bucket = F.pmod(F.xxhash64(F.col(word), F.col(label).cast("string"), F.lit(seed)), F.lit(100))
    return df.where(bucket >= held), df.where(bucket < held)


def fit(df: DataFrame, word: str = "word", label: str = "label", gazetteer: DataFrame | None = None) -> PipelineModel:
    f = _featured(df.withColumn(label, F.col(label).cast("double")), word, gazetteer)
    names = [c for c in f.columns if c[:2] in ("f_", "e_", "b_")]
    stages = [VectorAssembler(inputCols=names, outputCol="features"), LogisticRegression(labelCol=label, regParam=0.01, maxIter=50)]
    return Pipeline(stages=stages).fit(f)


def predict(model: PipelineModel, words: DataFrame, word: str = "word", gazetteer: DataFrame | None = None) -> DataFrame:
    """(word, p): each distinct word is scored once."""
    out = model.transform(_featured(words.select(word).distinct(), word, gazetteer))
    return out.select(word, vector_to_array("probability")[1].alias("p"))


def keep_places(mentions: DataFrame, scored: DataFrame | None, least: float = 0.5) -> DataFrame:
    """Mentions whose place scores over ``least``; without a model all stay."""
    if scored is None:
        return mentions
    return mentions.join(scored.where(F.col("p") > least).select(F.col("word").alias("place")), "place", "left_semi")


def report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(class, precision, recall, f1, support) from one confusion table."""
    conf = df.groupBy(F.col(label).cast("int").alias("l"), F.col(pred).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = conf.select(F.explode(F.array_distinct(F.array("l", "p"))).alias("class"), "l", "p", "n")
    g = each.groupBy("class").agg(
        F.sum(F.when((F.col("l") == F.col("class")) & (F.col("p") == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("p") == F.col("class"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("l") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
    )
    pr, re = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return g.select("class", F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * pr * re, pr + re), F.lit(0.0)), 6).alias("f1"), "support")


def cross_validate(df: DataFrame, word: str = "word", label: str = "label", folds: int = 5) -> float:
    """Mean macro-F1 over folds by a hash of the word."""
    fold = F.pmod(F.xxhash64(word), F.lit(folds))
    scores = []
    for k in range(folds):
        model = fit(df.where(fold != k), word, label)
        held = df.where(fold == k).join(predict(model, df.where(fold == k), word), word).withColumn("pred", (F.col("p") > 0.5).cast("int"))
        scores.append(report(held, label, "pred").agg(F.avg("f1")).first()[0] or 0.0)
    return sum(scores) / len(scores)
