"""Queries of the training-data operators, each over its whole tables with the operators' own parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm import abuse, boilerplate, history, leaks, lookalikes, markup, mixture, nearcopies, oracle, subjects
from newsweave.session import spread, table, written

FIELDS = ["summary", "full_text"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(table(spark, d, "cache_single"), table(spark, d, "merge_batch"))


def p1_accepted(spark: SparkSession, d: str) -> DataFrame:
    rows = history.accepted(table(spark, d, "cache_single"), table(spark, d, "merge_batch"))
    return rows.select("row_id", "batch_no", "feed_key", "canonical_url", "id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture_lines(spread(table(spark, d, "nos_articles").select("row_id", "feed_key", "full_text")))


def p2_main_content(spark: SparkSession, d: str) -> DataFrame:
    df = spread(table(spark, d, "nos_articles").select("row_id", "feed_key", "full_text"))
    return boilerplate.main_content(df).select("row_id", "main_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_kinds(spread(table(spark, d, "nos_articles").select("row_id", *FIELDS)), "row_id", FIELDS)


def p3_style_tree(spark: SparkSession, d: str) -> DataFrame:
    df = spread(table(spark, d, "nos_articles").select("row_id", "feed_key", *FIELDS))
    return markup.style_tree(df, "row_id", "feed_key", FIELDS)


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    df = spread(table(spark, d, "nos_articles").select("row_id", "feed_key", *FIELDS))
    return markup.clean_fields(df, "row_id", "feed_key", FIELDS).select("row_id", "summary_clean", "full_text_clean")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.row_pairs(table(spark, d, "nos_articles"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.groups(table(spark, d, "nos_articles"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_fields(table(spark, d, "nos_articles").select("row_id", "feed", "title"), "row_id", ["feed", "title"])


def p7_consistent(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "nos_articles").select("row_id", "feed", "title")
    return lookalikes.to_consistent(df, ["feed", "title"]).select("row_id", "feed_form", "title_form")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: the documents that give it away."""
    found = leaks.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))
    per = found.groupBy(F.col("item").alias("item_id")).agg(F.count(F.lit(1)).alias("docs"))
    items = table(spark, d, "eval_items").select("item_id", "suite")
    return items.join(per, "item_id", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per item: documents that give it away, and the largest part of it that one document covers."""
    found = leaks.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))
    per = found.groupBy(F.col("item").alias("item_id")).agg(F.count(F.lit(1)).alias("docs"), F.round(F.max(F.col("covered") / F.col("item_words")), 4).alias("most_covered"))
    items = table(spark, d, "eval_items").select("item_id", "suite")
    return items.join(per, "item_id", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))


def _mixed(spark: SparkSession, d: str, exact: bool = False) -> DataFrame:
    docs = mixture.token_counts(spread(table(spark, d, "documents").select("doc_id", "source", "text"))).drop("text")
    return mixture.mix(written(docs), table(spark, d, "mix_targets"), exact=exact)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def p9_exact(spark: SparkSession, d: str) -> DataFrame:
    """The report of the largest mixture in which no source is clamped, so that every one has its share."""
    return mixture.report(_mixed(spark, d, exact=True), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.report(_mixed(spark, d), table(spark, d, "mix_targets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.row_subjects(table(spark, d, "nos_articles"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p6_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Rows per subject and their share of all rows; a row of two subjects counts in both."""
    df = table(spark, d, "nos_articles")
    n = F.lit(df.count())
    return p6_found(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / n, 6))


def p6_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Per subject: rows that end with it, hand labels, and how many of these are trusted."""
    return subjects.seed_report(table(spark, d, "nos_articles"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    model = abuse.train(*abuse.labelled(docs, table(spark, d, "review_labels")))
    return abuse.scores(docs, model, keep=("source",))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.flagged(_scored(spark, d))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(_scored(spark, d))


def queries() -> dict:
    fs = [
        p1_found, p1_accepted, p2_found, p2_main_content, p3_found, p3_style_tree, p3_clean, p5_found, p5_groups,
        p6_found, p6_corpus, p6_seeds, p7_found, p7_consistent, p8_found, p8_items, p8_coverage, p9_mix, p9_shares, p9_exact, p10_found, p10_scores,
        p10_sources,
    ]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
