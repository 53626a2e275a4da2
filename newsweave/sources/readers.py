"""Batch sources. Missing optional columns come back null; corrupt JSON documents go to ``_corrupt`` and are dropped."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsweave.functions.text import collapse, or_empty
from newsweave.schema import GAZETTEER, RAW


def json_articles(spark: SparkSession, path: str, schema: StructType = RAW) -> DataFrame:
    """JSON files of an array or a single object each; the feed key is the file's stem, pos the place in the read."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    df = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").option("ignoreCorruptFiles", True).json(path)
    keyed = df.withColumn("feed_key", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    some = F.coalesce(*[F.col(c.name) for c in schema.fields])
    return keyed.where(F.col("_corrupt").isNull() & some.isNotNull()).drop("_corrupt")


def csv_articles(spark: SparkSession, path: str, feed: str, required: tuple[str, ...] = ("date", "time", "title", "url", "full_text")) -> DataFrame:
    """A CSV with date (dd-MM-yyyy) and time columns as raw articles; raises if a required column is missing."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    ts = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("dd-MM-yyyy HH:mm"))
    return df.select(
        F.lit(feed).alias("feed"), "title", "url", F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("published"),
        F.lit("").alias("summary"), "full_text", F.lit(None).cast("string").alias("scraped_at"), F.lit(None).cast("string").alias("topic"),
    )


def gazetteer_dump(spark: SparkSession, path: str, priority: Column | None = None) -> DataFrame:
    """A tab-separated gazetteer as rows for ``build_gazetteer``; only the columns used are parsed."""
    df = spark.read.schema(GAZETTEER).option("sep", "\t").option("quote", '"').csv(path)
    return df.select("name", F.col("alternatenames").alias("alternates"), "feature_class", F.col("country_code").alias("country"), (priority if priority is not None else F.lit(0)).alias("priority"))


def province_places(spark: SparkSession, path: str, province: str = "05") -> DataFrame:
    df = spark.read.schema(GAZETTEER).option("sep", "\t").csv(path)
    return df.where(F.lpad("admin1_code", 2, "0") == province).select(F.lower("name").alias("name")).distinct()


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select("word", F.expr("try_cast(label as int)").alias("label"))


def police_records(df: DataFrame, feed: str = "Politie") -> DataFrame:
    """Nested press releases (nieuwsberichten with alineas) as raw articles."""
    strip = lambda x: collapse(F.regexp_replace(or_empty(x), "<[^>]*>", " "))
    n = df.select(F.explode("nieuwsberichten").alias("n")).select("n.*")
    paras = F.filter(F.transform("alineas", lambda a: strip(a["opgemaaktetekst"])), lambda x: x != "")
    ts = F.try_to_timestamp(F.col("publicatiedatum"))
    return n.select(
        F.lit(feed).alias("feed"), F.col("titel").alias("title"), "url", F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("published"),
        strip(F.col("introductie")).alias("summary"), F.array_join(F.coalesce(paras, F.array().cast("array<string>")), "\n").alias("full_text"),
    )


def statistics_rows(df: DataFrame, name: str, topics: list[tuple[str, str]] | None = None, other: str = "other") -> DataFrame:
    """Rows of an open-data table as articles: region and period from the first column that has them, the row as JSON.
    topics: (word, topic) in order; the first word that the table's name holds, in any case, gives the topic."""
    topic = F.lit(None).cast("string")
    for word, t in reversed(topics or []):
        topic = F.when(F.contains(F.lower(F.lit(name)), F.lit(word.lower())), F.lit(t)).otherwise(topic)
    topic = F.coalesce(topic, F.lit(other))
    pick = lambda cs: F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in cs if c in df.columns], F.lit(None))
    region, period = pick(["RegioS", "RegioNaam", "RegioCode"]), pick(["Perioden", "Periods"])
    title = F.concat_ws(" – ", F.lit(name), region, period)
    return df.select(title.alias("title"), F.to_json(F.struct(*df.columns)).alias("full_text"), topic.alias("topic"), F.lit(name).alias("feed"))


def pick_link(links: Column) -> Column:
    """Of array<struct<href,rel,type>>: an HTML alternate, else one that isn't audio, else any."""
    first = lambda cond: F.get(F.filter(links, cond), F.lit(0))["href"]
    return F.coalesce(first(lambda x: (x["rel"] == "alternate") & F.contains(x["type"], F.lit("html"))), first(lambda x: ~F.coalesce(F.startswith(x["type"], F.lit("audio")), F.lit(False))), first(lambda x: x["href"].isNotNull()))


def is_page_url(url: Column) -> Column:
    """False for addresses of media and documents."""
    return ~F.lower(F.split_part(F.coalesce(url, F.lit("")), F.lit("?"), F.lit(1))).rlike(r"\.(mp3|mp4|m4a|wav|avi|mov|pdf|jpe?g|png|gif|zip)$")


def slices(start: date, end: date, days: int = 15) -> list[tuple[date, date]]:
    """Date slices newest first, for a paged pull."""
    out, hi = [], end
    while hi > start:
        lo = max(start, hi - timedelta(days=days))
        out.append((lo, hi))
        hi = lo
    return out


def pull_from(stored: DataFrame, source: str, ts: Column, fallback: Column) -> DataFrame:
    """(source, since): the lower bound of each source's next pull, the newest stored date or the fallback."""
    return stored.groupBy(source).agg(F.coalesce(F.max(ts), F.first(fallback)).alias("since"))


def archive_since(df: DataFrame, ts: Column, cutoff: Column, columns: tuple[str, ...] = ("title", "full_text")) -> DataFrame:
    """Rows of an archive listing from the cutoff on, line breaks and blanks of the named columns made single blanks;
    rows whose date can't be read are dropped, as an archive scan stops at the first that isn't newer."""
    return df.where(ts >= cutoff).withColumns({c: collapse(F.col(c)) for c in columns})


def pages(fetch, size: int) -> list[dict]:
    """Paging contract: pages are asked for until one is empty or short. ``fetch(skip, top)`` is the caller's."""
    out: list[dict] = []
    while True:
        got = fetch(len(out), size)
        out.extend(got)
        if len(got) < size:
            return out
