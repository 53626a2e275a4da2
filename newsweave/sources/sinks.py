"""Sinks: distributed writes for tables, one small file where a single document is asked for."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_master(df: DataFrame, path: str, by: tuple[str, ...] = ("feed_key",)) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def append_unknown(df: DataFrame, path: str, key: str = "url") -> int:
    """Append the rows whose key the table doesn't hold yet; the number appended."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def _swapped(spark, part: str, path: str) -> None:
    """Put a finished folder in the place of another."""
    jvm = spark.sparkContext._jvm
    new, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (part, path))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{part} couldn't be moved to {path}")


def rewrite_distinct(new: DataFrame, old: DataFrame, path: str) -> int:
    """Write the distinct rows of both beside path, then put them in its place; old may be read from path. The number of
    rows."""
    spark, part = new.sparkSession, f"{path.rstrip('/')}.part"
    new.unionByName(old, allowMissingColumns=True).distinct().write.mode("overwrite").parquet(part)
    _swapped(spark, part, path)
    return spark.read.parquet(path).count()


def append_in_steps(rows: DataFrame, enrich, path: str, key: str, step: int = 25) -> int:
    """Enrich and append the rows that path doesn't hold yet, ``step`` at a time; each step is committed by itself, so a
    run that is interrupted keeps what it had and the next one goes on there. Nothing is written if nothing is new."""
    spark, done = rows.sparkSession, 0
    while True:
        left = rows.dropDuplicates([key])
        try:
            left = left.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        part = left.orderBy(key).limit(step)
        n = part.count()
        if not n:
            return done
        enrich(part).write.mode("append").parquet(path)
        done += n


def save_seen(ids: DataFrame, path: str) -> None:
    """The snapshot of accepted ids, in order."""
    ids.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, a folder per value of ``by``; nothing is written for an empty frame."""
    if df.isEmpty():
        return
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def save_state(state: DataFrame, path: str) -> None:
    state.coalesce(1).write.mode("overwrite").parquet(path)


def small_json(rows: list[dict] | dict, path: str) -> None:
    """One pretty-printed document, for presets and reports; not for tables."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)


def publish(spark, source: str, target: str) -> int:
    """Copy a result beside the target, hold its rows against the source's, then put it into place; the number of rows.
    A copy that differs raises and leaves the target as it is."""
    df, part = spark.read.parquet(source), f"{target.rstrip('/')}.part"
    n = df.count()
    df.write.mode("overwrite").parquet(part)
    if (got := spark.read.parquet(part).count()) != n:
        raise ValueError(f"{got} of {n} rows were copied")
    _swapped(spark, part, target)
    return n
