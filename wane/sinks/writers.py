"""Sinks: JSON lines, JSON reports, text reports and the response cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """JSON lines, range-partitioned by the order key so that the files sort as a whole."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode(mode).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as one JSON document."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_text(df: DataFrame, path: str, order: list[str], head: list[str] = ()) -> None:
    """``line`` column as text below the given head lines (Markdown, TeX)."""
    session = df.sparkSession
    body = df.select(F.lit(1).alias("_side"), F.lit(0).alias("_n"), *(c for c in order if c != "line"), "line")
    rows = session.createDataFrame([(0, i, h) for i, h in enumerate(head)], "_side int, _n int, line string").unionByName(body, allowMissingColumns=True)
    keys = ["_side", "_n", *order]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.mode("overwrite").text(path)


def write_cache(cache: DataFrame, path: str) -> None:
    """A new version of the cache table. Never the folder it was read from."""
    cache.repartition("cache_key").write.mode("errorifexists").parquet(path)
