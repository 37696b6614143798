"""JSON arrays, JSON lines and the parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wane.functions.text import as_array
from wane.operators.ranking import latest_per_key
from wane.schemas import CORPUS_RAW
from wane.sources.arrays import array_records


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON arrays; a large array is read by many tasks."""
    return array_records(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record per line; blank lines are skipped, a missing path gives no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Records by key; of several with one key the last stays."""
    return latest_per_key(rows.where(F.col(key).isNotNull()), [key], [F.col(order)])


def read_corpus(spark: SparkSession, path: str, library: str) -> DataFrame:
    """Corpus samples with normalised API lists and ids by position in the array."""
    s = array_records(spark, path).select(F.col("position").cast("int").alias("sample_idx"), F.from_json("value", CORPUS_RAW).alias("s"))
    return s.select(
        F.concat_ws("_", F.lit(library), F.col("sample_idx").cast("string")).alias("sample_id"),
        F.lit(library).alias("library"), "sample_idx", F.coalesce("s.function", F.lit("")).alias("function"),
        F.coalesce("s.category", F.lit("unknown")).alias("category"),
        as_array(F.col("s.`deprecated api`")).alias("deprecated_api"),
        F.col("s.`alias dict`").alias("alias_dict"), F.col("s.source").alias("source"))


def status_of(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Which inputs exist and how many rows they hold; a file without rows exists."""
    out = None
    for name, path in paths.items():
        try:
            rows, present = spark.read.schema(schema).json(path), True
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows, present = spark.createDataFrame([], schema), False
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("input"), "n", F.lit(present).alias("present"))
        out = part if out is None else out.unionByName(part)
    return out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
