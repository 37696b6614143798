"""Report rows: verdict summaries, dataset profile, exemplars, Markdown and TeX lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wane.operators.agreement import half_even, ratio
from wane.operators.ranking import top_per_key


def verdict_report(predictions: DataFrame, verdict: str = "is_deprecated_usage",
                   dims: list[str] = ("stage2_status", "library")) -> DataFrame:
    """Totals and shares overall and per value of each dimension."""
    hit = F.count_if(F.col(verdict))
    return predictions.groupingSets([[], *[[d] for d in dims]], *dims).agg(
        F.count("*").alias("total"), hit.alias("deprecated"), (F.count("*") - hit).alias("benign"),
        half_even(ratio(hit, F.count("*")) * 100, 2).alias("deprecated_pct"))


def exemplars(rows: DataFrame, key: str, order: list[Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows of every key in a stated order."""
    return top_per_key(rows, [key], order, n)


def api_profile(samples: DataFrame, apis: str = "deprecated_api") -> DataFrame:
    """Samples per API and cohort with the API's share of all samples, largest first."""
    total = samples.agg(F.count("*").alias("_total"))
    per = samples.select(F.explode(apis).alias("api"), "category").groupBy("api").agg(
        F.count("*").alias("n"), F.count_if(F.col("category") == "outdated").alias("outdated"),
        F.count_if(F.col("category") == "up-to-dated").alias("up_to_dated"))
    return per.crossJoin(F.broadcast(total)).select(
        "api", "n", "outdated", "up_to_dated", half_even(F.col("n") * 100.0 / F.col("_total"), 1).alias("share_pct")
    ).orderBy(F.desc("n"), "api")


def dataset_profile(samples: DataFrame, apis: str = "deprecated_api", by: list[str] = ("library",)) -> DataFrame:
    return samples.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("category") == "outdated").alias("outdated"),
        F.count_if(F.col("category") == "up-to-dated").alias("up_to_dated"),
        F.count_if(F.size(apis) > 1).alias("composite"))


def distinct_apis(samples: DataFrame, apis: str = "deprecated_api", by: list[str] = ("library",)) -> DataFrame:
    """Distinct APIs per group; pairs are reduced before they are counted."""
    pairs = samples.select(*by, F.explode(apis).alias("api")).distinct()
    return pairs.groupBy(*by).agg(F.count("*").alias("unique_apis"))


def source_counts(samples: DataFrame, by: list[str] = ("library",)) -> DataFrame:
    return samples.groupBy(*by, F.coalesce("source", F.lit("UNKNOWN")).alias("source")).agg(F.count("*").alias("n"))


def expectations(found: dict[str, Column], expected: dict[str, int], rows: DataFrame) -> DataFrame:
    """One row per expected count with what was found."""
    got = rows.agg(*[c.alias(k) for k, c in found.items()])
    checks = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("bigint").alias("found"),
                                F.lit(v).cast("bigint").alias("expected")) for k, v in expected.items()])
    return got.select(F.inline(checks)).withColumn("ok", F.col("found") == F.col("expected"))


def markdown_rows(rows: DataFrame, columns: list[str], widths: dict[str, int] | None = None) -> DataFrame:
    """Table lines; pipes are escaped, line breaks removed, long cells cut as asked."""
    cells = []
    for c in columns:
        text = F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
        text = F.replace(text, F.lit("\n"), F.lit(" "))
        cells.append(F.substring(text, 1, widths[c]) if widths and c in widths else text)
    return rows.select("*", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]


def tex_macros(values: DataFrame) -> DataFrame:
    """``\\newcommand`` lines for (name, value, kind); kind is count, percent, fraction or text."""
    v = F.col("value").cast("double")
    shown = (
        F.when(F.col("kind") == "count", F.format_number(v, 0))
        .when(F.col("kind") == "percent", F.concat(F.format_string("%.2f", v * 100), F.lit("\\%")))
        .when(F.col("kind") == "fraction", F.format_string("%.4f", v))
        .otherwise(F.col("value")))
    return values.select("name", F.concat(F.lit("\\newcommand{\\"), "name", F.lit("}{"), shown, F.lit("}")).alias("line"))


def run_stamp() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
