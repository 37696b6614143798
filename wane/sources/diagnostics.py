"""Diagnostics of type checkers, read from their saved output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wane import fixed_values as fixed
from wane.functions.text import strip
from wane.operators.ranking import first_per_key


def clean_symbol(symbol: Column, module: Column, prefix: Column) -> Column:
    """Drop the module of the checked file and put the package prefix in front."""
    own = F.when((module != "") & F.startswith(symbol, F.concat(module, F.lit("."))),
                 F.substr(symbol, F.length(module) + 2)).otherwise(symbol)
    dotted = F.concat(prefix, F.lit("."))
    return F.when((prefix == "") | F.startswith(own, dotted), own).otherwise(F.concat(dotted, own))


def _candidates(rows: DataFrame, checker: str) -> DataFrame:
    """One candidate per file, symbol and line: the first diagnostic of it."""
    kept = first_per_key(rows, ["source", "symbol", "line"], [F.col("ord")])
    return kept.select(
        F.col("symbol").alias("qualified_name"), F.lit(f"pep702:{checker}").alias("origin"), "file", "line",
        "raw_evidence", F.array(F.lit("pep702"), F.lit(f"pep702:{checker}")).alias("origins"),
        F.lit("function").alias("scope"), F.lit(None).cast("string").alias("param_name"),
        F.col("symbol").alias("function_name"), F.when(F.col("msg") != "", F.col("msg")).alias("message"), "ord")


def from_mypy(lines: DataFrame, prefix: Column | None = None) -> DataFrame:
    """``value`` lines of mypy output with ``source`` (run id), ``module`` and ``ord``."""
    prefix = F.lit("") if prefix is None else prefix
    # one application of the pattern: its groups become an array, other lines stay whole
    groups = F.split(F.regexp_replace(strip(F.col("value")), fixed.MYPY_LINE, "$1\u001f$2\u001f$3\u001f$4"), "\u001f")
    hits = lines.select("source", "ord", "module", groups.alias("g")).where(F.size("g") == 4)
    part = lambda i: F.col("g")[i]
    rows = hits.select(
        "source", "ord", part(0).alias("file"), part(1).cast("int").alias("line"),
        clean_symbol(part(2), F.col("module"), prefix).alias("symbol"), strip(part(3)).alias("msg"))
    shown = F.concat(F.lit("mypy [deprecated]: "), "symbol", F.lit(" is deprecated"),
                     F.when(F.col("msg") != "", F.concat(F.lit(" ("), "msg", F.lit(")"))).otherwise(F.lit("")))
    return _candidates(rows.withColumn("raw_evidence", shown), "mypy")


PYRIGHT_OUTPUT = "generalDiagnostics array<struct<rule:string,message:string,range:struct<start:struct<line:int>>>>"


def from_pyright(outputs: DataFrame, prefix: Column | None = None) -> DataFrame:
    """``value`` JSON outputs of pyright with ``source`` (file), ``module`` and ``ord``.

    A file may have several outputs; ``ord`` puts them in order.
    """
    prefix = F.lit("") if prefix is None else prefix
    d = outputs.select("source", "module", F.col("ord").alias("run"), F.posexplode(
        F.from_json("value", f"struct<{PYRIGHT_OUTPUT.replace(' array', ':array', 1)}>")["generalDiagnostics"]
    ).alias("pos", "d")).where(F.col("d.rule") == "reportDeprecated")
    message = F.coalesce("d.message", F.lit(""))
    part = lambda i: F.regexp_extract(message, fixed.PYRIGHT_MESSAGE, i)
    hit = message.rlike(fixed.PYRIGHT_MESSAGE)
    raw = F.when(hit, F.concat(F.when(part(2) != "", F.concat(part(2), F.lit("."))).otherwise(F.lit("")), part(1))).otherwise(
        F.lit("deprecated_symbol"))
    body = strip(F.translate(F.when(hit, part(3)).otherwise(message), " ", " "))
    rows = d.select(
        "source", F.col("source").alias("file"), F.struct("run", "pos").alias("ord"),
        (F.coalesce("d.range.start.line", F.lit(0)) + 1).alias("line"), raw.alias("raw"),
        clean_symbol(raw, F.col("module"), prefix).alias("symbol"), body.alias("msg"))
    shown = F.concat(F.lit("pyright [reportDeprecated]: "), F.when(F.col("msg") != "", F.col("msg")).otherwise(
        F.concat("raw", F.lit(" is deprecated"))))
    return _candidates(rows.withColumn("raw_evidence", shown).drop("raw"), "pyright")
