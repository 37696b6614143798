"""From documents to packed training sequences: each stage takes what the one before has kept.

A document goes when the toxicity machine scores it 0.7 or more, when it has no letter or cannot be read, or when a near-duplicate with a smaller id
stays. What remains loses the byte strings that occurred earlier and is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wane.llm import language, neardup, packing, substrings, toxicity
from wane.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: From this score on a document is toxic.
TOXIC = 0.7
#: Windows of noise for each window of text that teaches the languages.
NOISE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC by a machine fitted to the labels of these documents."""
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), machine, column="toxic_score").filter(F.col("toxic_score") < TOXIC).select(COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that can be read in some language: those without a letter go, and those of 60 letters or more that the network takes
    for noise. A short one with a doubtful language stays, and all with a letter if there is no language to learn."""
    network = language.learn(docs, noise_share=NOISE)
    if not network.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    told = language.identify(docs.select(COLUMNS), network)
    return told.filter(F.col("lang_pred") != language.UNDETERMINED).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; of equal rows of one id one stays, other texts of it and null ids stay too."""
    kept = neardup.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    once = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(COLUMNS).union(docs.filter("doc_id is null").select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without strings of 100 bytes that occurred earlier; n_chars follows."""
    cut = substrings.remove_repeats(docs, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "rest.lang", "rest.source", F.length("kept_text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages are learned or hashed, so no SQL gives these rows; tests/llm compares them with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
CHECKS: dict[str, str] = {}
