"""Verify candidates as their files arrive, appending verdicts batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wane.operators.verification import rule_verifier, verify_with_store
from wane.schemas import MANIFEST
from wane.sinks.store import ResponseStore


def verify_stream(spark: SparkSession, arrivals: str, verdicts: str, cache: str, checkpoint: str,
                  verifier=rule_verifier) -> StreamingQuery:
    """Append JSON-lines verdicts for every new manifest file.

    A batch appends its responses as one part of the cache and writes its verdicts to a folder of its own. When it is
    repeated after a failure it replaces them, so nothing is counted twice. It reads only the partitions that its keys fall into.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        store = ResponseStore(batch.sparkSession, cache)
        predictions = verify_with_store(batch, store, verifier, run=batch_id)
        predictions.write.mode("overwrite").json(f"{verdicts}/batch={batch_id}")

    source = spark.readStream.schema(MANIFEST).json(arrivals)
    return (
        source.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
