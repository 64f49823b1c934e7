"""Arriving query records matched against the standing target index, batch by batch.

Candidates of a record depend on the index alone, so they are final at once. Owners are decided over
all queries, so they stay a batch operator over what has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from matchloom.operators.blocking import token_route
from matchloom.sources.records import RECORD


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RECORD).option("sep", "\t").option("header", True).csv(folder)


def match_arrivals(stream: DataFrame, targets: DataFrame, out: str, checkpoint: str, column: str = "business_name", cap: int = 3000) -> StreamingQuery:
    """Writes each batch's pairs under its number, so a batch that runs again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        token_route(rows, targets, column, cap).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
