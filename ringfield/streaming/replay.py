"""Recorded tables as streams: rows arrive in deliveries, and a query runs until it has read what is there.

A delivery is a set of files in the source's folder. Each run of the query starts from the
checkpoint that the last one left, as after a failure or an upgrade."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ringfield.operators.graph import shared_dir
from ringfield.streaming.tracker import ROCKS


class Replay:
    """A file stream in the shared folder and one query on it."""

    def __init__(self, spark: SparkSession, query: Callable[[DataFrame], DataFrame]):
        self.folder = f"{shared_dir(spark).rstrip('/')}/ringfield-stream-{uuid.uuid4().hex}"
        self.spark, self.query = spark.newSession(), query  # the state store is set for these streams only
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def deliver(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/in")

    def run(self) -> None:
        """Reads what was delivered since the last run."""
        schema = self.spark.read.parquet(f"{self.folder}/in").schema
        out = self.query(self.spark.readStream.schema(schema).parquet(f"{self.folder}/in"))
        run = out.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/state").option("path", f"{self.folder}/out").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()

    def result(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/out")


def replayed(spark: SparkSession, deliveries: Iterable[DataFrame], query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the query gives for all deliveries, each read by a run of its own."""
    stream = Replay(spark, query)
    for rows in deliveries:
        stream.deliver(rows)
        stream.run()
    return stream.result(spark)
