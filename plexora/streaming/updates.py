"""Streaming forms of stateless and additive operators (an extra of the engine).

The operators it extends are batch only; nothing here adds semantics to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.operators.edges import endpoints


def read_table(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A parquet folder as a stream; the schema is read once from its files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, event_type, n, total)`` per tumbling window of event time; rows
    later than the watermark are dropped, so state stays bounded."""
    w = F.window("ts", width)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    g = timed.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def degree_counts(edges: DataFrame) -> DataFrame:
    """``(node, degree, strength)`` over arriving edges ``(u, v, w)``."""
    return endpoints(edges, "w").groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def induced_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between the nodes of arriving samples ``(obs, feats)``; the edge table
    is static, each sample is whole in its row, so no state is kept."""
    ends = F.array_contains("feats", F.col("u")) & F.array_contains("feats", F.col("v"))
    one = nodes.select("obs", "feats", F.explode("feats").alias("u"))
    return one.join(edges.select("u", "v", "w"), "u").where(ends).select("obs", "u", "v", "w")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into a parquet folder, then stop. Progress
    is in ``checkpoint``, a folder that all executors reach."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_to_end(stream: DataFrame, sink, checkpoint: str) -> None:  # noqa: ANN001
    """Process everything available in update mode, each batch given to ``sink``
    (a function of a batch and its number), then stop."""
    q = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def complete_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available; the last state of an aggregation stands in
    the folder ``path`` afterwards."""

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
