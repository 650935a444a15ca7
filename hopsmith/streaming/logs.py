"""Append-only logs as streams; ``availableNow`` reads what is there and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopsmith import schemas
from hopsmith.functions.metrics import fact_metrics
from hopsmith.operators.aggregates import timing_rows


def log_stream(spark: SparkSession, folder: str, schema: str = schemas.RETRIEVER_LOG) -> DataFrame:
    """Retriever logs as files arrive; broken lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder).where("id IS NOT NULL")


def scored_stream(log: DataFrame) -> DataFrame:
    """Stateless: f1 and em of each record."""
    m = fact_metrics(F.col("pred_idx"), F.col("sf_idx"))
    return log.withColumns({"f1": m["f1"], "em": m["em"]})


def append(stream: DataFrame, path: str, checkpoint: str):
    """Start writing as JSON lines; a restarted stream continues after the last commit."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_summary(log: DataFrame, path: str, checkpoint: str):
    """Counts and means so far, a row in a table at ``path`` that each batch replaces."""
    m = fact_metrics(F.col("pred_idx"), F.col("sf_idx"))
    totals = log.agg(F.count("*").alias("n"), F.avg(m["f1"]).alias("f1"), F.avg(m["em"]).alias("em"))

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return totals.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def timing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Reward timings from text logs as they grow by files."""
    return timing_rows(spark.readStream.text(folder))


def windowed_values(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event time and type; what comes later than ``late`` is dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
