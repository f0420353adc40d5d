"""Training on a stream of sample files, one update per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.objectives import lr_gradient
from ..plans.training import descend
from ..sources.folders import shared_folder


def train_on_stream(stream: DataFrame, d: int, alpha: float, checkpoint: str) -> tuple[list[float], int]:
    """Weights and rows seen after all data that is there now; one gradient step a micro-batch."""
    state = {"w": [0.0] * (d + 1), "n": 0}

    def update(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        n = batch.count()
        if n:
            state["w"] = descend(batch, lr_gradient(d), state["w"], 1, lambda t: alpha)
            state["n"] += n
        batch.unpersist()

    stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return state["w"], state["n"]


def stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream of samples, read file by file."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    return rows.select((F.col("o_totalprice") / 500000).alias("x0"), (F.substring("o_orderpriority", 1, 1).cast("double") / 5).alias("x1"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))


def checkpoint_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")
