"""Step metrics as a stream: windows with late data, and running progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "run_id string, step long, ts timestamp, loss double, tokens long"


def read_steps(spark: SparkSession, folder: str) -> DataFrame:
    """JSON step metrics as they are appended to a folder."""
    return spark.readStream.schema(STEP).json(folder)


def windowed_loss(steps: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Token-weighted loss per run and window; rows later than ``late`` are left out."""
    weighted = steps.withWatermark("ts", late).groupBy(F.window("ts", width), "run_id")
    return weighted.agg(F.sum("tokens").alias("tokens"), (F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("loss"))


def progress(steps: DataFrame) -> DataFrame:
    """Steps, tokens and the last step per run, in update or complete mode."""
    return steps.groupBy("run_id").agg(F.count("*").alias("steps"), F.sum("tokens").alias("tokens"), F.max("step").alias("last_step"))


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).start(path)
