"""Epochs that arrive as a stream: rejection counts and epoch quality kept up to date (an extra beside the batch audit)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remeasure.operators.quality import QualityRules, rejections, with_quality


def epoch_counts_by_window(epochs: DataFrame, time: str = "ingested_at", window: str = "1 day", lateness: str = "2 days", rules: QualityRules = QualityRules()) -> DataFrame:
    """(window, n_raw, n_good, one count for each reason) of a stream or table of epochs.

    An observation delivered again within the lateness counts once. Rows later than that are dropped by the watermark.
    """
    rows = with_quality(epochs, rules).withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness)
    once = rows.dropDuplicatesWithinWatermark(["OBS_ID"]) if rows.isStreaming else rows.dropDuplicates(["OBS_ID"])
    reasons = [F.count_if(c).alias(name.lower()) for name, c in rejections(epochs.columns, rules).items()]
    return once.groupBy(F.window("_time", window)).agg(F.count("*").alias("n_raw"), F.count_if("IS_GOOD").alias("n_good"), *reasons)
