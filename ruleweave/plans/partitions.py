"""Inputs of fewer partitions than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where it is read in fewer tasks than there are cores (one small file, say).

    What is read in many tasks stays as it is, so no large table is shuffled here; so do streams, and plans
    with a shuffle, whose partitions are set at run time.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df
