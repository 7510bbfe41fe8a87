"""Cutting a plan: rows in storage that every executor shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Make sure there is a checkpoint folder: the cluster's own, or on one machine a temporary one where none is named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master or "").startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pathframe-"))


def cut(df: DataFrame) -> DataFrame:
    ready(df.sparkSession)
    return df.checkpoint(eager=True)
