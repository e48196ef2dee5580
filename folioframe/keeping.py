"""Tables that are worked out once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df worked out once: in the folder of spark.checkpoint.dir, or cached where none is set."""
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None and folder:
        context.setCheckpointDir(folder)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()
