"""Cutting lineage: what is computed once is written where every executor can read it again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where that is unset and Spark runs on one machine, as in tests, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(wanted or os.path.join(tempfile.gettempdir(), "pagelumen-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a table written in the shared folder, which is left for the folder's owner to clear.

    A table rather than ``checkpoint()``: a checkpointed frame keeps constraints of the plan it came from, over which the optimizer fails where
    such frames are united and joined again.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
