"""Where intermediate results are kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from .errors import GraphError


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: a reliable checkpoint in the shared folder that spark.checkpoint.dir names.
    Only a local master, which is one machine, may go without that setting."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        place = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not context.master.startswith("local[") and context.master != "local":
                raise GraphError("set spark.checkpoint.dir to a folder that all executors share")
            place = "file://" + tempfile.mkdtemp(prefix="lattica-")
        context.setCheckpointDir(place)
    return df.checkpoint(eager=True)
