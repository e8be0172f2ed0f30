"""Rows written once and read again, where a plan that is used many times must not run many times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def held(df: DataFrame, folder: str | None = None) -> DataFrame:
    """A checkpoint in the folder that all executors share, ``spark.checkpoint.dir``; it outlives any of them.

    ``folder`` names one where the session has none; without either it is an error, for a folder of one machine would be lost
    with it. Only a session whose executors all run on this machine (a local master) gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or folder
        if named is None and sc.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="spanloom-")
        if named is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named)
    return df.checkpoint()
