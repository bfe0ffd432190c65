"""Intermediate rows of operators that go in rounds: kept in the shared folder, so that lineage stays short."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(rows: DataFrame) -> DataFrame:
    """``rows``, computed once, in the folder that the session names for checkpoints. Without one, a temporary folder serves a
    session in one process; on a cluster the missing name is an error."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="maskloom-"))
    return rows.checkpoint()
