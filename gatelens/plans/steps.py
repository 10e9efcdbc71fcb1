"""Materialised steps of loops."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir; a local one only where none is set and there is one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints/gatelens")
    return found.rstrip("/")


_open: list[list[str]] = []


@contextlib.contextmanager
def discard(spark):
    """Removes, at the end, the folders of the steps that were taken inside: for rounds of a loop that leave nothing behind."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def step(df: DataFrame) -> DataFrame:
    """Write df as a table in the cluster's shared folder and read it back: lineage ends, sizes are true."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_step(df: DataFrame) -> tuple[DataFrame, int]:
    """The same with the number of rows, which the write counts."""
    seen = Observation()
    out = step(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]
