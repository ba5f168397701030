"""Paths for tables that a job writes on its way, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


_made: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names.

    Where that setting is missing, a local folder serves a single machine, as in
    tests; on a cluster it is an error, as no folder of one machine would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _made.append(f"{(base or _own_folder()).rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> tuple[str, ...]:
    """The scratch paths that this process has named and not discarded."""
    return tuple(_made)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete paths; frames that read them are of no use afterwards, so store results first."""
    for path in list(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _made:
            _made.remove(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables that are made inside; what is of use afterwards has to be stored inside."""
    before = set(_made)
    try:
        yield
    finally:
        discard(spark, [p for p in _made if p not in before])


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
