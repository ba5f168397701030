"""Helpers shared by the corpus operators."""

from __future__ import annotations

import shutil
import tempfile
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, written

__all__ = ["arrow_batches", "digest128", "scratch", "table", "text_of", "written"]


@cache
def _shipped(application: str, context) -> None:
    """Give this package to the Python workers of an application."""
    root = Path(__file__).resolve().parents[2]
    base = str(Path(tempfile.mkdtemp(prefix="spark-")).resolve() / "package")
    context.addPyFile(shutil.make_archive(base, "zip", root, Path(__file__).resolve().parents[1].name))


#: Most rows and bytes of the batches that Python tasks take, since a row may be a whole text.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def arrow_batches(spark: SparkSession) -> None:
    """Prepare Python tasks: ship this package, and bound the Arrow batches of the session where it sets no lower bound.

    Plans read these bounds when they run, which may be after an operator has
    returned, so they are one and the same for all operators and stay set.
    """
    _shipped(spark.sparkContext.applicationId, spark.sparkContext)
    for name, most in BATCH.items():
        own = spark.conf.get(name, None)
        if not (own and own.isdigit() and 0 < int(own) <= most):
            spark.conf.set(name, str(most))


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def digest128(column: Column, prefix: str = "d") -> list[Column]:
    """Two 64-bit hashes that together identify a value."""
    return [
        F.xxhash64(column).alias(f"{prefix}1"),
        F.xxhash64(F.lit("second"), column).alias(f"{prefix}2"),
    ]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
