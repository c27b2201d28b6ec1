"""Python workers that have this package, whatever is installed on their machines."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Spark's bound on the bytes of the rows that a Python worker gets at once, and the lower one that takes its place.
_BYTES, _DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16m"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each application: they then need no installation of their own."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp()) / "strandlab-workers.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def trim() -> None:
    """Give memory that is free inside the process back to the machine (glibc; elsewhere Arrow's alone)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _trimmed(run: Callable) -> Callable:
    """run, whose worker gives back its free memory when a task has ended: workers live on, for other stages' tasks."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return own


def mapped(df: DataFrame, run: Callable, kind: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, kind), on workers that have this package, in batches of BATCH_BYTES (one longer row comes
    alone) unless the session has a bound of its own."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BYTES) == _DEFAULT:
        spark.conf.set(_BYTES, BATCH_BYTES)
    return df.mapInArrow(_trimmed(run), kind)
