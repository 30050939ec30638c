"""Session settings: sizes of Python batches, and settings for single actions."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch. Spark's default of 10,000 whole texts or pages can be hundreds of
#: megabytes on either side of the socket.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> SparkSession:
    """Lower the Arrow batch size from Spark's default; a size the user chose stays."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    return spark


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings, as it was afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
