"""Intermediate results of the operators, in the folder that driver and executors share."""

from pyspark.sql import SparkSession

from tessella.sources.shared import dropped, forget, settled, shared_dir, written

__all__ = ["ROWS", "dropped", "few_rows", "forget", "settled", "shared_dir", "written"]

#: Rows of texts that Spark hands to Python, and back, at once.
ROWS = 2000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_rows(spark: SparkSession) -> None:
    """Let Spark exchange texts with Python in batches of at most `ROWS` rows, since several buffers of a batch exist at once; a smaller setting stays."""
    now = int(spark.conf.get(_ROWS_SETTING))
    if now <= 0 or now > ROWS:
        spark.conf.set(_ROWS_SETTING, str(ROWS))
