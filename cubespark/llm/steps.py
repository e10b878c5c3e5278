"""Tables between the steps of one operator, in the shared folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.session import new_dir, settings

BROADCAST_ROWS = 1_000_000
# texts on their way to a Python worker are held by it and, outside its heap, by the executor
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small(df: DataFrame, rows: int) -> DataFrame:
    """A few numbers per row, for all executors if there are few rows; beyond that Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Steps:
    """Writes a step's result and reads it again, so a lost executor costs one step at most.

    What came before a written table is not needed any more: its shuffle files go with
    the next collection of the driver's garbage, which is asked for here, and tables
    that no later step reads are dropped.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        path = self.paths[label] = new_dir(self.spark, label)
        with settings(
            self.spark,
            spark_sql_execution_arrow_maxRecordsPerBatch=BATCH_ROWS,
            spark_sql_execution_arrow_maxBytesPerBatch=BATCH_BYTES,
        ):
            df.write.parquet(path)
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.parquet(path)

    def drop(self, *labels: str) -> None:
        """Remove tables of finished steps."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(label))
            path.getFileSystem(conf).delete(path, True)
