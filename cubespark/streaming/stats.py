"""Rolled query logs to the statistics table, as a stream of files.

Spark's file stream knows a file by its path and takes it once. A ledger beside it notes the time
and size of each file that was taken, so that files that were written anew since are found and
their rows replaced.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.operators.querylog import STATS_SCHEMA
from cubespark.plans.partitions import decoded_path

# Fixed value: a rolled log is named by the time it was closed; the live log is not.
ROLLED = r"\.(\d{4}-\d{2}-\d{2}-\d{2}(?:-\d{2})?)(?:/[^/]*)?$"


def rolled_logs(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Rows of closed log files with partition ``dt`` and the file they come from, its time and size.

    Hidden files are left out by Spark, the live log by its name.
    """
    reader = (
        spark.readStream.schema(STATS_SCHEMA)
        .option("recursiveFileLookup", True)
        # a file is new when it is found, however old its time is
        .option("maxFileAge", "36500d")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.json(path).select(
        *STATS_SCHEMA.fieldNames(),
        decoded_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_size").alias("size"),
    )
    return _named(rows, path, F.col("path"))


LEDGER = "log_file string, dt string, time timestamp, size bigint"


def _write_rows(rows: DataFrame, out: str) -> None:
    """Replace the partitions of the files that the rows come from."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt", "log_file")
        .json(out)
    )


def _named(df: DataFrame, path: str, file: Column) -> DataFrame:
    """With ``dt`` and ``log_file``, the path below the root: hosts may use the same file names."""
    plain = F.regexp_replace(file, "^file:/+", "/")
    root = re.sub("^file:/+", "/", path).rstrip("/") + "/"
    below = F.when(plain.startswith(root), F.substring(plain, len(root) + 1, 1 << 20)).otherwise(plain)
    return df.withColumns({"dt": F.regexp_extract(plain, ROLLED, 1), "log_file": below}).filter(F.col("dt") != "")


def listed_logs(spark: SparkSession, path: str) -> DataFrame:
    """Closed log files as they are now; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select("path", F.col("modificationTime").alias("time"), F.col("length").alias("size"))
    return _named(files, path, F.col("path")).select("path", "log_file", "dt", "time", "size")


def ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Time and size of each file when its rows were last taken."""
    noted = spark.read.schema(LEDGER + ", at bigint").option("recursiveFileLookup", True).parquet(f"{checkpoint}_ledger")
    latest = noted.groupBy("log_file").agg(F.max_by(F.struct("dt", "time", "size"), "at").alias("f"))
    return latest.select("log_file", "f.*")


def _note(files: DataFrame, checkpoint: str, name: str) -> None:
    at = (F.unix_micros(F.current_timestamp())).alias("at")
    files.select("log_file", "dt", "time", "size", at).write.mode("overwrite").parquet(f"{checkpoint}_ledger/{name}")


def changed_logs(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Files that have another time or size now than when they were taken, and with a null time those
    that are not listed any more: gone, or empty. Asked after a run of the stream."""
    now = listed_logs(spark, path).select("log_file", F.struct("path", "dt", "time", "size").alias("now"))
    then = ledger(spark, checkpoint).select("log_file", "dt", F.struct("time", "size").alias("then"))
    both = now.join(then, "log_file", "full")
    # files that the stream took without any rows are not in the ledger; size -1 is known to be gone
    same = F.struct("now.time", "now.size").eqNullSafe(F.col("then"))
    asked = both.filter(~F.coalesce(same, F.lit(False)) & (F.col("now").isNotNull() | (F.col("then.size") > 0)))
    return asked.select("log_file", F.coalesce("now.dt", "dt").alias("dt"), "now.path", "now.time", "now.size")


def refresh_stats(spark: SparkSession, path: str, out: str, checkpoint: str) -> int:
    """Replace the rows of log files that were written anew since they were taken; their number.

    A file that is empty now leaves no rows, one that is gone keeps those that it had. Files are
    noted last, so after a failure they are done again.
    """
    files = [r.asDict() for r in changed_logs(spark, path, checkpoint).collect()]  # a short row per changed file
    if not files:
        return 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda text: jvm.org.apache.hadoop.fs.Path(text)
    kept = set()
    if paths := [f["path"] for f in files if f["path"]]:
        rows = spark.read.schema(STATS_SCHEMA).json(paths)
        rows = _named(rows.select("*", decoded_path(F.col("_metadata.file_path")).alias("_file")), path, F.col("_file")).drop("_file")
        _write_rows(rows, out)
        kept = {r["log_file"] for r in rows.select("log_file").distinct().collect()}
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    now = datetime.now()
    for f in files:
        if f["path"] is None:
            file = at(f"{path.rstrip('/')}/{f['log_file']}")
            there = file.getFileSystem(conf).exists(file)
            f |= {"time": now, "size": 0 if there else -1}
            kept |= set() if there else {f["log_file"]}
        if f["log_file"] not in kept:
            gone = at(f"{out}/dt={escape(f['dt'])}/log_file={escape(f['log_file'])}")
            gone.getFileSystem(conf).delete(gone, True)
    noted = spark.createDataFrame([tuple(f[c] for c in ("log_file", "dt", "time", "size")) for f in files], LEDGER)
    _note(noted, checkpoint, f"refresh-{now:%Y%m%d%H%M%S%f}")
    return len(files)


def ingest_stats(
    spark: SparkSession, path: str, out: str, checkpoint: str, max_files: int | None = None
) -> None:
    """Take in all new log files, and those that were written anew, then stop.

    A partition belongs to one file, so a file that comes again, or a batch
    that runs again after a failure, replaces its own rows and no others.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            _write_rows(batch.drop("path", "time", "size"), out)
            _note(batch.select("log_file", "dt", "time", "size").distinct(), checkpoint, f"batch-{number}")
        finally:
            batch.unpersist()

    _note(spark.createDataFrame([], LEDGER), checkpoint, "none")  # there before the first batch
    query = (
        rolled_logs(spark, path, max_files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    refresh_stats(spark, path, out, checkpoint)
