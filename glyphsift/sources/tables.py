"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes that a Python worker gets at a time: whole texts and files, of which it holds several copies.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def limit_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES. By default a worker holds up to 10,000 rows, so its
    memory grows with a task's rows until there are so many. Plans are made when they run, so the setting stays."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        found = int((spark.conf.get(key, None) or "-1").rstrip("b"))
        if found <= 0 or found > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; one of fewer files than the session has cores is spread over them, as a file of one row group is
    read by one task however many there are. Larger tables are read as they lie, without a shuffle."""
    df, cores = spark.read.parquet(f"{folder}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
