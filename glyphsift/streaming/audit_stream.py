"""The audit over a stream of documents: stateless per document, totals for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import summary, text_items

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def audit(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends items, and the summary of each batch, as Parquet below out; ends when all files there are read."""

    def write(batch: DataFrame, number: int) -> None:
        items = text_items(batch).persist()
        # Named by batch and overwritten: a batch that runs twice is written once.
        items.write.mode("overwrite").parquet(f"{out}/items/batch={number}")
        summary(items).write.mode("overwrite").parquet(f"{out}/summary/batch={number}")
        items.unpersist()

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
