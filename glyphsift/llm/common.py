"""What the training-data operators share: working tables, ids, sized broadcasts, slices of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many bytes, rows counted first; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, of this session: below spark.checkpoint.dir.

    Where that is unset, one is made on this machine if the master is local; on a cluster, whose executors each would
    write to a disk of their own, it raises an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glyphsift-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found}/glyphsift-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once in the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glyphsift_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, Python workers get at most so many rows at a time, as those of whole texts or their shingles are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes working tables of stored() that nothing is computed from any more."""
    for df in tables:
        if path := getattr(df, "_glyphsift_path", None):
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all working tables of this session: call it once the results are written."""
    _delete(spark, shared_dir(spark))


def sized_broadcast(df: DataFrame, rows: int, row_bytes: int = 64, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast when its rows, of about row_bytes each, fit in ``most`` bytes; as it is beyond that."""
    return F.broadcast(df) if rows * row_bytes <= most else df


def whole_id(df: DataFrame, id_col: str) -> Column:
    """The id as a long, NO_ID for null. Ids that aren't whole numbers, and the number NO_ID itself, are refused."""
    kind = dict(df.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{id_col} is {kind}: ids must be whole numbers; number the rows, or hash the ids to bigint")
    number = F.col(id_col).cast("long")
    refused = F.raise_error(F.lit(f"{id_col} {NO_ID} isn't allowed: it stands for null here")).cast("long")
    return F.coalesce(F.when(number == NO_ID, refused).otherwise(number), F.lit(NO_ID))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spans(texts: pd.Series, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about so many characters of text, so that what is made from them stays small."""
    part = texts.str.len().fillna(0).cumsum().to_numpy() // most if len(texts) and texts.notna().any() else np.zeros(len(texts))
    at = np.flatnonzero(np.diff(part, prepend=-1))
    return zip(at, [*at[1:], len(texts)])


def sliced(batches: Iterator[pd.DataFrame], most: int = 1 << 20, text: str = "_x") -> Iterator[pd.DataFrame]:
    """The rows of batches in such slices."""
    for pdf in batches:
        for lo, hi in spans(pdf[text], most):
            yield pdf.iloc[lo:hi]
