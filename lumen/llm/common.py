"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.session import checkpoint_dir, table_path

#: The characters that separate words: ASCII white space only.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    The files outlive a lost executor, are columnar and compressed, and give
    later readers exact sizes.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._files = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` returned and nothing reads any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._files)
    where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, whatever size Spark takes it for.

    An Arrow stage or an explode makes many rows of one, and a written file is
    compressed; estimates tell neither, and a broadcast is gathered on the driver.
    """
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Free what earlier steps left on the driver: plans, closures and broadcasts that only Python still names."""
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:  # a full collection gives unused heap back
        jvm.System.gc()


def words(text: Column) -> Column:
    """Words of a text (null: none), parted by ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def most_frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of the largest counts, at most ``most`` of them.

    The least count taken comes from a histogram of counts with sixteen steps
    an octave (a thousand rows at most), so nothing is sorted or gathered.
    """
    grade = F.floor(F.log2(F.greatest(F.col(count), F.lit(1))) * 16)
    taken, least = 0, None
    for g, n in sorted(map(tuple, counts.groupBy(grade.alias("g")).count().collect()), reverse=True):
        taken += n
        if taken > most:
            break
        least = g
    return counts.where(F.lit(False) if least is None else grade >= least)
