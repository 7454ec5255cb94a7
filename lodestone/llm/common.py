"""Helpers that the operators of this subpackage share.

Intermediate tables are Parquet under the folder that ``spark.checkpoint.dir``
names, which every executor and the driver can reach, so a lost executor costs
a re-read and never a result.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIR_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; where the session names none, a temporary one on a single machine, an error on a cluster."""
    found = spark.conf.get(DIR_CONF, None) or spark.sparkContext.getConf().get(DIR_CONF)
    if not found:
        found = getattr(spark, "_lodestone_dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError(f"set {DIR_CONF} to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="lodestone-")
            spark._lodestone_dir = found
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def materialize_by(df: DataFrame, name: str, column: str) -> tuple[DataFrame, str]:
    """As materialize(), in a folder for each value of a column, so that some can be deleted before others; and the path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete files that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that materialize() returned and that nothing reads any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        discard_path(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Give back what the driver has no use for between the steps of a long query.

    Spark drops the shuffles and broadcasts of finished steps only when the driver
    collects its garbage, and a heap with room grows before it does; what Python
    has freed stays with its process until it is trimmed.
    """
    gc.collect()
    spark._jvm.System.gc()
    with contextlib.suppress(OSError, AttributeError):  # C libraries without it
        ctypes.CDLL(None).malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty; other columns of docs, whatever their names, are left out."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def like_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df with the columns of docs, in their order."""
    return df.select(*[df[f"`{c}`"] for c in docs.columns])
