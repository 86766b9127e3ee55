"""Helpers of the corpus operators that need the session."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pathloom.llm import _words as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a folder of its own; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs a read.

    The files are left to discard(), or the owner of that folder, as those of checkpoint() are.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that no plan reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._loom_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch that goes to a Python worker; both sides hold about two of them.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, f: W.Mapper, schema: str | T.StructType) -> DataFrame:
    """df through f, in Arrow batches of BATCH_BYTES at most: long texts don't make them large.

    The bound is a setting of the session, read when the plan runs; it is set here for the whole session.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(W.frugal(f), schema)


def free_name(taken: Iterable[str], name: str) -> str:
    """name, with as many underscores before it as it takes to be no name in `taken`, in whatever case."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
