"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and all runs on one machine (tests, local runs) a fresh local folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("corvane.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-corvane-")
        spark.conf.set("corvane.scratch.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow``, after which a worker gives the memory that it no longer needs back to the machine.

    Workers live on from stage to stage and would each keep the peak of all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(run, schema)


def small_batches(df: DataFrame, rows: int = 1000, size: int = 4 << 20) -> DataFrame:
    """Bound what a Python worker holds at once: batches of ``rows`` rows and about ``size`` bytes at most.

    Spark has these bounds as settings of the session alone; they are lowered, never raised.
    Workers on this machine also learn where this package lies; a cluster gets it by --py-files.
    """
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


#: Keys with more than one in so many of all rows are joined apart; there are fewer of them than this.
HOT = 1000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has a row for each key and in ``rows`` how many of the ``total`` rows of left have it.

    Rows of a hot key stay in the tasks that read them: the fewer than ``HOT`` hot rows of right are sent to all. The others meet by a shuffle.
    """
    hot = F.broadcast(right.filter(F.col(rows) * HOT > total))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.filter(F.col(rows) * HOT <= total), keys)
    return left.join(hot, keys).unionByName(rest)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
