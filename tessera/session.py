"""Session helpers: the shared folder, written intermediates and small scans.

Joins are left to Spark: a side whose measured bytes are below the broadcast threshold is broadcast,
and adaptive execution splits the partitions of hot keys in the others.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bits of a broadcast filter: it has at most one row for each 64 of them.
MARKS = 1 << 23
# Bytes of an Arrow batch for a Python worker.
BATCH_BYTES = "2m"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, inside the innermost ``scratch`` if there is one."""
    return "/".join([shared_dir(spark), *_scopes.get()[-1:], f"{label}-{uuid.uuid4().hex}"])


_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scope whose intermediates are deleted when it ends.

    Everything that is written below the shared folder inside the scope goes; results must be written
    elsewhere or collected before. Without a scope intermediates stay, as results may read them late.
    """
    name = f"scratch-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{name}"
    token = _scopes.set((*_scopes.get(), name))
    try:
        yield folder
    finally:
        _scopes.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    The files outlive any executor, and later scans prune columns and push filters down.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Rows over all cores when the scan has fewer tasks than that, as with one small file.

    For inputs of heavy work; a table of many splits stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches for Python workers end at ``BATCH_BYTES``, unless the session has a limit of its own.

    Spark bounds their rows: 10,000 whole texts are tens of MB, held by the JVM outside its heap and by the worker. A longer
    row is a batch of its own.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, BATCH_BYTES)


def local_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small table of values of the driver. It goes to the JVM as Arrow, which starts no Python workers beside those of the queries."""
    return spark.createDataFrame(pa.table(columns))


def marked(rows: DataFrame, hashed: str, some: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only where the long column ``hashed`` has no value of those in ``some``.

    A filter of at most ``MARKS`` bits is broadcast, so that what surely has no partner need not move for a join. With more
    values than bits the flag holds for more rows than need be; it decides no result.
    """
    def place(name: str) -> str:
        return f"pmod(`{name}`, {MARKS}L)"
    words = some.toDF("_mark").select(F.expr(f"shiftright({place('_mark')}, 6)").alias("_word"), F.expr(
        f"shiftleft(1L, cast({place('_mark')} % 64 as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_word", F.expr(f"shiftright({place(hashed)}, 6)")).join(F.broadcast(words), "_word", "left")
    held = F.expr(f"shiftright(_bits, cast({place(hashed)} % 64 as int)) & 1L") == 1
    return met.withColumn(flag, F.coalesce(held, F.lit(False))).drop("_word", "_bits")


def possible(rows: DataFrame, hashed: Column, some: DataFrame) -> DataFrame:
    """``rows`` without those that surely have no value of ``some`` in the column ``hashed``, by ``marked``."""
    return marked(rows.withColumn("_hashed", hashed), "_hashed", some, "_possible").filter("_possible").select(*rows.columns)
