"""Table access, partition spreading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data directory (one Parquet file or a directory of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Inputs of fewer bytes are small: moving them costs little, and leaving them to a few tasks costs much.
SMALL = 64 << 20


def spread(df: DataFrame, key: Column | None = None) -> DataFrame:
    """Give a small DataFrame (below SMALL bytes, by the planner's estimate) one partition per core if it has fewer.

    A table of one small file scans in one task, which leaves a costly expression to one core. A larger input is left as
    the scan splits it (spark.sql.files.maxPartitionBytes), whatever the number of cores, and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key) if key is not None else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a temporary folder, removed when the driver ends; on a cluster that is an
    error, since each machine would write into a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='quirefold-')}"
        atexit.register(_remove, spark, _LOCAL_FOLDERS[context.applicationId])
    return _LOCAL_FOLDERS[context.applicationId]


#: The temporary folders of local masters, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame once into the shared folder and read it back.

    Used where a costly result is read several times or lineage must end: the written table survives lost executors,
    and it is computed once (Dataset.checkpoint computes its input twice). The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        pass


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows, at most so many, or all if there are no more: those whose key hashes low, spread over the table.

    Unlike a top-n by hash, whose tasks each send n rows to the driver, only sampled rows leave the tasks.
    """
    count = df.count()
    if count <= most:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * 0.97 * most / count)).limit(most)


def codepoints(first: int, last: int) -> str:
    """All characters from first to last."""
    return "".join(map(chr, range(first, last + 1)))


def ordered_concat(key: Column, value: Column, separator: str) -> Column:
    """Aggregate: the values in the order of their keys, joined by a separator; nulls are left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"]), separator)
