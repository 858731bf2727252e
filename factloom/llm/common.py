"""What the operators share: tables, the shared scratch folder, and files that every executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from functools import lru_cache

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Working columns start with this, so that they never clash with a caller's own.
P = "__fl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the session is local (tests, a laptop) a temporary folder takes its place. A path
    without a scheme lies in Hadoop's default file system.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "factloom-shared")
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/factloom-{sc.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "t") -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there, and no executor holds the only copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{tag}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from `written` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._factloom_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def files_at(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI and the path in it; file:/x, file:///x and plain paths are local."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


@lru_cache(maxsize=4096)
def multipliers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd multipliers and n addends of 64 bits, the same in every process."""
    g = np.random.Generator(np.random.Philox(seed))
    return g.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, 2**63, n, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
