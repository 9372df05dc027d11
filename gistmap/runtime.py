"""Small helpers around the session: reading tables, spreading work, shared storage."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once; they need no path of their own to it."""
    sc = spark.sparkContext
    if getattr(sc, "_gistmap_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="gistmap-"), "gistmap.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("gistmap", os.path.relpath(full, here)))
    sc.addPyFile(target)
    sc._gistmap_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``; columns are pruned by what a plan selects."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle that feeds costly Python steps (a fixed number is not coalesced)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


_SHUFFLED = re.compile(r"\b(?:\w*Join|Aggregate|Distinct|Deduplicate|Window|Sort|Repartition\w*|Intersect|Except)\b")


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Round-robin a frame that is scanned in fewer partitions than there are cores.

    Only small inputs (one file, one row group) are touched; a frame that already has enough splits
    is returned as it is, so a large scan gets no extra shuffle. Frames with a shuffle of their own are
    left to adaptive execution (asking for their partitions would run them).
    """
    if _SHUFFLED.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    want = at_least or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want * 2)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; only where that is unset, and the
    session is local, a temporary one is made."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = os.path.join(tempfile.gettempdir(), f"gistmap-checkpoint-{os.getpid()}")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table(df: DataFrame, stem: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (a cut that keeps columns prunable); a folder for each value of ``by``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a scratch table (written without ``by``) that nothing reads any more, and let Spark drop the shuffle files behind it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def files_by(df: DataFrame, by: str) -> dict[int, list[str]]:
    """The files of a scratch table for each (whole) value of ``by``."""
    out: dict[int, list[str]] = {}
    for f in sorted(df.inputFiles()):
        out.setdefault(int(re.search(rf"/{by}=(\d+)/[^/]*$", f).group(1)), []).append(f)
    return out


def read_files(uris: list[str], columns: list[str]) -> pa.Table:
    """Columns of Parquet files in the shared folder, read within a task."""
    out = []
    for uri in uris:
        system, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
        with system.open_input_file(path) as f:
            out.append(pq.ParquetFile(f).read(columns=columns, use_threads=False))
    return pa.concat_tables(out)
