"""Session helpers: checkpoint location and checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its measured size stays below this bound.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are threads of the driver (``local``,
    ``local[n]``: tests, a single machine) gets a folder of its own that goes with it. Any other
    session must name one, since its executors could not read each other's files.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        own = tempfile.mkdtemp(prefix="marketlens-")
        _remove_at_exit(spark, own)
        sc.setCheckpointDir(own)
        current = sc.getCheckpointDir()
    return current


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, none if it does not exist yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(target) if f.isDirectory())


def scratch_dir(spark: SparkSession, name: str = "run") -> str:
    """A new folder name in the shared folder; the folder goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The frame written once as Parquet to the shared folder, and reread: cuts the lineage,
    survives any executor, and can be read by column."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that :func:`stored` returned, once all that read them is written
    as well; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            remove_folder(df.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files of a frame that :func:`stored` returned; no job is run."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in tasks, also where it is not installed on the workers: it
    is sent once per session as ``addPyFile`` sends a file."""
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    if any(os.path.basename(f) == f"{name}.zip" for f in spark.sparkContext.listFiles):
        return
    target = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, files in os.walk(package):
            for file in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, file)
                out.write(path, os.path.join(name, os.path.relpath(path, package)))
    spark.sparkContext.addPyFile(target)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured_bytes(df: DataFrame) -> int:
    """Size of a frame as a hash relation would hold it, from one small aggregate."""
    width = F.lit(32)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0)) + F.lit(8)
        elif kind in ("array", "struct", "map"):
            width = width + F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0)) + F.lit(8)
        else:
            width = width + F.lit(8)
    row = df.agg(F.sum(width.cast("long")).alias("b")).first()
    return int(row["b"] or 0)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    return measured_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast when the frame was measured to fit, else leave the join to AQE."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df
