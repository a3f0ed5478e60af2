"""Intermediate tables in the folder the cluster shares between its executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Row groups small enough that what few tasks wrote is read by many: a scan splits files by row group.
ROW_GROUP_BYTES = 4 * 1024 * 1024

_LOCAL_SCRATCH: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}  # paths handed out, by application
_NAMED: dict[str, list[str]] = {}  # tables entered in the session's catalog, by application


def scratch_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="brindle-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.conf.get("spark.app.id", "local"), []).append(path)
    return path


def note_table(spark: SparkSession, name: str) -> None:
    """Remember a catalog entry of an intermediate table, so that ``release`` takes it back."""
    _NAMED.setdefault(spark.conf.get("spark.app.id", "local"), []).append(name)


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables of this application and their catalog entries; call it once its results have been taken.

    The caller owns these tables: results are read lazily, so nothing here can tell when they are done.
    """
    paths = _WRITTEN.pop(spark.conf.get("spark.app.id", "local"), [])
    for name in _NAMED.pop(spark.conf.get("spark.app.id", "local"), []):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def write_out(df: DataFrame, label: str, compact: bool = False) -> DataFrame:
    """Write ``df`` once and read it back.

    Lineage ends at the written files, so a lost executor costs one task rather than the whole
    history. Reading back also gives the optimizer the true size on disk: a join with a table that
    went through here is broadcast only if that size is below the session's broadcast threshold.
    ``compact`` packs tables of as many rows as the input more tightly; not meant for tables to join, whose
    size in memory would be far above that on disk.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.option("parquet.block.size", ROW_GROUP_BYTES)
    (writer.option("compression", "zstd") if compact else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

