"""Where a job may keep tables that all executors share, and small session helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the application, wherever they run (once)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="wafergrid-")) / "wafergrid.zip"  # on the driver; Spark serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset (tests, one machine) an own folder is set."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = sc.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="wafergrid-")
        sc.setCheckpointDir(_OWN[app])
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/wafergrid/{name}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """As ``fresh_path``; what is there is removed with the tables of ``written``."""
    _WRITTEN.append(path := fresh_path(spark, name))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: the lineage is cut, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, whatever its scheme, and the path as it names it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def published(df: DataFrame, path: str) -> bool:
    """Write ``df`` beside ``path`` and rename it to ``path``: readers see the whole table or none. False, and nothing is done, if the path is there already."""
    if path_exists(df.sparkSession, path):
        return False
    folder, name = path.rstrip("/").rsplit("/", 1)
    beside = f"{folder}/_{name}-{uuid.uuid4().hex}"  # a name that Spark's readers pass over
    df.write.parquet(beside)
    fs, source = _file_system(df.sparkSession, beside)
    if fs.exists(target := _file_system(df.sparkSession, path)[1]) or not fs.rename(source, target):
        fs.delete(source, True)
        raise FileExistsError(f"{path} was published by another job meanwhile")
    return True


def published_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables published in a folder, in order; none if the folder isn't there."""
    fs, at = _file_system(spark, folder)
    return sorted(n for f in fs.listStatus(at) if f.isDirectory() and not (n := f.getPath().getName()).startswith(("_", "."))) if fs.exists(at) else []


@atexit.register
def drop_written() -> None:
    """Remove the tables that this process wrote with ``written``: at its end, or earlier where no result of a query is used any more."""
    import pyarrow.fs as pafs

    while _WRITTEN:
        try:
            fs, path = pafs.FileSystem.from_uri(_WRITTEN.pop())
            fs.delete_dir(path)
        except Exception:  # gone already, or a store that can't be reached: nothing depends on it
            continue


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
