"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_RUN = uuid.uuid4().hex
_USED: dict[str, Callable[[], object]] = {}
_KEPT: dict[tuple, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset and the session is local (tests, a laptop) a temporary folder is made and
    removed at exit; on a cluster an unset folder is an error, for a machine-local one would lose data.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _OWN:
        made = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _OWN[spark.sparkContext.applicationId] = made
    return _OWN[spark.sparkContext.applicationId]


def clear() -> None:
    """Removes all that this process has written into the shared folder. What it has returned must have been read by then."""
    _KEPT.clear()
    while _USED:
        _USED.popitem()[1]()


def _clear_at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone; the folder is then left to its owner
        clear()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, under one folder for the process, which is removed when it ends."""
    run = f"{shared_dir(spark)}/tessella-{_RUN}"
    if run not in _USED:
        path, conf = spark._jvm.org.apache.hadoop.fs.Path(run), spark._jsc.hadoopConfiguration()
        _USED[run] = lambda: path.getFileSystem(conf).delete(path, True)
        atexit.unregister(_clear_at_exit)
        atexit.register(_clear_at_exit)
    return f"{run}/{uuid.uuid4().hex}/{name}"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def stamp(spark: SparkSession, folder: str) -> tuple:
    """What tells one state of a folder of tables from another: the name, length and time of each."""
    path, fs = _path(spark, folder)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def _write(df: DataFrame, path: str, partition_by: str | None) -> DataFrame:
    if partition_by:  # few files for each value, more for a large one
        df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*map(quoted, df.columns))


def remove(spark: SparkSession, path: str) -> None:
    """Takes away a table that nothing needs any more."""
    at, fs = _path(spark, path)
    fs.delete(at, True)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back: a cut in the lineage that outlives executors."""
    return _write(df, new_path(df.sparkSession, name), partition_by)


def kept(spark: SparkSession, key: tuple, name: str, df: Callable[[], DataFrame], partition_by: str | None = None) -> DataFrame:
    """`written`, once for a key in a session: later calls read the same table, as long as it is there.

    Such a table has a row for each author or more, and its files are many times smaller than its rows, so a join
    that went by their size would broadcast what the driver can't hold: the next join sorts and merges. One that
    is partitioned is read by few of its values, so that choice is left to its reader.
    """
    key = (spark.sparkContext.applicationId, *key, name)
    if key in _KEPT:
        found, path = _KEPT[key]
        at, fs = _path(spark, path)
        if fs.exists(at):
            return found
    path = new_path(spark, name)
    found = _write(df(), path, partition_by)
    _KEPT[key] = found if partition_by else found.hint("merge"), path
    return _KEPT[key][0]
