"""Session helpers: lineage cuts and scratch tables on shared storage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own, which goes
    with the process; a cluster session without it is refused, because a
    machine-local folder would be lost together with the executor that wrote it.
    All scratch tables lie in one sub-folder, which is removed at the end.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder on shared storage")
            folder = tempfile.mkdtemp(prefix="blackspot-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    folder = f"{sc.getCheckpointDir()}/tables"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), folder)
    return folder


_FOLDERS: set[str] = set()


def _remove(jvm, conf, path: str) -> None:
    """Delete a folder on any storage; that it is gone already, or the session is, does not matter."""
    with contextlib.suppress(Exception):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Materialise ``df`` as a table on shared storage and go on from there.

    A written table survives lost executors like a checkpoint does, is read back
    by column, and carries no constraints of its old plan into the next round of
    a loop. ``replaces`` is the result of an earlier ``cut`` that nothing reads
    any more once this one is written; its files are deleted.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    if replaces is not None:
        forget(replaces)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a ``cut`` that nothing reads any more; other tables are left alone."""
    path = getattr(df, "_scratch", None)
    if path:
        sc = df.sparkSession.sparkContext
        _remove(sc._jvm, sc._jsc.hadoopConfiguration(), path)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing refers to any more.

    It does so when the driver collects garbage, which a driver with little to do may not in the whole of a loop.
    """
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a table written and read back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
