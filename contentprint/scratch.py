"""Tables written once to the cluster's shared folder, from which later jobs start."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. In local mode, where the driver is the only machine, a temporary one is set if none is."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and the driver need a folder that all of them share")
        shared = tempfile.mkdtemp(prefix="contentprint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


_scopes = threading.local()


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: later jobs start there, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/contentprint-{uuid.uuid4().hex}"
    if not getattr(_scopes, "open", None):
        atexit.register(_remove, *_storage(spark), [path])  # nobody says when it isn't needed any more
    else:
        _scopes.open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _storage(spark: SparkSession) -> tuple:
    """What removing needs; it outlives the session, which may be stopped before the process ends."""
    return spark._jvm, spark._jsc.hadoopConfiguration()


def _remove(jvm, conf, paths: list[str]) -> None:
    try:
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
    except Exception:  # noqa: BLE001  the JVM has ended: what is left is the cluster's to clean
        return


def tidy(f):
    """A function that returns a DataFrame. The tables that it has cut go when it returns, but for those that the DataFrame reads:
    these go when the tidy function that called it returns and doesn't read them either, or at the end of the session."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        _scopes.open = getattr(_scopes, "open", [])
        _scopes.open.append([])
        out = None
        try:
            out = f(*args, **kwargs)
            return out
        finally:
            own = _scopes.open.pop()
            spark = SparkSession.getActiveSession() if out is None else out.sparkSession
            files = out.inputFiles() if own and out is not None else []
            read = {p for p in own if any(p.rpartition("/")[2] in x for x in files)}
            if own:
                _remove(*_storage(spark), [p for p in own if p not in read])
            for p in read:
                if _scopes.open:
                    _scopes.open[-1].append(p)
                else:
                    atexit.register(_remove, *_storage(spark), [p])

    return run
