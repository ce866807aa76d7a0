"""Tables that several queries read: built once a session in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_built: dict[tuple[str, str, str], tuple[str, object]] = {}
_own: list[str] = []
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="ctrlspark-"))
        named = _own[0]
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already; the folder stays
        pass


def built(spark: SparkSession, sf_dir: str, name: str, *parts: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` over ``sf_dir``: written at its first use, one part after the other, and read back at each."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        path = f"{shared_dir(spark)}/ctrlspark-tables-{uuid.uuid4().hex}/{name}"
        atexit.register(_delete, spark, path)
        for make in parts:
            before = len(_staged)
            df = make()
            df.write.mode("append").parquet(path)
            schema = df.schema
            del df
            _give_back(spark, before)
        _built[key] = (path, schema)
    path, schema = _built[key]
    return spark.read.schema(schema).parquet(path)


def _give_back(spark: SparkSession, before: int) -> None:
    """After a part is written: its staged tables go, and what its plans left on the driver.

    Without the collection the driver's heap grows to its bound on plans of finished jobs, whose
    shuffle files and broadcasts Spark's cleaner deletes only when the plans are collected.
    """
    while len(_staged) > before:
        _delete(spark, _staged.pop())
    spark._jvm.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, to cut its lineage."""
    path = f"{shared_dir(df.sparkSession)}/ctrlspark-tables-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _staged.append(path)
    atexit.register(_delete, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
