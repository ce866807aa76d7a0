"""Tables written to the cluster's shared folder, to cut lineage or to be read twice."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_runs: dict[str, str] = {}
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _runs.setdefault("own", tempfile.mkdtemp(prefix="ctrlspark-"))
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already; the folder stays
        pass


def run_dir(spark: SparkSession) -> str:
    """One folder per driver process below the shared one, removed when the process ends."""
    base = shared_dir(spark)
    if base not in _runs:
        _runs[base] = f"{base}/ctrlspark-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, _runs[base])
    return _runs[base]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    _, path = _paths.pop(id(df))
    _delete(df.sparkSession, path)

