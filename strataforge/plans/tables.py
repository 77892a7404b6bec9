"""Reading input tables and cutting lineage with written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="strataforge-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or, only where unset, a local one for tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataforge-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def file_stamps(df: DataFrame) -> tuple:
    """(path, size, time of change) of every file a plan reads."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


_WRITTEN: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def release(spark: SparkSession) -> int:
    """Remove all intermediate tables written so far in this application; results not yet read can't be read any more. Returns how many."""
    from ..operators import index

    index.forget()
    own = [path for session, path in _WRITTEN if session.sparkContext.applicationId == spark.sparkContext.applicationId]
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for name in own:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    _WRITTEN[:] = [x for x in _WRITTEN if x[1] not in own]
    return len(own)


def written(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Write `df` once as a parquet table in the shared folder and read it back, so that nothing above is run again.

    The table is removed by `release`, or when the driver's JVM ends. With `drop_shuffles` the shuffle files of the writing are removed
    as it ends; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/strataforge-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    before = spark.conf.get(_CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` over all cores where its files give fewer partitions than there are (a small table in one row group); else as it is, without a shuffle."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want, key) if df._jdf.queryExecution().toRdd().getNumPartitions() < want else df
