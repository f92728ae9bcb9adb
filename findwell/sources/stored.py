"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
FILES, JOINED = 8, 4
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session in local mode may leave it unset (tests): it gets a temporary
    folder, made once per process and removed when it ends."""
    named = spark.sparkContext.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors of {master} share")
    if not _local:
        _local["dir"] = tempfile.mkdtemp(prefix="findwell-")
        atexit.register(shutil.rmtree, _local["dir"], True)
    return "file://" + _local["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/findwell-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """Writes to the shared folder and reads back. few: for tables of short rows; where the session has many more partitions than
    cores, a task writes up to ``JOINED`` of them (more only below ``FILES`` files a core) one after the other into one file. So a task's share
    does not grow with the input."""
    spark = df.sparkSession
    path = new_path(spark, f"table-{label}")
    if few:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        files = max(FILES * spark.sparkContext.defaultParallelism, -(-parts // JOINED))
        df = df.coalesce(files) if parts >= 2 * files else df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(table: DataFrame) -> None:
    """Deletes what materialize() has written for a table, or for what was made of it, and nothing else, once nothing will read it again."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("findwell-table-"):
            drop_path(table.sparkSession, folder)
