"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. Sizes and parallelism are left to the cluster's own defaults.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes. A contract with many fields gets there; below
    # this limit Spark splits the expressions instead (2x faster on 80 fields).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_local_root: str | None = None


def build_session(app_name: str, **settings: str) -> SparkSession:
    """A session with the engine's settings; `settings` win over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path, for the few calls Spark has no reader or writer for."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def delete_folder(spark: SparkSession, path: str) -> None:
    system, folder = file_system(spark, path)
    system.delete(folder, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it does not exist."""
    system, folder = file_system(spark, path)
    if not system.exists(folder):
        return []
    return sorted(name for status in system.listStatus(folder) if not (name := status.getPath().getName()).startswith("."))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of text."""
    system, file = file_system(spark, path)
    stream = system.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of text, there as a whole or not at all."""
    folder, name = path.rsplit("/", 1)
    system, aside = file_system(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = system.create(aside)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename(spark, aside.toString(), path)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file or folder to a name that is free; folders above it are made."""
    system, target = file_system(spark, to)
    system.mkdirs(target.getParent())
    if system.exists(target) or not system.rename(file_system(spark, path)[1], target):
        raise OSError(f"{path} cannot become {to}")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables, below the folder named in spark.checkpoint.dir.

    Only a local-mode session without that setting gets a machine-local folder.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="tidelake-")
        root = _local_root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
