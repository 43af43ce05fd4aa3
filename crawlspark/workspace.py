"""Where a job may keep intermediate tables, stream logs and WARC files."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach.

    The base is the cluster's ``spark.checkpoint.dir``. Only a local session
    without that setting falls back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="crawlspark-")
    return qualified(spark, f"{base.rstrip('/')}/crawlspark/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Intermediate tables of one run, written to a shared folder.

    A kept table is computed once, however often later steps read it, and its
    readers do not depend on the executors that computed it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_dir(spark, "scratch")
        self.kept = 0

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{self.kept:02d}-{name}"
        self.kept += 1
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)


def _on_file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def dir_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, file_system = _on_file_system(spark, path)
    return file_system.exists(hadoop_path)


def delete_dir(spark: SparkSession, path: str) -> None:
    hadoop_path, file_system = _on_file_system(spark, path)
    file_system.delete(hadoop_path, True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system Spark would use for it."""
    hadoop_path, file_system = _on_file_system(spark, path)
    return hadoop_path.makeQualified(file_system.getUri(), file_system.getWorkingDirectory()).toString()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder that holds few; none if there is no such folder."""
    hadoop_path, file_system = _on_file_system(spark, path)
    if not file_system.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in file_system.listStatus(hadoop_path))


def read_text(spark: SparkSession, path: str) -> str:
    hadoop_path, file_system = _on_file_system(spark, path)
    stream = file_system.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written under another name, then renamed over the old one."""
    folder, name = path.rsplit("/", 1)
    hadoop_path, file_system = _on_file_system(spark, path)
    draft, _ = _on_file_system(spark, f"{folder}/_{name}-{uuid.uuid4().hex}")
    stream = file_system.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop_path.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(draft, hadoop_path, overwrite)


def make_dir(spark: SparkSession, path: str) -> None:
    hadoop_path, file_system = _on_file_system(spark, path)
    file_system.mkdirs(hadoop_path)
