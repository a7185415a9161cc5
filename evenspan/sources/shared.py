"""Small files in the folder that driver and executors share: created once, replaced as a whole, never half written.

All access is through Spark's own file systems, so a path may be in any store that Spark reads.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own where it is unset and all run on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = f"/tmp/evenspan-{spark.sparkContext.applicationId}"
    return at.rstrip("/")


def _at(spark: SparkSession, path: str):
    """The path with its scheme, its file system, and the JVM."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    return fs.makeQualified(at), fs, jvm


def exists(spark: SparkSession, path: str) -> bool:
    at, fs, _ = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs, _ = _at(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole."""
    at, fs, jvm = _at(spark, path)
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(stream, text: str) -> None:
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file unless it exists, and say whether it was written: of several that try at once, one does.

    The store has to create files exclusively, as HDFS does; on a local disk the system's own exclusive creation is used.
    """
    at, fs, jvm = _at(spark, path)
    fs.mkdirs(at.getParent())
    try:
        if fs.getScheme() == "file":
            file = jvm.java.io.File(at.toUri())
            if not file.createNewFile():
                return False
            jvm.org.apache.commons.io.FileUtils.writeStringToFile(file, text, "UTF-8")
        else:
            _write(fs.create(at, False), text)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a file, in place of one that may be there: readers see the old one or the new one, whole."""
    at, fs, jvm = _at(spark, path)
    fs.mkdirs(at.getParent())
    part = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    _write(fs.create(part, False), text)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, at, options)
