"""Files of any file system that Spark can reach: local paths and URIs alike."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _session(spark: SparkSession | None) -> SparkSession:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active session")
    return spark


def _at(path: str, spark: SparkSession | None):
    spark = _session(spark)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def join(root: str, *names: str) -> str:
    """A path below ``root``, whose scheme and authority stay as they are."""
    return "/".join([*([root.rstrip("/")] if root else []), *(n.strip("/") for n in names)])


def name_of(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def exists(path: str, spark: SparkSession | None = None) -> bool:
    fs, at = _at(path, spark)
    return bool(fs.exists(at))


def is_folder(path: str, spark: SparkSession | None = None) -> bool:
    fs, at = _at(path, spark)
    return bool(fs.exists(at) and fs.getFileStatus(at).isDirectory())


def files_below(path: str, spark: SparkSession | None = None) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of a file, or of every file in a folder and those below it, in the order of their paths; none if there is nothing."""
    fs, at = _at(path, spark)
    if not fs.exists(at):
        return []
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def read_text(path: str, spark: SparkSession | None = None) -> str:
    """A small text file, whole."""
    fs, at = _at(path, spark)
    stream = fs.open(at)
    try:
        return bytes(_session(spark).sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_bytes(path: str, content: bytes, spark: SparkSession | None = None) -> None:
    """A small file; an old one is replaced, folders above it are made."""
    fs, at = _at(path, spark)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def write_text(path: str, text: str, spark: SparkSession | None = None) -> None:
    write_bytes(path, text.encode("utf-8"), spark)
