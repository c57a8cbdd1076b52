"""Files of any file system that Spark reads, by Hadoop's API, so that mirrors and stores may lie on shared storage."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def matches(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in order of their names."""
    place, system = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in system.globStatus(place) or [])


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _at(spark, path)
    return system.exists(place)


def size(spark: SparkSession, path: str) -> int:
    place, system = _at(spark, path)
    return system.getContentSummary(place).getLength()


def remove(spark: SparkSession, path: str) -> None:
    place, system = _at(spark, path)
    system.delete(place, True)


def read_text(spark: SparkSession, path: str, most: int = 256_000_000) -> str:
    """A whole small file; ValueError if it has more than `most` bytes."""
    if size(spark, path) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file."""
    place, system = _at(spark, path)
    out = system.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
