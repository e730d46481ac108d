"""Folder names of stored tables through Hadoop's file system: what Spark's readers and writers offer no call for.

Only names pass here, never rows.  All paths work on whatever store the session is set up for.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str, encoded: bool = False):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if encoded else path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``, sorted; none if it is not there."""
    fs, p = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def drop(spark: SparkSession, paths: Iterable[str], encoded: bool = False) -> None:
    """Remove folders with all they hold; what is gone already is fine.  Names that Spark gives for files are ``encoded``."""
    for path in paths:
        fs, p = _at(spark, path, encoded)
        fs.delete(p, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file as a mark."""
    fs, p = _at(spark, path)
    fs.create(p, True).close()
