"""Single files of any Hadoop file system, published whole: written beside their place and then moved."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def move(spark: SparkSession, source: str, target: str) -> None:
    """``source`` takes the place of ``target``."""
    fs, where = _at(spark, target)
    if fs.exists(where):
        fs.delete(where, True)
    if where.getParent() is not None:
        fs.mkdirs(where.getParent())
    if not fs.rename(_at(spark, source)[1], where):
        raise OSError(f"cannot move {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def parts(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a folder that Spark has written."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(where) if not s.getPath().getName().startswith(("_", ".")))


def publish(spark: SparkSession, path: str, write, single: bool = False) -> None:
    """``write(folder)`` into a folder beside ``path``, which then takes its place; with ``single``, its one file does."""
    made = f"{path}.part-{uuid.uuid4().hex}"
    try:
        write(made)
        move(spark, parts(spark, made)[0] if single else made, path)
    finally:
        delete(spark, made)


def write_csv_file(df: DataFrame, path: str) -> None:
    """One CSV file with a header, in the order of ``df``."""
    publish(df.sparkSession, path, lambda made: df.coalesce(1).write.csv(made, header=True, escape='"'), single=True)
