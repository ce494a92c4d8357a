"""Small files on whatever store a path names, through the file systems that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(path: str, text: str) -> None:
    """text as the file at path, whose folders are made; what is there is replaced."""
    fs, p = _at(path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(path: str) -> str:
    fs, p = _at(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def exists(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def names(folder: str) -> list[str]:
    """Names below folder, sorted; none if it isn't there."""
    fs, p = _at(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
