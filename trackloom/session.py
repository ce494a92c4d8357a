"""Session set-up and the two helpers that decide how small things travel."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType, VariantType

#: A side of a join is broadcast only if it has at most so many rows and, by its rows' width, so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trackloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, named by spark.checkpoint.dir.

    A temporary one is set only where none is named and the master is local, as in tests; it goes with
    the process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="trackloom-", dir=os.environ.get("TMPDIR"))
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _width(kind: DataType) -> int | None:
    """Bytes of a value of fixed width, None for texts, arrays and the like."""
    if isinstance(kind, StructType):
        widths = [_width(f.dataType) for f in kind]
        return None if None in widths else sum(widths)
    return None if isinstance(kind, (ArrayType, MapType, StringType, BinaryType, VariantType)) else 8


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, hinted for broadcast if counting shows that it has at most so many rows and bytes.

    Counting stops at rows + 1. Values of fixed width count 8 bytes, others the length of their text;
    names and ids of a join stay far below the limit, rings with thousands of corners don't. Beyond it
    the join is left to shuffle, with the skew handling of adaptive execution.
    """
    fixed = sum(8 if (w := _width(f.dataType)) is None else w for f in df.schema)
    loose = [f.name for f in df.schema if _width(f.dataType) is None]
    width = F.lit(0).cast("long")
    for n in loose:
        width = width + F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{n}`")))), F.lit(0))
    n, b = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).head()
    return F.broadcast(df) if n <= rows and n * fixed + b <= size else df
