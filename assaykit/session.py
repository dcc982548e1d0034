"""Session settings and the two helpers every multi-step operator uses."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only after it was measured and found to have at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def get_session(app: str = "assaykit", cpus: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested with.

    On a cluster the session comes from spark-submit and this is not called.
    """
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage.

    The folder is the one the session names in spark.checkpoint.dir. Only where none is named, as in
    local tests, a temporary folder is used; a cluster must set it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="assaykit-checkpoint-"))
    return df.checkpoint(eager=True)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
        return F.size(c) * 8
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.length(F.to_json(F.struct(c)))
    return F.lit(8)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is measured to have at most so many rows and bytes, else df as it is.

    Call it on a materialised (cut) table: it is read once. Beyond the limits Catalyst joins by shuffle and
    adaptive execution splits skewed partitions.
    """
    width = F.lit(0)
    for f in df.schema.fields:
        width = width + F.coalesce(_bytes(F.col(f"`{f.name}`"), f.dataType), F.lit(0))
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df
