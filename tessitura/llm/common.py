"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def free_name(taken, base: str) -> str:
    """``base``, or ``base`` with underscores if a column already has that name."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir); a local one only where it is unset on one machine, as in tests."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master.partition("[")[0] != "local":  # other machines would not see it
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` kept in the shared folder, its lineage cut; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once however often it is used, and kept when executors are lost."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release() -> None:
    """Gives memory that an Arrow function no longer needs back, so that workers which are used again stay small."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


_MAP_BITS = 4096 * 8


def likely(rows: DataFrame, key, keys: DataFrame, bits: int = 26, flag: str | None = None) -> DataFrame:
    """The ``rows`` whose ``key`` (a long) is among ``keys`` (one long column), and by chance some others.

    With ``flag``: all rows, those marked true in that column.
    The keys become a bitmap of 2**bits bits, so what is broadcast is at most
    2**bits / 8 bytes whatever their number; a full bitmap lets all rows pass.
    Null keys do not pass."""
    slot = F.pmod(F.col(keys.columns[0]), F.lit(1 << bits))
    maps = keys.select(F.floor(slot / _MAP_BITS).alias("bitmap_no"), (slot % _MAP_BITS).alias("at")).groupBy("bitmap_no").agg(F.expr("bitmap_construct_agg(at)").alias("bitmap"))
    own, number, bitmap = (free_name(rows.columns, x) for x in ("slot", "bitmap_no", "bitmap"))
    slotted = rows.withColumn(own, F.pmod(key, F.lit(1 << bits))).withColumn(number, F.floor(F.col(own) / _MAP_BITS))
    if number != "bitmap_no" or bitmap != "bitmap":
        maps = maps.withColumnsRenamed({"bitmap_no": number, "bitmap": bitmap})
    at = F.col(own) % _MAP_BITS
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    found = slotted.join(F.broadcast(maps), number, "left" if flag else "inner")
    own_columns = [F.col(f"`{c}`") for c in rows.columns]
    return found.select(*own_columns, F.coalesce(bit, F.lit(False)).alias(flag)) if flag else found.where(bit).select(own_columns)
