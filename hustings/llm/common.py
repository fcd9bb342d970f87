"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a character class and as the characters themselves.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: lambda variables are never inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of non-space characters of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not given and not context.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(given or "/tmp/checkpoints")
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, with their lineage cut.

    Spark removes shuffle files when the driver's garbage is collected. An operator of many steps would hold those of
    all its steps on disk until then; after a large step, `release` collects it at once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    del df
    if release:
        gc.collect()
        out.sparkSession.sparkContext._jvm.System.gc()
    return out


#: Bits for each key of a filter, and its most bits: 32 MB, whatever the number of keys.
BITS_PER_KEY, MOST_BITS = 16, 1 << 28


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """(_bucket, _bits): a bitmap of the hashed keys, of MOST_BITS at most, so that it can be broadcast at every size."""
    n = keys.count()
    bits = min(MOST_BITS, max(1 << 15, 1 << (BITS_PER_KEY * n).bit_length()))
    slot = F.pmod(F.col(key), F.lit(bits))
    found = keys.groupBy(F.floor(slot / (1 << 15)).alias("_bucket")).agg(F.bitmap_construct_agg(slot % (1 << 15)).alias("_bits"))
    return cut(found.withColumn("_size", F.lit(bits)))


def may_have(df: DataFrame, key: Column, bitmap: DataFrame) -> DataFrame:
    """df's columns as `_row`, its key as `_key`, and `_hit`: whether the key may be among the filter's; never wrongly no."""
    first = bitmap.select("_size").first()
    slot = F.pmod(F.col("_key"), F.lit(first["_size"] if first else 1 << 15))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(slot % (1 << 15) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("_byte >> cast(_slot % 8 as int) & 1")
    return (
        boxed(df, key)
        .withColumn("_slot", slot)
        .join(F.broadcast(bitmap.select("_bucket", "_bits")), F.floor(F.col("_slot") / (1 << 15)) == F.col("_bucket"), "left")
        .withColumn("_byte", byte)
        .select("_row", "_key", F.coalesce(bit == 1, F.lit(False)).alias("_hit"))
    )


def boxed(df: DataFrame, key: Column) -> DataFrame:
    """(_key, _row): whole rows beside a key, so that no column of theirs can clash with what they are joined with."""
    return df.select(key.alias("_key"), F.struct("*").alias("_row"))


def sized(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions that the session asks for."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
