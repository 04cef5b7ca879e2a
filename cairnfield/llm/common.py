"""Shared helpers: intermediate tables, keys and names, and text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..tables import broadcast_up_to, materialize, shared_dir, shuffles_dropped  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_tables: list[str] = []


def note_table(name: str) -> None:
    """clear() drops this table."""
    _tables.append(name)


def clear(spark: SparkSession) -> None:
    """Remove the folders and tables that this process made; call it when the results have been read."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    tables.clear(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_keys(*columns: Column) -> list[Column]:
    """Two 64-bit hashes, ka and kb, that tell rows apart by these columns: 10^10 rows hold an equal pair with odds of 1e-19."""
    return [F.xxhash64(*columns).alias("ka"), F.xxhash64(F.lit(0x9E3779B97F4A7C15 - (1 << 64)), *columns).alias("kb")]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII takes the JVM's fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased; none for null."""
    parts = F.split(lower_az(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def alnum_words_py(text: str | None) -> list[str]:
    """As alnum_words, in Python (for small tables and tests)."""
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
