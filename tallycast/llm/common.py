"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables larger than this are never broadcast; the join is then shuffled.
BROADCAST_BYTES = 32 << 20

SALT = 1 << 20  # rows of one key that are joined in one task, about
LOWER_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def broadcast_if_small(df: DataFrame, measured_bytes: int) -> DataFrame:
    """Hint a broadcast only for a table whose measured size is within the bound."""
    return F.broadcast(df) if measured_bytes <= BROADCAST_BYTES else df


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], n: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other``, which has one row per key and, as ``n``, how many rows meet it.

    A key met by more than ``SALT`` rows is repeated, and its rows are dealt over the copies by a hash of
    ``spread``. Such keys are at most one for ``SALT`` rows; their list is broadcast if it is small.
    """
    copies = other.withColumn("salts", F.expr(f"CAST(ceil({n} / {SALT}) AS INT)")).drop(n)
    hot = copies.where("salts > 1").select(*keys, "salts")
    hot = broadcast_if_small(hot, 64 * hot.count())
    copies = copies.withColumn("salt", F.explode(F.expr("sequence(0, greatest(salts, 1) - 1)"))).drop("salts")
    marked = rows.join(hot, keys, "left").withColumn("salt", F.expr(f"CAST(pmod(xxhash64({spread}), coalesce(salts, 1)) AS INT)"))
    return marked.drop("salts").join(copies, [*keys, "salt"], how).drop("salt")


def process_cache(key: str, build: Callable[[], Any]) -> Any:
    """An object kept by a Python worker over all tasks it runs (functions travel by value)."""
    holder = sys.modules.setdefault("_worker_objects", types.ModuleType("_worker_objects"))
    if not hasattr(holder, key):
        setattr(holder, key, build())
    return getattr(holder, key)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
