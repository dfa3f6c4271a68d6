"""The monthly rollup kept up to date while log files arrive.

Sums are additive, so a micro-batch only has to be rolled up itself: each batch
adds one small delta table, written under its batch number (a replayed batch
overwrites its own delta). Every ``FOLD`` batches the deltas since the last fold and
that fold are summed into a new one, under the batch's number. What a fold replaces is
deleted by a later batch only: by then the fold's batch is committed and is never
replayed. So the folders stay bounded however long the stream runs, late rows simply
land in their month, and any batch can be redone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallycast.operators.rollups import monthly_rollup
from tallycast.storage import drop_scratch


FOLD = 16  # batches from one fold to the next


def stream_logs(
    spark: SparkSession, table: str, schema: StructType, fmt: str = "parquet", pattern: str | None = None
) -> DataFrame:
    """A file stream over a table: a folder of log files, or a single file."""
    reader = spark.readStream.schema(schema).format(fmt).option("header", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # Written as a pattern that matches the table alone: a plain path would have to be a folder.
    path = table.rstrip("/")
    if re.search(r"[\\\[\]{}*?]", path):
        raise ValueError(f"a stream over a path with pattern characters reads files more than once: {path}")
    return reader.load(f"{path[:-1]}[{path[-1]}]")


def _finished(spark: SparkSession, folder: str) -> dict[int, str]:
    """Completely written tables below a folder by their number."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    found = [(int(str(s.getPath().getName()).split("=")[1]), s.getPath()) for s in files.listStatus(path)]
    marker = context._jvm.org.apache.hadoop.fs.Path
    return {number: place.toString() for number, place in found if files.exists(marker(place, "_SUCCESS"))}


def _sum_until(spark: SparkSession, entity: str, out: str, value: str, last: int | None, before: int | None = None) -> DataFrame:
    """The latest fold (below ``before``, if given) and the deltas after it, up to batch ``last``."""
    deltas, folds = _finished(spark, f"{out}/deltas"), _finished(spark, f"{out}/folds")
    base = max((n for n in folds if before is None or n < before), default=-1)
    paths = [folds[base]] if base >= 0 else []
    paths += [path for n, path in sorted(deltas.items()) if n > base and (last is None or n <= last)]
    return spark.read.parquet(*paths).groupBy(entity, "year", "month_num").agg(F.sum(value).alias(value))


def write_batch(batch: DataFrame, batch_id: int, entity: str, out: str, value: str = "timelog", fold: int = FOLD) -> None:
    """The delta of one batch and, where its number closes a block of ``fold``, the fold up to it.

    Batches come in order; the same one may come again. Batch ``batch_id`` being here means that
    those before it are committed, so what their folds replace can go.
    """
    spark = batch.sparkSession
    deltas, folds = _finished(spark, f"{out}/deltas"), _finished(spark, f"{out}/folds")
    settled = max((n for n in folds if n < batch_id), default=-1)
    for path in [p for n, p in deltas.items() if n <= settled] + [p for n, p in folds.items() if n < settled]:
        drop_scratch(spark, path)
    monthly_rollup(batch, entity, value).write.mode("overwrite").parquet(f"{out}/deltas/batch={batch_id}")
    if batch_id % fold == fold - 1:
        summed = _sum_until(spark, entity, out, value, batch_id, batch_id)
        summed.write.mode("overwrite").parquet(f"{out}/folds/upto={batch_id}")


def run_monthly_rollup(logs: DataFrame, entity: str, out: str, value: str = "timelog") -> None:
    """Process everything that has arrived since the last call, then stop.

    ``out`` holds the deltas, the folds and the stream's progress; it must lie in shared
    storage. Calling again continues where the last call ended.
    """
    query = (
        logs.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, entity, out, value))
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def month_deltas(spark: SparkSession, entity: str, out: str, value: str = "timelog") -> DataFrame:
    """The rollup so far: the latest fold and the deltas after it, summed per entity and month."""
    return _sum_until(spark, entity, out, value, None)
