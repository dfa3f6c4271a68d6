"""Sharding by sampled splitters: near-equal bytes per shard, equal texts kept together.

Rows are ordered by a hash of the text. A sample drawn in proportion to size gives quantile
boundaries, which cut the order into ranges; exact sums per range follow, and ranges that
hold more than twice their share are subdivided. Texts that with their copies outweigh a
hundredth of a shard are ranges of their own, subdivided by document into such hundredths.
These go to the least loaded shards first, a text's pieces together unless they outweigh a
whole shard; the other ranges fill each shard up to the same level, in order. Every range is
one sorted run in one task, so nothing larger meets anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import table, text_of
from tallycast.storage import materialise

_ROWS_PER_RANGE = 1_000_000
_SAMPLES_PER_RANGE = 32


def _uniform(*columns) -> F.Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def shard_by_bytes(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 16, tolerance: float = 0.01) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    Size is the text's UTF-8 bytes plus one, a null text counting as empty. Shards' sizes
    are near equal: they differ by about ``tolerance`` unless single rows are larger. Rows of
    equal text share a shard unless together they outweigh one. Slots count from 0 in each
    shard without gaps. Repeated rows get a slot each; other columns are ignored.
    """
    slim = docs.select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
        F.xxhash64(text_of()).alias("key"),
        F.xxhash64("doc_id").alias("tie"),
    )
    rows = materialise(slim, "shard-rows")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = max(1.0, total / shards)
    n_ranges = max(shards * ranges_per_shard, -(-count // _ROWS_PER_RANGE))

    # Heavy texts: at most shards / tolerance of them.
    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    heavy = heavy.where(F.col("bytes") > tolerance * share).collect()
    heavy = sorted((r.key, r.bytes) for r in heavy)
    heavy_keys = np.array([k for k, _ in heavy], dtype=np.int64)
    pieces = np.array([int(np.ceil(b / (tolerance * share))) for _, b in heavy], dtype=np.int64)
    first_piece = np.concatenate(([0], np.cumsum(pieces))).astype(np.int64)

    chance = F.col("size") * (_SAMPLES_PER_RANGE * n_ranges / max(1, total))
    sample = rows.where(_uniform(F.lit(1), "doc_id", "key") < chance).select("key").toPandas()["key"].to_numpy()
    sample = np.sort(sample[~np.isin(sample, heavy_keys)])
    splitters = np.unique(sample[np.arange(1, n_ranges) * len(sample) // n_ranges]) if len(sample) else sample

    def placed(splitters: np.ndarray) -> DataFrame:
        n_light = len(splitters) + 1

        @F.pandas_udf("long")
        def range_of(key: pd.Series, tie: pd.Series) -> pd.Series:
            k = key.to_numpy()
            out = np.searchsorted(splitters, k, side="left")
            if len(heavy_keys):
                at = np.minimum(np.searchsorted(heavy_keys, k), len(heavy_keys) - 1)
                own = heavy_keys[at] == k
                piece = first_piece[at] + tie.to_numpy() % pieces[at]
                out = np.where(own, n_light + piece, out)
            return pd.Series(out)

        return rows.withColumn("range_id", range_of("key", "tie"))

    while True:
        ranged = placed(splitters)
        held = {r[0]: r[1] for r in ranged.groupBy("range_id").agg(F.sum("size")).collect()}
        n_light = len(splitters) + 1
        light = np.array([held.get(i, 0) for i in range(n_light)], dtype=np.int64)
        edges = np.concatenate(([-(2**63)], splitters, [2**63 - 1])).astype(object)
        most = 2 * max(light.sum() / n_ranges, tolerance * share)
        extra = []
        for i in np.flatnonzero(light > most).tolist():  # overfull: keys are hashes, so equal steps divide a range well
            low, high, parts = edges[i], edges[i + 1], int(light[i] // most) + 2
            extra += [low + (high - low) * j // parts for j in range(1, parts)] if high - low > parts else []
        if not extra:
            break
        splitters = np.unique(np.concatenate((splitters, np.array(extra, dtype=np.int64))))

    # Heavy texts first, largest first, each to the shard with the least so far: all pieces of
    # a text together, or one by one where the text outweighs a shard.
    units = []
    for i, (_, size) in enumerate(heavy):
        own = [r + n_light for r in range(first_piece[i], first_piece[i + 1])]
        units += [(size, own)] if size <= share else [(held.get(r, 0), [r]) for r in own]
    load = np.zeros(shards, dtype=np.float64)
    fixed = np.full(n_light + int(first_piece[-1]), -1, dtype=np.int64)
    for size, own in sorted(units, reverse=True):
        fixed[own] = least = int(np.argmin(load))
        load[least] += size
    # Then one level for all: each shard takes what it lacks, in the order of the ranges.
    order = np.sort(load)
    for k in range(shards, 0, -1):
        level = (light.sum() + order[:k].sum()) / k
        if level >= order[k - 1]:
            break
    quota = np.cumsum(np.maximum(0.0, level - load))
    quota[-1] = np.inf
    base = np.concatenate(([0], np.cumsum(light)))[:-1]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted runs of ranges: running bytes give the shard, running counts the place in (range, shard)."""
        now = key = shard = None
        position = group_start = index = 0
        for batch in batches:
            ids, keys, sizes = (batch[c].to_numpy() for c in ("range_id", "key", "size"))
            shard_out, index_out = np.empty(len(ids), dtype=np.int32), np.empty(len(ids), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if ids[a] != now:
                    now, key, shard, position, group_start, index = ids[a], None, None, 0, 0, 0
                begins = position + np.cumsum(sizes[a:b]) - sizes[a:b]
                fresh = np.concatenate(([key is None or keys[a] != key], keys[a + 1 : b] != keys[a : b - 1]))
                starts = np.maximum.accumulate(np.where(fresh, begins, group_start))
                if fixed[now] >= 0:
                    to = np.full(b - a, fixed[now])
                else:
                    to = np.searchsorted(quota, base[now] + starts, side="right")
                new = np.concatenate(([shard is None or to[0] != shard], to[1:] != to[:-1]))
                since = np.maximum.accumulate(np.where(new, np.arange(b - a), -1))
                index_out[a:b] = np.where(since >= 0, np.arange(b - a) - since, np.arange(b - a) + index)
                shard_out[a:b] = to
                position, group_start = int(begins[-1] + sizes[b - 1]), int(starts[-1])
                key, shard, index = keys[b - 1], to[-1], int(index_out[b - 1]) + 1
            yield batch.assign(shard=shard_out, place=index_out)[["doc_id", "size", "text_crc32", "range_id", "shard", "place"]]

    kind = dict(docs.dtypes)["doc_id"]
    tasks = min(len(fixed), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // _ROWS_PER_RANGE))
    runs = ranged.repartitionById(tasks, (F.col("range_id") % tasks).cast("int"))
    runs = runs.sortWithinPartitions("range_id", "key", "tie", "size").mapInPandas(
        assign, f"doc_id {kind}, size long, text_crc32 long, range_id long, shard int, place long"
    )
    runs = materialise(runs, "shard-runs")
    counts = sorted((r[0], r[1], r[2]) for r in runs.groupBy("shard", "range_id").count().collect())
    before, offsets = dict.fromkeys(range(shards), 0), []
    for shard, range_id, n in counts:  # a row for each range, and one more for each shard at most
        offsets.append((shard, range_id, before[shard]))
        before[shard] += n
    offsets = docs.sparkSession.createDataFrame(offsets, "shard int, range_id long, before long")
    return runs.join(F.broadcast(offsets), ["shard", "range_id"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot")
    )


def op1(spark, folder: str) -> DataFrame:
    out = shard_by_bytes(table(spark, folder, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
