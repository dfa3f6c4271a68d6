"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, scaled to length one and rotated at random; the signs of the result,
packed to bits, are the code. With the code are kept the distance to the centre and the
inner product of the vector with its own code, by which an inner product with a query is
estimated and its error bounded. Per block of vectors, the bounds pick the candidates whose
lower bound reaches the k-th smallest upper bound, and these alone are measured exactly.

Every row is coded. Queries, a stated set, meet all blocks: the pair (block of vectors,
block of queries) is the join key, so a task holds one block of each and nothing grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm.common import table
from tallycast.storage import materialise

BLOCK = 4096  # vectors of a block, about
QUERIES = 1024  # queries of a block, about
SPREAD = 3.0  # standard errors on either side of an estimate


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for the same dimension and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): rows that take part: with an id, finite, not null and not all zero."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    finite = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"
    return rows.where(f"vec_id IS NOT NULL AND v IS NOT NULL AND {finite}").withColumn("dim", F.size("v"))


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each dimension."""
    sums = (
        rows.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.avg("x").alias("x")).orderBy("dim", "at").collect()
    )
    out: dict[int, list] = {}
    for dim, _, x in sums:
        out.setdefault(dim, []).append(x)
    return {dim: np.array(x) for dim, x in out.items()}


def encode(v: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, distance to the centre, and inner product with the own code, of each row."""
    moved = (v - centre) @ turn
    norm = np.linalg.norm(moved, axis=1)
    unit = moved / np.where(norm > 0, norm, 1.0)[:, None]
    own = np.abs(unit).sum(axis=1) / np.sqrt(v.shape[1])
    return np.packbits(unit > 0, axis=1), norm, np.where(norm > 0, own, 1.0)


def bounds(bits, norm, own, moved_query, query_norm, spread: float = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances, queries by rows."""
    dim = moved_query.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float64) * 2 - 1
    estimate = (moved_query @ signs.T) / (np.sqrt(dim) * own)  # of <query, unit vector>
    error = spread * query_norm[:, None] * np.sqrt(np.maximum(0.0, 1 - own**2)) / (own * np.sqrt(max(1, dim - 1)))
    middle = norm**2 + (query_norm**2)[:, None]
    return middle - 2 * norm * (estimate + error), middle - 2 * norm * (estimate - error)


def search(vectors: DataFrame, every: int = 100, k: int = 10, spread: float = SPREAD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, its
    ``k`` nearest other rows by Euclidean distance, measured on the original vectors.

    Rows that are null, zero or not finite, or that have no id, take no part; vectors are near
    only to vectors of their own dimension. Ties go to the smaller vec_id. Repeated ids are
    rows of their own, except that a query never meets its own id. Other columns are ignored.
    """
    rows = materialise(usable(vectors), "vectors")
    count = rows.count()
    n_blocks, n_query_blocks = -(-count // BLOCK), -(-(count // every + 1) // QUERIES)
    middle = centres(rows)
    kind = dict(rows.dtypes)["vec_id"]
    key = F.xxhash64("vec_id")
    candidates = rows.select(
        "*", F.pmod(key, F.lit(max(1, n_blocks))).alias("block"), F.explode(F.expr(f"sequence(0L, {n_query_blocks - 1}L)")).alias("query_block")
    )
    queries = rows.where(F.col("vec_id") % every == 0).select(
        "*",
        F.pmod(key, F.lit(n_query_blocks)).alias("query_block"),
        F.explode(F.expr(f"sequence(0L, {max(1, n_blocks) - 1}L)")).alias("block"),
    )

    def nearest(near: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if near.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v, q = np.stack(near["v"].to_numpy()), np.stack(asked["v"].to_numpy())
        ids, query_ids = near["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        turn = rotation(v.shape[1])
        centre = middle[v.shape[1]]
        bits, norm, own = encode(v, centre, turn)
        moved = (q - centre) @ turn
        low, high = bounds(bits, norm, own, moved, np.linalg.norm(moved, axis=1), spread)
        same = query_ids[:, None] == ids[None, :]
        low[same] = high[same] = np.inf
        reach = np.partition(high, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        out = []
        for i in range(len(q)):
            at = np.flatnonzero((low[i] <= reach[i]) & ~same[i])
            exact = np.sqrt(((v[at] - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], exact))[:k]
            out.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[at][best], "score": exact[best]}))
        return pd.concat(out, ignore_index=True)

    keys = ["dim", "block", "query_block"]
    found = (
        candidates.groupBy(*keys)
        .cogroup(queries.groupBy(*keys))
        .applyInPandas(nearest, f"query_id {kind}, vec_id {kind}, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6(spark, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"))
