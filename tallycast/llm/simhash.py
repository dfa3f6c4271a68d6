"""Near-duplicates by SimHash: fingerprints linked within two bits, found by popcounts of segments.

A 64-bit fingerprint is embedded as the bit counts of its 16 four-bit segments. One changed
bit moves one count by one, so the Manhattan distance of two embeddings never exceeds the
number of differing bits. Two fingerprints within two bits therefore both reach a common
grid cell within one step of their own cell, and the join is on cells reached by both. It is
verified exactly: inside a cell, a fingerprint stands for itself and its one-bit neighbours
that lie in the cell, and two fingerprints are within two bits exactly when they share such a
value. At most 65 fingerprints share one, so neither a large group of near copies nor a full
cell is ever expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm.common import salted_join, table
from tallycast.llm.graph import connected_components
from tallycast.storage import materialise


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """One 64-bit hash for each run of ``words`` words; a text of fewer words is one run, one without words has none."""
    tokens = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    width = min(words, len(tokens))
    first, last = starts[: len(tokens) - width + 1], (starts + size)[width - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(first.tolist(), last.tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number; zero if there are none."""
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 4096):
        block = hashes[part : part + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def simhash(text: bytes | None, words: int) -> int:
    """The fingerprint of a text's shingles."""
    return fingerprint(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, version, fp): one row per row of ``docs``; a null text has no words, version is a hash of the text."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, words) for t in texts], dtype="int64")

    compute = F.pandas_udf(of, "long")
    return docs.select("doc_id", F.xxhash64("text").alias("version"), compute(F.col("text").cast("binary")).alias("fp"))


def _cell(x: str) -> str:
    """Bit counts of the 16 four-bit segments of a fingerprint, each in its own four bits."""
    half, odd = f"shiftrightunsigned({x}, 1)", "6148914691236517205L"
    pairs = f"((({x} ^ {half}) & {odd}) | shiftleft({x} & {half} & {odd}, 1))"  # no sum that can overflow
    return f"(({pairs} & 3689348814741910323L) + (shiftrightunsigned({pairs}, 2) & 3689348814741910323L))"


def _near(x: str) -> Column:
    """The fingerprint and its 64 one-bit neighbours."""
    return F.expr(f"transform(sequence(-1, 63), i -> IF(i < 0, {x}, {x} ^ shiftleft(1L, i)))")


def link(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at most two bits apart, enough to connect all such.

    Each fingerprint makes 65 rows, however many others there are: the values within one bit and
    the cell of each. Rows are shuffled by cell and sorted by value in it.
    """
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = distinct.repartition(spread, "fp").select("fp", F.explode(_near("fp")).alias("value"))
    cells = values.withColumn("cell", F.expr(_cell("value"))).repartition(spread, "cell")
    # At most 65 fingerprints share a value, all of them within two bits of each other.
    least = F.min("fp").over(Window.partitionBy("cell", "value"))
    return cells.select(least.alias("a"), F.col("fp").alias("b")).where("a <> b").distinct()


def _labelled(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, fp) per row, and (fp, held, first_id, component) per fingerprint, which ``held`` rows have."""
    prints = materialise(fingerprints(docs, words), "simhash")
    distinct = materialise(prints.groupBy("fp").agg(F.count("*").alias("held"), F.min("doc_id").alias("first_id")), "prints")
    parts = connected_components(link(distinct.select("fp")))
    labelled = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "held", "first_id", F.coalesce("component", "fp").alias("component")
    )
    return prints, materialise(labelled, "labelled-prints")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id reachable over
    links of at most two differing bits.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a
    doc_id stay as they are; a null doc_id is kept and never becomes a component's id unless
    all of the component's ids are null. Other columns of ``docs`` are ignored.
    """
    prints, labelled = _labelled(docs, words)
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("prints"))
    names = salted_join(labelled, materialise(least, "components"), ["component"], "prints", "fp")
    names = materialise(names.select("fp", "held", "component_id"), "named-prints")
    return salted_join(prints, names, ["fp"], "held", "doc_id").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each component; ``groups`` has (doc_id, version, component) for each row,
    where version is the xxhash64 of the text. Columns unchanged.

    The row of smallest doc_id stays, null being the largest; among rows of one id, that of the smallest
    version. Rows that share only the id are told apart by their texts, and equal rows are one.
    """
    rows = groups.groupBy("doc_id", "version").agg(F.first("component").alias("component"), F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version", "n")).alias("least")
    kept = rows.groupBy("component").agg(least).selectExpr("least.doc_id AS kept_id", "least.version AS kept_version", "least.n AS kept_n")
    kept = materialise(kept, "kept-rows")
    same = docs.doc_id.eqNullSafe(kept.kept_id) & (F.xxhash64(docs.text) == kept.kept_version)
    alone = docs.join(kept, same, "left_semi")
    return alone if kept.where("kept_n > 1").isEmpty() else alone.dropDuplicates(["doc_id", "text"])


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with one row of each component, the one of smallest id; see keep_first."""
    prints, names = _labelled(docs, words)
    found = salted_join(prints, names.select("fp", "held", "component"), ["fp"], "held", "doc_id")
    return keep_first(docs, found.select("doc_id", "version", "component"))


def op9(spark, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
