"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes: h = (h << 1) + gear[byte], in 16 bits, so it knows
the last 16 bytes only. Positions where h falls under a threshold are candidates; one that
follows another too closely is passed over. Both rules look at nearby bytes alone, so an
insertion moves no boundary beyond its own surroundings and a shared passage is cut the same
way in every text. Chunks are compared by 128-bit digest; adjoining chunks that other
documents hold too form runs, and runs of enough words are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm.common import table
from tallycast.storage import materialise

CHANCE = 16  # one position in so many is a candidate
CLOSEST = 12  # a candidate within so many bytes of the one before it is passed over
LONGEST = 256  # bytes of a chunk
LEAST_WORDS = 16  # of a reported run
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a byte array, the last one being its length."""
    hashes = GEAR[data]
    for width in (1, 2, 4, 8):  # windows of 1, 2, 4, 8 bytes double to 16
        longer = hashes.copy()
        longer[width:] += hashes[:-width] << np.uint16(width)
        hashes = longer
    cuts = np.flatnonzero(hashes < (1 << 16) // CHANCE) + 1
    cuts = cuts[np.diff(cuts, prepend=-CLOSEST) >= CLOSEST]
    cuts = np.concatenate(([0], cuts[cuts < len(data)], [len(data)]))
    sizes = np.diff(cuts)
    if sizes.max(initial=0) > LONGEST:
        cuts = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(cuts[:-1], cuts[1:])] + [[len(data)]])
    return cuts[1:]


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, version, start, stop, words, d1, d2): chunks with their place in code points."""
    kind = dict(docs.dtypes)["doc_id"]
    columns = ["doc_id", "version", "start", "stop", "words", "d1", "d2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            counts, parts, found = [], [], []
            for text in batch["text"]:
                data = np.frombuffer(text, dtype=np.uint8)
                stops = boundaries(data) if len(data) else np.zeros(0, dtype=np.int64)
                starts = np.concatenate(([0], stops[:-1]))[: len(stops)]
                counts.append(len(stops))
                if not len(stops):
                    continue
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                blank = (data == 32) | ((data >= 9) & (data <= 13))
                begun = np.concatenate(([0], np.cumsum(~blank & np.concatenate(([True], blank[:-1])))))
                parts.append((points[starts], points[stops], begun[stops] - begun[starts]))
                found += [digest(text[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]
            if not found:
                continue
            start, stop, words = (np.concatenate(x) for x in zip(*parts))
            pair = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pd.DataFrame(
                {
                    "doc_id": np.repeat(batch["doc_id"].to_numpy(), counts),
                    "version": np.repeat(batch["version"].to_numpy(), counts),
                    "start": start,
                    "stop": stop,
                    "words": words,
                    "d1": pair[:, 0],
                    "d2": pair[:, 1],
                }
            )[columns]

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("version"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInPandas(run, f"doc_id {kind}, version long, start int, stop int, words int, d1 long, d2 long")


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, version, start, stop, n_words, first_doc_id, repeats): maximal runs of chunks that
    more than one document holds, in code points, stop exclusive.

    ``first_doc_id`` is the smallest document that holds one of the run's chunks; ``repeats``
    lists the (start, stop) of the chunks whose smallest holder is another document, which is
    what deduplication deletes. Rows without id or text are left out; rows that repeat both
    give one set of spans; a passage repeated inside one document only is no repeat. The
    chunks are made twice, which costs less than storing them.
    """
    shared = chunks(docs).groupBy("d1", "d2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    shared = materialise(shared.where("first_id <> last_id").drop("last_id"), "shared-chunks")
    marked = chunks(docs).join(shared, ["d1", "d2"]).drop("d1", "d2")
    order = Window.partitionBy("doc_id", "version").orderBy("start")
    runs = (
        marked.withColumn("before", F.lag(F.struct("start", "stop")).over(order))
        .where("before IS NULL OR before.start <> start")  # a repeated row's chunks count once
        .withColumn("run", F.sum(F.expr("IF(before IS NULL OR before.stop <> start, 1, 0)")).over(order))
    )
    return (
        runs.groupBy("doc_id", "version", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.sum("words").alias("n_words"),
            F.min("first_id").alias("first_doc_id"),
            F.array_sort(F.collect_list(F.expr("IF(first_id <> doc_id, struct(start, stop), NULL)"))).alias("repeats"),
        )
        .where(F.col("n_words") >= least_words)
        .drop("run")
    )


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with every repeated span deleted outside the first document that holds it;
    columns unchanged, n_chars (where present) following the new text."""
    spans = repeated_spans(docs.select("doc_id", "text"), least_words).groupBy("doc_id", "version")
    spans = spans.agg(F.array_sort(F.flatten(F.collect_list("repeats"))).alias("cuts"))
    spans = spans.select(F.col("doc_id").alias("cut_id"), F.col("version").alias("cut_version"), "cuts")
    joined = docs.join(spans, (docs.doc_id == spans.cut_id) & (F.xxhash64(docs.text) == spans.cut_version), "left")
    kept = """IF(cuts IS NULL OR size(cuts) = 0, text, aggregate(cuts,
        struct(0 AS pos, CAST(array() AS array<string>) AS parts),
        (a, x) -> struct(x.stop AS pos, array_append(a.parts, substring(text, a.pos + 1, x.start - a.pos)) AS parts),
        a -> concat(array_join(a.parts, ''), substring(text, a.pos + 1))))"""
    out = [docs[c] if c not in ("text", "n_chars") else None for c in docs.columns]
    text = F.expr(kept)
    changed = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("cuts") > 0, F.length(text).cast(dict(docs.dtypes)["n_chars"])).otherwise(docs.n_chars).alias("n_chars")
    return joined.select(*[changed[c] if o is None else o for c, o in zip(docs.columns, out)])


def op3(spark, folder: str) -> DataFrame:
    found = repeated_spans(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.col("stop").cast("long").alias("stop"),
        "n_words",
        "first_doc_id",
        (F.size("repeats") == 0).alias("kept"),
    )
