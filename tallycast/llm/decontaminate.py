"""Benchmark decontamination: a prefix-filtered join of item windows with document words.

A window is ``window`` consecutive words of an item (an item of fewer words is one window).
A document contains a window only if it contains all of the window's shingles, so it is
enough to look for one of them: shingles are ordered by how often they occur in the corpus,
and the rarest one of each window is its prefix. The join meets document shingles with
prefixes, the length and position bounds drop matches whose window would not fit into the
document there, and the words themselves are compared last. A window with a shingle that
the corpus never shows cannot occur and takes no part. DataFrame functions only; words are
generated, joined and verified in one pass over each text, and only hits are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import LOWER_AZ, broadcast_if_small, table, text_of
from tallycast.storage import materialise

WINDOW, SHINGLE = 10, 3
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(column: str) -> Column:
    """Lower-case (A-Z) words of ASCII letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(text_of(column), *LOWER_AZ), _BREAKS), "")


def _shingle(words: str, at: str, width: int) -> Column:
    return F.expr(f"xxhash64({', '.join(f'get({words}, {at} + {i})' for i in range(width))})")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, len, items): each distinct window with the sorted ids of its items."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("w"))
    starts = words.where("size(w) > 0").select(
        "item", "w", F.explode(F.expr(f"sequence(0, greatest(0, size(w) - {window}))")).alias("at")
    )
    return (
        starts.select("item", F.expr(f"slice(w, at + 1, {window})").alias("words"))
        .groupBy("words")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("len", F.size("words"))
    )


def _document_shingles(docs: DataFrame, width: int) -> DataFrame:
    """One row per word position of a document that starts a whole shingle."""
    spelled = docs.select("doc_id", F.xxhash64("text").alias("version"), words_of("text").alias("w"))
    at = spelled.where(f"size(w) >= {width}").select("*", F.explode(F.expr(f"sequence(0, size(w) - {width})")).alias("at"))
    return at.withColumn("shingle", _shingle("w", "at", width))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, version, start, stop, items): every occurrence of a window, in word positions."""
    windows = materialise(item_windows(benchmark, window), "windows").withColumn("window_id", F.xxhash64("words"))
    size = windows.agg(
        F.sum(F.length(F.concat_ws(" ", "words", "items")) + 64),
        F.collect_set(F.least("len", F.lit(shingle))),
        F.sum(F.lit(16) * F.col("len")),  # a bound for the bytes of all shingles
    ).first()
    found = []
    for width in sorted(size[1]):  # one width, unless an item has fewer words than a shingle
        own = windows.where(F.least("len", F.lit(shingle)) == width)
        parts = own.select(
            "window_id", "len", F.posexplode(F.expr(f"transform(sequence(0, len - {width}), i -> {_sql_shingle(width)})")).alias("offset", "shingle")
        )
        known = parts.select("shingle").distinct()
        in_corpus = _document_shingles(docs, width).select("shingle")
        counts = materialise(
            in_corpus.join(broadcast_if_small(known, size[2]), "shingle").groupBy("shingle").count(), "rarity"
        )
        ranked = parts.join(counts, "shingle", "left").groupBy("window_id").agg(
            F.min(F.struct("count", "shingle", "offset")).alias("rarest"), F.count_if(F.col("count").isNull()).alias("unseen")
        )
        prefixes = own.join(ranked.where("unseen = 0"), "window_id").select(
            "words", "items", "len", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset")
        )
        prefixes = materialise(prefixes, "prefixes")
        found.append(
            _document_shingles(docs, width)
            .join(broadcast_if_small(prefixes, size[0]), "shingle")
            .where("at >= offset AND at - offset + len <= size(w)")  # position and length bounds
            .where("slice(w, at - offset + 1, len) = words")
            .selectExpr("doc_id", "version", "at - offset AS start", "at - offset + len AS stop", "items")
        )
    if not found:
        return docs.limit(0).selectExpr("doc_id", "xxhash64(text) AS version", "0 AS start", "0 AS stop", "array('') AS items")
    return reduce(DataFrame.unionByName, found)


def _sql_shingle(width: int) -> str:
    return f"xxhash64({', '.join(f'get(words, i + {k})' for k in range(width))})"


# Words inside any of the occurrences: lengths of the union of their intervals.
_COVERED = """aggregate(array_sort(collect_set(struct(start, stop))), struct(0 AS n, 0 AS upto),
    (a, x) -> struct(a.n + greatest(0, x.stop - greatest(a.upto, x.start)) AS n, greatest(a.upto, x.stop) AS upto),
    a -> CAST(a.n AS BIGINT))"""


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, version, n_words, n_hit, items) per row of ``docs``; version is a hash of the text.

    A null or empty text has no words; an item without words or without an id matches
    nothing. Rows that repeat a document get the same result each; rows that share only
    the doc_id are told apart by their texts. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    per_document = (
        hits(docs, benchmark.select("item_id", "text").where("item_id IS NOT NULL"), window, shingle)
        .groupBy("doc_id", "version")
        .agg(F.expr(_COVERED).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    base = docs.select("doc_id", F.xxhash64("text").alias("version"), F.size(words_of("text")).cast("long").alias("n_words"))
    same = base.doc_id.eqNullSafe(per_document.doc_id) & (base.version == per_document.version)
    return base.join(per_document, same, "left").select(
        base.doc_id,
        base.version,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without any hit word, columns unchanged."""
    bad = hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text").where("item_id IS NOT NULL"), window, shingle)
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version")).distinct()
    same = docs.doc_id.eqNullSafe(bad.bad_id) & (F.xxhash64(docs.text) == bad.bad_version)
    return docs.join(bad, same, "left_anti")


def op2(spark, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, list_aggregate(w[i + 1 : i + 10], 'string_agg', ' ') AS words, least(10, len(w)) AS n FROM
  (SELECT item, w, unnest(range(0, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT k, i, n, list_aggregate(w[i + 1 : i + n], 'string_agg', ' ') AS words FROM
  (SELECT k, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT p.k, p.i, p.n, x.item FROM places p JOIN windows x ON p.n = x.n AND p.words = x.words),
covered AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM
  (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.k = c.k LEFT JOIN named m ON d.k = m.k
"""
