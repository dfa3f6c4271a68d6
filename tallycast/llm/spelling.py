"""Spelling variants by blocked Gram matrices of letter counts.

One inserted, deleted or replaced letter moves a word's letter counts by a squared distance
of two at most. Words are blocked by length and by how many of their letters fall into each of four
classes, which one edit changes by one at most, so that a block meets only itself and the few blocks
beside it. For two blocks one matrix product gives all inner products, and with the norms all squared
distances; pairs at most two apart are verified letter by letter. Large blocks are cut by a
hash of the word, so a task holds two bounded blocks at a time, and every pair is met once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import table
from tallycast.storage import materialise

LEAST_LETTERS, LEAST_TIMES = 5, 3
BLOCK = 2048  # words of a block, about
LETTERS = 26 + 64  # a to z and U+00C0 to U+00FF
_RUN = re.compile("[a-zÀ-ÿ]+")
_HELD = 1 << 18  # words a task counts before it hands them on
CLASSES = 4  # of letters, by code point
# Steps of the counts by class from a block to those it meets: itself, one letter more of a class, and a
# letter replaced by one of another class (one direction each, so that no pair is met twice).
_ONE = [tuple(int(k == c) for k in range(CLASSES)) for c in range(CLASSES)]
_STEPS = [(0,) * CLASSES, *_ONE, *[tuple(x - y for x, y in zip(_ONE[c], _ONE[d])) for c in range(CLASSES) for d in range(c)]]


def words(docs: DataFrame, every: int = 97) -> DataFrame:
    """(word, n): the runs of letters of all texts, lower-cased (A-Z), with their number.

    Where ``every`` divides the CRC-32 of ``<doc_id>:<run>``, the run loses the letter at that number
    modulo its length. Words of fewer than five letters or three occurrences are left out. A null text
    has no words, a null doc_id reads as empty text; repeated rows count each; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def out():
            return pd.DataFrame({"word": list(total.keys()), "n": np.fromiter(total.values(), np.int64, len(total))})

        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                start = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(_RUN.findall(text.lower().decode())).items():  # bytes: A-Z only
                    if len(word) < LEAST_LETTERS:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LETTERS:
                            continue
                    total[word] += n
                if len(total) > _HELD:
                    yield out()
                    total.clear()
        if total:
            yield out()

    rows = docs.where("text IS NOT NULL").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text")
    )
    counted = rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_TIMES)


def _codes(found: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(found, dtype=f"<U{len(found[0])}").view(np.uint32).reshape(len(found), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each letter stands in each word; doubles where squares could outgrow single precision."""
    letter = np.where(codes < 128, codes - 97, codes - 0xC0 + 26).astype(np.int64)
    at = np.arange(len(codes))[:, None] * LETTERS + letter
    counts = np.bincount(at.ravel(), minlength=len(codes) * LETTERS).reshape(len(codes), LETTERS)
    return counts.astype(np.float32 if codes.shape[1] < 1024 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``b`` is one replaced or inserted letter away from that row of ``a``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    head = np.cumprod(a == b[:, :n], axis=1, dtype=np.int64).sum(axis=1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int64).sum(axis=1)
    return head + tail >= n


def near_in_blocks(a: list[str], b: list[str], same: bool) -> list[tuple[int, int]]:
    """Positions of pairs one edit apart; ``same``: the blocks are one, and pairs are listed once."""
    x, y = _codes(a), _codes(b)
    p, q = letter_counts(x), letter_counts(y)
    used = p.any(axis=0) | q.any(axis=0)
    p, q = p[:, used], q[:, used]
    one = np.ones((1, 1), dtype=p.dtype)
    # One product with the norms as two further columns gives the squared distances.
    p = np.hstack([-2 * p, (p * p).sum(axis=1, keepdims=True), one.repeat(len(p), 0)])
    q = np.hstack([q, one.repeat(len(q), 0), (q * q).sum(axis=1, keepdims=True)])
    i, j = np.divmod(np.flatnonzero((p @ q.T).ravel() <= 2), len(q))
    if same:
        i, j = i[i < j], j[i < j]
    out = []
    step = max(1, (1 << 22) // y.shape[1])
    for at in range(0, len(i), step):
        s, t = i[at : at + step], j[at : at + step]
        right = one_edit(x[s], y[t])
        out += zip(s[right].tolist(), t[right].tolist())
    return out


def near_pairs(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): every two words one edit apart, in both directions.

    ``vocabulary`` has distinct non-empty words of the letters a to z and U+00C0 to U+00FF.
    """
    of_class = f"size(filter(transform(split(word, ''), c -> IF(c = '', -1, ascii(c) % {CLASSES})), c -> c = {{}}))"
    classes = [f"c{k}" for k in range(CLASSES)]
    keyed = vocabulary.select("word", "n", *[F.expr(of_class.format(k)).alias(c) for k, c in enumerate(classes)])
    keyed = materialise(keyed, "letter-classes")
    # A block of long words holds fewer of them.
    sizes = keyed.groupBy(*classes).count()
    sizes = sizes.selectExpr(*classes, f"CAST(ceil(count / greatest(1, least({block}, 4194304 DIV ({' + '.join(classes)})))) AS INT) AS parts")
    sizes = materialise(sizes, "letter-blocks")
    others = [f"{c}_met" for c in classes]
    steps = ", ".join("array(" + ", ".join(map(str, step)) + ")" for step in _STEPS)
    met = sizes.select("*", F.explode(F.expr(f"array({steps})")).alias("s"))
    met = met.selectExpr(*classes, "parts", *[f"{c} + s[{k}] AS {o}" for k, (c, o) in enumerate(zip(classes, others))])
    met = met.join(sizes.withColumnsRenamed({**dict(zip(classes, others)), "parts": "parts_met"}), others)
    own = "CAST(pmod(xxhash64(word), {}) AS INT)"
    keys = [*classes, "part", *others, "part_met"]
    same_block = " AND ".join(f"{c} = {o}" for c, o in zip(classes, others))
    once = f"NOT ({same_block}) OR part <= part_met"
    left = (
        keyed.join(met, classes)
        .withColumn("part", F.expr(own.format("parts")))
        .withColumn("part_met", F.explode(F.expr("sequence(0, parts_met - 1)")))
        .where(once)
        .select(*keys, "word", "n")
    )
    right = (
        keyed.withColumnsRenamed(dict(zip(classes, others)))
        .join(met, others)
        .withColumn("part_met", F.expr(own.format("parts_met")))
        .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        .where(once)
        .select(*[F.col(k).alias(f"other_{k}") for k in keys], F.col("word").alias("near"), F.col("n").alias("near_n"))
    )

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["word", "n", "near", "near_n"]
        if a.empty or b.empty:
            return pd.DataFrame([], columns=columns)
        same = key[: CLASSES + 1] == key[CLASSES + 1 :]
        if same:  # one block, in one order
            a, b = a.sort_values("word"), b.sort_values("near")
        found = near_in_blocks(a["word"].tolist(), b["near"].tolist(), same)
        i, j = [x for x, _ in found], [y for _, y in found]
        word, n, near, near_n = (d[c].to_numpy()[at] for d, c, at in ((a, "word", i), (a, "n", i), (b, "near", j), (b, "near_n", j)))
        pairs = zip(columns, ((word, near), (n, near_n), (near, word), (near_n, n)))
        return pd.DataFrame({c: np.concatenate(x) for c, x in pairs})

    pairs = left.groupBy(*keys).cogroup(right.groupBy(*[f"other_{c}" for c in keys]))
    return pairs.applyInPandas(compare, "word string, n long, near string, near_n long")


def variants(vocabulary: DataFrame, times: int = 2, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each distinct word of ``vocabulary`` (word, n).

    ``form`` is the near word of largest n (of equal ones the first in code-point order), if it is
    ``times`` the word's own n or more, else null; ``root`` is reached by following forms to the
    last one. Forms at least double n at each step, so chains are short and have no cycles;
    they are halved by joining the table of forms with itself.
    """
    vocabulary = materialise(vocabulary.select("word", "n"), "vocabulary")
    best = near_pairs(vocabulary, block).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best")
    )
    formed = vocabulary.join(best, "word", "left")
    is_form = F.expr(f"-best.m >= {times} * n")
    formed = formed.select(
        "word",
        F.when(is_form, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, -F.col("best.m")).alias("form_n"),
    )
    formed = materialise(formed, "forms")
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = formed.agg(F.coalesce(F.max("n") / F.min("n"), F.lit(1.0))).first()[0]
    steps = math.ceil(math.log(max(1.0, most), times))  # forms that a chain can have
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        ahead = links.selectExpr("word AS root", "root AS next")
        links = materialise(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return formed.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12(spark, folder: str) -> DataFrame:
    return variants(words(table(spark, folder, "documents").select("doc_id", "text")))
