"""Sum-of-squares packing of tokenised documents into sequences.

A document is cut into full sequences and one remainder. Remainders are placed online: of
all fill levels that leave room (an empty window included), the one is taken for which the
sum of squared counts of partially filled windows becomes smallest; the counts are kept in
an array by level. Each task packs the documents it reads, so packing needs no shuffle and
has no group to overflow. What is left open at a task's end is closed by cutting pieces to
size, so a task pads one sequence at most.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import table
from tallycast.llm.tokens import rank_encoder

SCHEMA = (
    "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)

class Packer:
    """Windows of one task. ``place`` takes (doc_id, start, doc_tokens, ids); closed windows come out of ``done``."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.next_sequence = size, first_sequence
        self.level = np.zeros(size, dtype=np.int64)  # open windows by fill level; level 0 stays 0
        self.open: dict[int, list] = defaultdict(list)
        self.done: list[tuple] = []

    def place(self, doc_id, ids: array, end: int) -> None:
        tokens = len(ids) + 1
        ids.append(end)
        whole = tokens - tokens % self.size
        for at in range(0, whole, self.size):
            self._close([(doc_id, at, tokens, ids[at : at + self.size])])
        if whole < tokens:
            self._remainder((doc_id, whole, tokens, ids[whole:]))

    def _remainder(self, piece: tuple) -> None:
        n = len(piece[3])
        # Moving a window from level x to level x + n changes the sum of squares by
        # (1 - 2 N[x]) + (2 N[x + n] + 1); leaving level 0 or reaching a full window adds nothing there.
        leave = np.where(self.level[: self.size - n + 1] > 0, 1 - 2 * self.level[: self.size - n + 1], self.size**2 * 2**20)
        leave[0] = 0
        reach = np.zeros(self.size - n + 1, dtype=np.int64)
        reach[: self.size - n] = 2 * self.level[n:] + 1
        change = leave + reach
        best = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal ones the fullest
        window = self.open[best].pop() if best else []
        if best:
            self.level[best] -= 1
        window.append(piece)
        if best + n == self.size:
            self._close(window)
        else:
            self.open[best + n].append(window)
            self.level[best + n] += 1

    def finish(self) -> None:
        """Fill the open windows from each other: the emptiest give their pieces, cut to size."""
        windows = [w for level in sorted(self.open) for w in self.open[level]]  # emptiest first
        self.open.clear()
        self.level[:] = 0
        given: list[tuple] = []
        while windows:
            window = windows.pop()
            room = self.size - sum(len(p[3]) for p in window)
            while room and (given or windows):
                if not given:
                    given = windows.pop(0)
                doc_id, start, tokens, ids = given.pop()
                window.append((doc_id, start, tokens, ids[:room]))
                if len(ids) > room:
                    given.append((doc_id, start + room, tokens, ids[room:]))
                room -= min(room, len(ids))
            self._close(window)
        while given:
            window, room = [], self.size
            while given and room:
                doc_id, start, tokens, ids = given.pop()
                window.append((doc_id, start, tokens, ids[:room]))
                if len(ids) > room:
                    given.append((doc_id, start + room, tokens, ids[room:]))
                room -= min(room, len(ids))
            self._close(window)

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, tokens, ids in window:
            crc = zlib.crc32(ids.tobytes())
            self.done.append((doc_id, start, len(ids), crc, tokens, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end: int = 0) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its token ids, those of the tokenizers library for ``vocabulary``, followed by ``end``; a null or empty text is that id alone.
    Every id lies in exactly one piece. A sequence_id names the task that made it in its
    upper bits, so ids are unique without a shuffle, and a task that is run again makes the
    same sequences from the same rows. Repeated rows and null ids are packed like any other;
    other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    columns = [part.split()[0] for part in SCHEMA.format(kind).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = rank_encoder(vocabulary)
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                packer.place(doc_id, array("I", encode(text or "")), end)
            if packer.done:
                yield pd.DataFrame(packer.done, columns=columns)
                packer.done = []
        packer.finish()
        if packer.done:
            yield pd.DataFrame(packer.done, columns=columns)

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA.format(kind))


def op4(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
