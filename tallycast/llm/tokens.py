"""Token ids of whole texts by a vocabulary of the tokenizers library.

The vocabulary's byte-level pattern cuts a text into words before it merges bytes. No word reaches
over a single space that stands before a visible character, so a text is cut there into parts. A part
of Latin or Cyrillic letters, ASCII digits, marks but the apostrophe and single line ends is cut
further where these kinds meet, as the pattern does; so its words need the library's merges only, not
its pattern. Any other part goes to the library as it is. Each distinct word or part is encoded once
per worker; the ids of a text are those of its pieces, end to end. A text with a string that the
vocabulary adds is encoded whole. Tests hold the ids against those of the whole text.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from tallycast.llm.common import process_cache

MOST_PIECES = 1 << 20  # pieces a worker remembers before it starts anew
MOST_IDS = 1 << 24  # and ids
LONGEST_PIECE = 64  # bytes; longer pieces are not remembered
GROUP = 1 << 22  # characters worked on at a time
LINE = 128  # pieces that the library gets as one text
SPACE, NEWLINE = 32, 10

_BYTE = np.arange(256)
# Kinds that a word does not mix: letters 1, digits 2, marks 3, line ends 4. Bytes beyond ASCII count as letters.
_KIND = np.where(_BYTE > 32, 3, 0).astype(np.uint8)
_KIND[[k for k in range(128) if chr(k).isalpha()] + list(range(128, 256))] = 1
_KIND[48:58], _KIND[NEWLINE] = 2, 4
# First bytes of U+00C0 to U+02BF and U+0400 to U+047F, all letters but the two signs in _odd.
_LETTERS = ((_BYTE >= 0xC3) & (_BYTE <= 0xCA)) | (_BYTE == 0xD0) | (_BYTE == 0xD1)
# Bytes that leave a part to the library's pattern.
_OTHER = ((_BYTE < 32) & (_BYTE != NEWLINE)) | (_BYTE == ord("'")) | (_BYTE == 127) | ((_BYTE >= 0xC0) & ~_LETTERS)
# No white space begins with one of these (0xC2 and 0xE1 to 0xE3 begin some).
_VISIBLE = (_BYTE > 32) & (_BYTE != 127) & (_BYTE != 0xC2) & ((_BYTE < 0xE1) | (_BYTE > 0xE3))
# The characters that stand for bytes in the vocabulary: printable ones themselves, others from U+0100 on.
_PRINTABLE = ((_BYTE > 32) & (_BYTE < 127)) | ((_BYTE > 160) & (_BYTE != 173))
_STANDS = np.where(_PRINTABLE, _BYTE, 255 + np.cumsum(~_PRINTABLE)).astype("<u2")


class TokenIds:
    """Encodes batches of texts to little-endian unsigned 32-bit ids."""

    def __init__(self, vocabulary: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary) as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        # Cutting is right for the byte-level pattern without further steps only.
        self._by_parts = (
            spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", False)
            and not split.get("add_prefix_space", True)
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", ()))
        )
        self._added = [t["content"] for t in spec.get("added_tokens", ())]
        if self._by_parts:  # the same vocabulary and merges for words that are cut already
            self._words = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        vocabulary_ids = self._tokenizer.get_vocab(with_added_tokens=False)
        self._bytes = np.zeros(1 + max(self._tokenizer.get_vocab().values(), default=0), np.int64)  # of each token
        self._bytes[list(vocabulary_ids.values())] = [len(t) for t in vocabulary_ids]
        for token in spec.get("added_tokens", ()):
            self._bytes[token["id"]] = len(token["content"].encode())
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}  # a piece: its number
        self._ends = np.zeros(1, np.int64)  # where the ids of each number end in the pool; nothing at first
        self._pool = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order; a few megabytes of text are worked on at a time."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        cut = [self._by_parts and not any(token in t for token in self._added) for t in texts]
        rest = iter(self._whole([t for t, c in zip(texts, cut) if not c]))
        ids = self._cut([t.encode() for t, c in zip(texts, cut) if c])
        for c in cut:
            yield next(ids if c else rest)

    def _learn(self, pieces: list[bytes], found: list[bytes], alone: bool = False) -> None:
        """Remember the ids of pieces, found for many at a time or for each ``alone``.

        A byte-level token stands for its bytes, so the lengths of tokens show where a piece ends."""
        ids = np.frombuffer(b"".join(found), np.uint32)
        if alone:
            stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        else:
            ends = np.cumsum(self._bytes[ids])
            wanted = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            stops = 1 + np.searchsorted(ends, wanted)
            if len(ends) != stops[-1] or not np.array_equal(ends[stops - 1], wanted):
                return self._learn(pieces, self._whole([p.decode() for p in pieces]), alone=True)  # some byte has no token
        self._known.update(zip(pieces, range(len(self._ends), len(self._ends) + len(pieces))))
        self._ends = np.concatenate((self._ends, len(self._pool) + stops))
        self._pool = np.concatenate((self._pool, ids))

    def _learn_words(self, words: list[bytes]) -> None:
        """Words of the pattern, many to a line, written as the vocabulary writes bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.full(sizes.sum() + len(words), SPACE, "<u2")  # a space after each
        text[np.arange(sizes.sum()) + np.repeat(np.arange(len(words)), sizes)] = _STANDS[np.frombuffer(b"".join(words), np.uint8)]
        written = text.tobytes().decode("utf-16-le")
        ends = np.cumsum(sizes + 1)
        stops = [*ends[LINE - 1 : -1 : LINE].tolist(), len(written)]
        found = self._words.encode_batch_fast([written[a:b] for a, b in zip([0, *stops], stops)], add_special_tokens=False)
        self._learn(words, [array("I", e.ids).tobytes() for e in found])

    def _learn_parts(self, parts: list[bytes]) -> None:
        """Parts for the library's pattern: those after a space many to a text, others one by one."""
        joined = [p for p in parts if p[0] == SPACE and _VISIBLE[p[1] if len(p) > 1 else 0]]
        if joined:
            lines = [b"".join(joined[k : k + LINE]).decode() for k in range(0, len(joined), LINE)]
            self._learn(joined, self._whole(lines))
        single = [p for p in parts if p not in self._known]
        self._learn(single, self._whole([p.decode() for p in single]), alone=True)

    def _cut(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of texts that are cut into pieces."""
        if len(self._ends) > MOST_PIECES or len(self._pool) > MOST_IDS:
            self._forget()
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        starts, odd = _pieces(data, bounds)
        buffers = [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        pieces, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        as_parts = np.zeros(len(pieces), bool)
        as_parts[which[odd]] = True
        known = self._known
        new = [(p, o) for p, o in zip(pieces, as_parts.tolist()) if p not in known]
        if words := [p for p, o in new if not o]:
            self._learn_words(words)
        if parts := [p for p, o in new if o]:
            self._learn_parts(parts)
        number = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))[which]
        places = self._ends[number - 1]
        counts = self._ends[number] - places
        after = np.concatenate(([0], np.cumsum(counts)))
        ids = self._pool[np.repeat(places - after[:-1], counts) + np.arange(after[-1])]
        stops = after[np.searchsorted(starts, bounds)].tolist()
        for a, b in zip(stops, stops[1:]):
            yield ids[a:b].tobytes()
        for p, _ in new:
            if len(p) > LONGEST_PIECE:
                del known[p]


def _pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of texts start, and which of them are parts for the library's pattern."""
    following = np.append(data[1:], np.uint8(0))
    following[bounds[1:][bounds[1:] > 0] - 1] = 0  # nothing follows the end of a text
    space, seen = data == SPACE, _VISIBLE[following]
    cut = space & seen
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    odd = _OTHER[data] | ((space | (data == NEWLINE)) & ~seen)
    odd |= (data == 0xC3) & ((following == 0x97) | (following == 0xB7))  # signs of multiplication and division
    kind = _KIND[data]
    change = np.zeros(len(data), bool)
    change[1:] = (kind[1:] != kind[:-1]) & ~space[:-1]
    starts, inside = np.flatnonzero(cut), np.flatnonzero(change & ~cut)
    parts = np.zeros(len(starts), bool)
    parts[np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1] = True
    if parts.any():
        inside = inside[~parts[np.searchsorted(starts, inside, side="right") - 1]]
    both = cut
    both[inside] = True
    places = np.flatnonzero(both)
    return places, parts[np.searchsorted(starts, places, side="right") - 1]


def token_ids(vocabulary: str) -> TokenIds:
    """The encoder of a vocabulary, kept by a Python worker over its tasks."""
    return process_cache(f"tokens:{vocabulary}", lambda: TokenIds(vocabulary))


# Splits a text exactly as the vocabulary's own pattern does, if no two white-space
# characters meet; without the look-ahead of that pattern it runs much faster.
_PLAIN = r"'(?:[stmd]|re|ve|ll)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"


def rank_encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """The same ids from the vocabulary's rank file (same name, ``.tiktoken``), by a faster encoder.

    A rank file knows no added tokens: a text that holds one of their strings goes to the tokenizers library.
    """

    def build():
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as lines:
            merges = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
        with open(vocabulary) as file:
            added = [t["content"] for t in json.load(file).get("added_tokens", ())]
        plain, full = (
            tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
            for name, pattern in (("plain", _PLAIN), ("full", public_tokenizers.PATTERN))
        )
        return plain, full, added

    plain, full, added = process_cache(f"ranks:{vocabulary}", build)

    def encode(text: str) -> list[int]:
        if any(token in text for token in added):
            return array("I", next(token_ids(vocabulary).encode([text]))).tolist()
        flat = text.replace("\n", " ")  # isprintable: no white space but single spaces
        return plain(text) if flat.isprintable() and "  " not in flat else full(text)

    return encode
