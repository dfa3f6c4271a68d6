"""Wavelet matrices, spelling variants and the conversation trie against brute force."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallycast.llm import common, prefixes, spelling, tokens, wavelet
from tests.llm.conftest import prose

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")
ODD = ["", None, "<|endoftext|> hello", " a  b\n c", "x<|endoftext|>y", "don't 's  ", "a\n\n b", "\x1c a", "é ́x 日本 \U0001f600", "  ", "a "]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


# Wavelet matrix


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300), st.integers(0, 70_000))
def test_a_matrix_answers_as_the_sequence_does(ids, other):
    matrix = wavelet.Matrix(wavelet.build(np.array(ids, dtype=np.uint32), block=64))
    assert matrix.ids().tolist() == ids
    for at in range(0, len(ids), 17):
        assert matrix.access(at) == ids[at]
    for value in {*ids[:5], other}:
        places = [i for i, x in enumerate(ids) if x == value]
        assert matrix.count(value) == len(places)
        assert matrix.rank(value, len(ids) // 2) == ids[: len(ids) // 2].count(value)
        assert [matrix.locate(value, n) for n in range(len(places))] == places
        with pytest.raises(IndexError):
            matrix.locate(value, len(places))
    with pytest.raises(IndexError):
        matrix.access(len(ids))


def expected_ids(pairs):
    out, start = [], 0
    for doc_id, text in pairs:
        ids = np.array([*ids_of(text), 0], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_ids_are_read_back_from_the_files(spark, docs, tmp_path):
    pairs = [(i, ODD[i % len(ODD)] if i % 3 == 0 else prose(5 + i % 50, i)) for i in range(200)] + [(500, prose(30_000, 9))]
    shuffled = random.Random(3).sample(pairs, len(pairs))
    path = str(tmp_path / "ids")
    wavelet.write(docs(shuffled), path, VOCABULARY, shard_ids=700, block=256)
    shards = wavelet.read(spark, path)
    assert shards.count() > 10 and shards.where(F.size("doc_ids") == 0).isEmpty()
    found = sorted(tuple(r) for r in wavelet.documents(shards).collect())
    assert found == expected_ids(pairs)
    corpus = [x for _, text in pairs for x in (*ids_of(text), 0)]
    asked = [0, corpus[40], 50256, 49999]
    places = {tuple(r) for r in wavelet.occurrences(shards, asked).collect()}
    assert places == {(x, i) for i, x in enumerate(corpus) if x in asked}


def test_distinct_parts_travel_together():
    encoder = tokens.TokenIds(VOCABULARY)
    whole, sent = encoder._whole, []
    encoder._whole = lambda texts: sent.append(len(texts)) or whole(texts)
    texts = [prose(4000, 90), "é" * 70 + " <|endoftext|> x\n y" + " 日本\t語", "", " a", "two  spaces", *(prose(40, k) for k in range(5))]
    expected = [x for text in texts for x in whole([text])]
    assert list(encoder.encode(texts)) == expected == list(encoder.encode(texts))
    assert sum(sent) < 100  # one string for each of some 4,000 distinct parts before
    encoder._known, encoder._bytes = {}, encoder._bytes + 1  # lengths that do not fit: each part by itself
    assert list(encoder.encode(texts)) == expected


def test_words_need_no_pattern():
    encoder = tokens.TokenIds(VOCABULARY)
    whole, sent = encoder._whole, []
    encoder._whole = lambda texts: sent.extend(texts) or whole(texts)
    texts = [" Größe, größe. größe!!\nĀb12 größe Жук_", "größe, größe", "größe don't größe  größe\n"]
    assert list(encoder.encode(texts)) == [array("I", ids_of(t)).tobytes() for t in texts]
    assert sent == [" don't größe  größe\n"]  # three parts that hold more than words, as one text
    assert " größe".encode() in encoder._known and " größe,".encode() not in encoder._known


def test_pieces_keep_the_ids_of_any_character():
    odd = random.Random(4)
    signs = "ab  \n'st1.<-é×÷ÀʯʿЖѿ҂日 \u2003\u3000\x85“\t\r\x1c\x7f\x00²º\u0301\U0001f600"
    texts = ["".join(odd.choices(signs, k=odd.randint(0, 30))) for _ in range(3000)]
    texts += [f"a{chr(c)}b the{chr(c) * 2} {chr(c)}ing" for c in range(1, 0x500)]
    encoder = tokens.TokenIds(VOCABULARY)
    assert list(encoder.encode(texts)) == encoder._whole(texts)


def test_ids_of_null_repeated_and_no_rows(spark, docs, tmp_path):
    pairs = [(None, "b c"), (1, None), (1, None), (2, "x"), (2, "x")]
    wavelet.write(docs(pairs).withColumnRenamed("n_chars", "part").withColumn("image", F.lit(1)), str(tmp_path / "a"), VOCABULARY)
    found = wavelet.documents(wavelet.read(spark, str(tmp_path / "a"))).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.start, r.n_tokens) for r in found) == [
        (False, 1, 3, 1), (False, 1, 4, 1), (False, 2, 5, 2), (False, 2, 7, 2), (True, None, 0, 3),
    ]
    wavelet.write(docs([]), str(tmp_path / "b"), VOCABULARY)
    assert wavelet.documents(wavelet.read(spark, str(tmp_path / "b"))).count() == 0


# Spelling variants


def expected_variants(pairs):
    n = Counter()
    for doc_id, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, []
    for w in n:
        others = sorted((x for x in n if abs(len(x) - len(w)) <= 1 and x != w and near(w, x)), key=lambda x: (-n[x], x))
        form[w] = others[0] if others and n[others[0]] >= 2 * n[w] else None
        out.append((w, len(others)))
    result = []
    for w, k in out:
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, n[w], k, n[form[w]] if form[w] else None))
    return sorted(result)


def misspelt(count, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßÀ") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    pairs = []
    for i in range(count):
        text = []
        for _ in range(30):
            w = words[int(60 * rng.random() ** 2)]
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] + "e", "Q"]) + w[at + 1 :]
            text.append(w if rng.random() < 0.8 else w.upper())
        pairs.append((i, " ".join(text)))
    return pairs


@pytest.mark.parametrize("block", [7, 1024])
def test_variants_match_brute_force(spark, docs, block):
    pairs = misspelt(150, 5) + [(None, "Étude " * 4 + "étude " * 9), (900, None), (901, ""), (902, "ab" * 30_000)] + [(903, "longer " * 5)] * 2
    found = spelling.variants(spelling.words(docs(pairs).withColumn("word", F.lit("x"))), block=block)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = expected_variants(pairs)
    assert any(r[1] and r[2] != r[1] for r in expected) and any(r[4] > 2 for r in expected)
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_variants_of_nothing(spark, docs):
    assert spelling.variants(spelling.words(docs([]))).count() == 0
    assert spelling.variants(spelling.words(docs([(1, None), (2, "abc abc abc")]))).count() == 0


def test_long_words_are_compared_whole():
    a, b = "a" * 5000 + "b", "a" * 5000 + "c"
    assert spelling.near_in_blocks([a, b, "c" + a[1:]], [a, b, "c" + a[1:]], True) == [(0, 1), (0, 2)]
    assert spelling.near_in_blocks([a], ["a" + a, a + "x", "xy" + a[1:]], False) == [(0, 0), (0, 1)]


# Conversation trie


def expected_trie(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    members, paths = defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    sums, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(sums[x][0] for x in below[node]) or 1, saved + sum(sums[x][1] for x in below[node]))
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(below[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATION = "conv_id long, turn int, role string, text string, k int, p string"


def talk(count, seed, most=14):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        for turn in range(rng.randint(0, most)):
            rows.append((c, turn, ("user", "assistant", None)[turn % 3], rng.choice(["yes", "no", "é", None, ""]) if turn > 1 else "hello"))
    return rows


@pytest.mark.parametrize("size,salt", [(4, 1 << 20), (1, 5), (3, 2)])
def test_trie_matches_brute_force(spark, monkeypatch, size, salt):
    monkeypatch.setattr(common, "SALT", salt)
    rows = talk(120, size) + [(200 + c, t, "user", f"same {t}") for c in range(40) for t in range(9)]
    rows += [(None, 1, "user", "x"), (300, None, "user", "first"), (300, 1, "user", "z"), (300, 1, "user", "z"), (301, 0, "system", "y" * 50_000)]
    rows += [(305, t, "user", f"long {t}") for t in range(70)] + [(306, t, "user", f"long {t}") for t in range(70)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION)
    found = prefixes.trie(*prefixes.rebuilt(table), size=size)
    assert sorted(map(tuple, found.collect()), key=str) == expected_trie(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    table = spark.createDataFrame([(4, 0, "user", "x", 1, "")], CONVERSATION)
    h = zlib.crc32(b"4") % 9
    assert h > 0  # so conversation 4 loses its only turn to an absent base
    found = prefixes.trie(*prefixes.rebuilt(table)).collect()
    assert [tuple(r) for r in found] == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]
    assert prefixes.trie(*prefixes.rebuilt(table.limit(0))).count() == 0
