"""SimHash groups and repeated substrings, against brute force."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from tallycast.llm import graph, near_copies, simhash, substrings
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    """values: {id: fingerprint}; the smallest id reachable over links of two bits or fewer."""
    parent = {i: i for i in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if a < b and (values[a] ^ values[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in values}


def fixture_texts():
    base = prose(400, 1)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in range(0, 400, 9)]
    return [None, "", "  \n", "One", "one", "ONE two", base, base, base.upper(), *near, prose(20000, 2), "Ünï çödé " * 5, "a " * 300]


def test_groups_match_brute_force(spark, docs):
    texts = dict(enumerate(fixture_texts()))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs(texts.items())).collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: fp for i, (fp, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == components(prints)
    assert len(set(components(prints).values())) < len(prints) - 10  # near copies did meet


def test_every_distance_up_to_two_bits_is_linked(spark):
    x = 0x0123456789ABCDEF
    values = {0: x, 1: x ^ 1, 2: x ^ 1 ^ (1 << 63), 3: x ^ (7 << 20), 4: x ^ (3 << 40), 5: 0, 6: 2**64 - 1, 7: 3, 8: 12}
    signed = {i: v - 2**64 if v >> 63 else v for i, v in values.items()}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    parts = {r.node: r.component for r in graph.connected_components(simhash.link(frame)).collect()}
    label = {i: parts.get(v, v) for i, v in signed.items()}
    expected = components(values)
    assert all((label[a] == label[b]) == (expected[a] == expected[b]) for a in values for b in values)


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1200)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (2000, 2001), (2001, 2000)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 1000 for i in range(1001, 1200)}, 2001: 2000}


def test_keep_one_and_edge_cases(spark, docs):
    base = prose(300, 3)
    frame = docs([(4, base), (2, base + " end"), (2, base + " end"), (9, "other words here"), (None, "null id"), (7, None), (8, "")])
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 7), (False, 9), (True, None)]
    empty = docs([])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_keep_one_tells_rows_of_one_id_apart(spark, docs, repeated):
    a, b, c, d = (prose(80, 40 + k) for k in range(4))
    rows = [(None, a), (None, a), (None, b), (5, c), (6, c), (None, c)] + [(9, d), (9, prose(80, 50)), (9, d)] * repeated
    expected = [(5, c), (None, a), (None, b)] + [(9, d), (9, prose(80, 50))] * repeated
    key = lambda r: (r[0] or 0, r[1])
    for module in (simhash, near_copies):
        got = [(r.doc_id, r.text) for r in module.keep_one(docs(rows)).collect()]
        assert sorted(got, key=key) == sorted(expected, key=key)


def test_passages_are_found_and_clean_texts_left_alone(spark, docs):
    passage = prose(60, 5)
    texts = [(i, f"{prose(50 + i, 100 + i)} {passage} {prose(40, 200 + i)}") for i in range(8)]
    clean = [(i, prose(300, 300 + i)) for i in range(20, 26)]
    inner = prose(60, 7)
    frame = docs([*texts, *clean, (30, inner + " x " + inner), (31, None), (32, ""), (None, passage)])
    spans = substrings.repeated_spans(frame).collect()
    by = dict(texts)
    assert {r.doc_id for r in spans} == set(by)
    for r in spans:
        assert by[r.doc_id][r.start : r.stop] in passage and r.first_doc_id == 0
        assert (r.repeats == []) == (r.doc_id == 0)
    assert substrings.repeated_spans(docs([])).count() == 0


def test_removal_keeps_the_first_holder(spark, docs):
    passage = prose(80, 5)
    frame = docs([(1, f"Ä {passage} b"), (2, f"{prose(9, 1)} {passage} é"), (3, "alone"), (3, "alone"), (4, None)])
    out = substrings.remove_repeats(frame)
    assert out.columns == frame.columns
    rows = out.collect()
    assert len(rows) == 5
    text = {r.doc_id: r.text for r in rows}
    assert text[1] == f"Ä {passage} b" and text[3] == "alone" and text[4] is None
    assert len(text[2]) < 200 and text[2].endswith("é") and next(r for r in rows if r.doc_id == 2).n_chars == len(text[2])


def test_boundaries_resist_insertions():
    import numpy as np

    data = prose(3000, 9).encode()
    moved = b"inserted words " + data
    cut = lambda b: {x - len(b) for x in substrings.boundaries(np.frombuffer(b, dtype=np.uint8)).tolist()}
    assert len(cut(data) & cut(moved)) > 0.98 * len(cut(data))
    same = substrings.boundaries(np.full(5000, 97, dtype=np.uint8))
    assert np.diff(same, prepend=0).max() <= substrings.LONGEST and same[-1] == 5000


def jaccard(a, b, width=5):
    def runs(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at : at + 1] = [[f"new{rng.randrange(10**6)}"], [], [words[at], "more"]][kind]
    return " ".join(words)


def test_near_copies_match_brute_force(spark, docs):
    rng = random.Random(5)
    base = [prose(n, 700 + n) for n in (6, 40, 150, 151, 600)]
    texts = [None, "", "one two", "One TWO", *base]
    texts += [edited(b, rng, rng.randrange(1, 2 + len(b.split()) // 20)) for b in base for _ in range(12)]
    common = " with one common line in every one of these texts"
    texts += [prose(60, 800 + i) + common for i in range(30)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    prints = [fingerprint(t) for t in texts]
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in pairs) > 20  # what two bits would miss
    expected = [find(i) for i in range(len(texts))]
    got = {r.doc_id: r.component for r in near_copies.similar_groups(docs(enumerate(texts))).collect()}
    names = {c: min(i for i in got if got[i] == c) for c in got.values()}
    assert [names[got[i]] for i in range(len(texts))] == expected
    kept = near_copies.keep_one(docs(enumerate(texts)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))
    assert near_copies.keep_one(docs([])).count() == 0


def test_similarity_of_exactly_four_fifths_is_found(spark, docs):
    words = prose(13, 11).split()  # 9 shingles; the copy holds 10, all 9 among them, or 8 of its own 9
    texts = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(words[:-1])), (4, " ".join([*words, "x", "y", "z"]))]
    assert jaccard(texts[1][1], texts[2][1]) == 0.8 and jaccard(texts[0][1], texts[3][1]) == 0.75
    got = {r.doc_id: r.component for r in near_copies.similar_groups(docs([texts[1], texts[2]])).collect()}
    assert got[2] == got[3]
    got = {r.doc_id: r.component for r in near_copies.similar_groups(docs([texts[0], texts[3]])).collect()}
    assert got[1] != got[4]


def test_nodes_meet_once_at_their_first_shared_shingle(spark):
    places = "shingle long, node long, n long, i int, part long"
    met = lambda held: near_copies._met(spark.createDataFrame(held, places)).collect()
    # 30 texts of one passage, each with a prefix that ends elsewhere in it: 435 pairs, which share 20 shingles and more.
    nodes = {node: list(range(20 + node % 7)) for node in range(30)}
    got = met([(s, node, 900, i, node) for node, held in nodes.items() for i, s in enumerate(held)])
    assert len({frozenset(r) for r in got}) == len(got) == 30 * 29 // 2
    rng = random.Random(8)
    nodes = {node: (rng.randrange(60, 300), sorted(rng.sample(range(80), rng.randrange(1, 25)))) for node in range(60)}
    got = met([(s, node, n, i, node % 50) for node, (n, held) in nodes.items() for i, s in enumerate(held)])
    expected = set()
    for a, (n, x) in nodes.items():
        for b, (m, y) in nodes.items():
            if shared := set(x) & set(y):
                left = min(n - x.index(min(shared)), m - y.index(min(shared)))
                if a < b and a % 50 != b % 50 and 5 * min(n, m) >= 4 * max(n, m) and 9 * left >= 4 * (n + m):
                    expected.add(frozenset((a, b)))
    assert expected and {frozenset(r) for r in got} == expected
