"""Sharding, packing, neighbour search, and the pipeline as a whole."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.llm import neighbours, packing, sharding
from tests.llm.conftest import prose


def check_shards(rows, texts, shards=16):
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((i is None, i) for i, _ in texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    return by


def test_shards_have_near_equal_bytes(spark, docs):
    texts = [(i, prose(20 + i % 70, i % 900)) for i in range(3000)]
    rows = sharding.shard_by_bytes(docs(texts)).collect()
    check_shards(rows, texts)
    load, text = Counter(), dict(texts)
    homes = defaultdict(set)
    for r in rows:
        load[r.shard] += r.size
        homes[text[r.doc_id]].add(r.shard)
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    mean = sum(load.values()) / 16
    assert len(load) == 16 and all(abs(v - mean) < 0.03 * mean for v in load.values())
    assert all(len(h) == 1 for h in homes.values())


def test_a_group_larger_than_a_shard_is_split(spark, docs):
    texts = [(i, "copy " * 40) for i in range(1000)] + [(1000 + i, prose(30, i)) for i in range(2000)]
    load = Counter()
    for r in sharding.shard_by_bytes(docs(texts)).collect():
        load[r.shard] += r.size
    mean = sum(load.values()) / 16
    assert all(abs(v - mean) < 0.05 * mean for v in load.values())


def test_sharding_edge_cases(spark, docs):
    texts = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "é" * 50000)]
    rows = sharding.shard_by_bytes(docs(texts)).collect()
    check_shards(rows, texts)
    assert {r.doc_id: r.size for r in rows} == {1: 1, 2: 1, None: 2, 3: 100001}
    assert sharding.shard_by_bytes(docs([])).count() == 0
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, sharding.shard_by_bytes(docs(texts)).collect()), key=str)


P = pytest.importorskip("public_tokenizers")


def test_packing_keeps_every_token(spark, docs):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [
        (1, None), (2, ""), (3, "  two  spaces \n\n\n and\tmore   x \x1c y"), (4, "<|endoftext|> it's 12½ ½ 漢字 😀"),
        (5, prose(9000, 1)), (5, prose(9000, 1)), (None, "no id"), (6, "a" * 3000), *[(10 + i, prose(5 + i * 7 % 300, i)) for i in range(200)],
    ]
    rows = packing.pack(docs(texts).repartition(3), P.path("byte_bpe_50k.json")).collect()
    ids = {i: np.array([*real.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in texts}
    copies, held, places = Counter(i for i, _ in texts), Counter(), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        held[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert held == {i: n * len(ids[i]) for i, n in copies.items()}
    short = 0
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
        short += end < 1024
    assert short <= 3  # one for each task
    assert packing.pack(docs([]), P.path("byte_bpe_50k.json")).count() == 0


def test_placement_minimises_the_sum_of_squares():
    from array import array

    packer, open_windows = packing.Packer(16, 0), Counter()
    rng = np.random.default_rng(1)
    for n in rng.integers(1, 16, 400).tolist():
        def cost(level):
            after = Counter(open_windows)
            if level:
                after[level] -= 1
            if level + n < 16:
                after[level + n] += 1
            return sum(v * v for v in after.values())

        options = [0, *[x for x, v in open_windows.items() if v and x + n <= 16]]
        best = min(options, key=lambda x: (cost(x), -x))
        packer.place(1, array("I", [0] * (n - 1)), 0)
        if best:
            open_windows[best] -= 1
        if best + n < 16:
            open_windows[best + n] += 1
        assert {x: int(v) for x, v in enumerate(packer.level) if v} == {x: v for x, v in open_windows.items() if v}


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 48))
    v = (centres[rng.integers(0, 20, 5000)] + 0.4 * rng.standard_normal((5000, 48))).astype(np.float32)
    v[100:160] = v[7]  # one vector many times
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    odd = [(-100, None, 1), (5100, [0.0] * 48, 1), (5200, [float("nan")] + [1.0] * 47, 1), (5300, [None] + [1.0] * 47, 1),
           (5400, [1.0, 2.0], 1), (5401, [1.0, 2.5], 1), (None, [1.0] * 48, 1), (5500, [float("inf")] * 48, 1), (5600, [], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in neighbours.search(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    assert set(got) == {*range(0, 5000, 100), 5400} and [x[0] for x in got[5400]] == [5401]
    found = 0
    exact = v.astype(np.float64)
    for q in range(0, 5000, 100):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        order = np.lexsort((np.arange(5000), d))[:10]
        assert [x[2] for x in got[q]] == list(range(1, 11))
        assert all(abs(d[i] - s) < 1e-12 for i, s, _ in got[q])
        assert [s for _, s, _ in got[q]] == sorted(s for _, s, _ in got[q])
        found += len(set(order.tolist()) & {i for i, _, _ in got[q]})
    assert found / 500 >= 0.98
    assert neighbours.search(frame.limit(0)).count() == 0


def test_bounds_hold_for_most_pairs():
    rng = np.random.default_rng(5)
    v, q = rng.standard_normal((2000, 64)), rng.standard_normal((50, 64))
    turn, centre = neighbours.rotation(64), v.mean(axis=0)
    bits, norm, own = neighbours.encode(v, centre, turn)
    assert bits.shape == (2000, 8)
    moved = (q - centre) @ turn
    low, high = neighbours.bounds(bits, norm, own, moved, np.linalg.norm(moved, axis=1))
    real = ((q[:, None] - v[None]) ** 2).sum(axis=2)
    assert ((low <= real) & (real <= high)).mean() > 0.99


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    item = prose(12, 9077)
    base = prose(200, 1)
    texts = [(i, prose(80, 50 + i) + (" vexbald grumtosh" if i % 4 == 0 else "")) for i in range(100)]
    texts += [(200, base), (201, base), (202, f"{prose(30, 3)} {item} {prose(30, 4)}"), (203, "password = abcdefghij " + prose(30, 5)), (204, None)]
    folder = str(tmp_path)
    docs(texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    frame, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, folder)
        assert sorted(out.columns) == sorted(frame.columns)
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        frame = out
    clean = {i for i in range(100) if i % 4}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert kept[names[0]] == clean | {200, 201, 202, 203, 204}
    assert kept[names[1]] == clean | {200, 202, 203, 204}
    assert kept[names[2]] == kept[names[3]] == clean | {200, 203, 204}
    assert "abcdefghij" not in frame.where("doc_id = 203").first().text
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept[names[3]]
    assert packed.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in packed.dropDuplicates(["doc_id"]).collect())


def test_pipeline_drops_edited_copies(spark, docs, tmp_path):
    import corpus_pipeline

    words = prose(300, 1).split()
    copies = [(k, " ".join([*words[:k], "changed", *words[k + 1 : k + 150], "other", *words[k + 151 :]])) for k in range(20, 140, 20)]
    far = " ".join("changed" if i % 20 == 0 else w for i, w in enumerate(words))  # a similarity of 0.6
    frame = docs([(1, " ".join(words)), *copies, (500, far), (501, prose(80, 2))])
    out = corpus_pipeline.STAGES[1][1](spark, frame, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [1, 500, 501]
