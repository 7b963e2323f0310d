import re

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, most=4):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= most:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_whole_table(spark, prose, odd_docs):
    texts = [r["text"] for r in odd_docs.collect()] + [prose(i, 300 + i) for i in range(6)] + [prose(1, 2000) + f" end{i}" for i in range(5)] + [prose(1, 2000).replace(" ", "\n\t", 7), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [fingerprint(t) for t in texts]
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == [(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, classes(fps)))]


@pytest.mark.parametrize("cell", [1000, 5])
def test_links_and_hot_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    r = np.random.default_rng(3)
    fps = {int(x) for x in r.integers(0, 2**63, 40)}
    for _ in range(120):
        base = int(r.choice(sorted(fps)))
        for b in r.choice(64, int(r.integers(1, 7)), replace=False):
            base ^= 1 << int(b)
        fps.add(base)
    signed = [f - 2**64 if f >= 2**63 else f for f in sorted(fps)]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, least long")
    edges = simhash.near_links(nodes, 4)
    assert all(((r["a"] ^ r["b"]) & 2**64 - 1).bit_count() <= 4 for r in edges.collect())
    got = sorted(map(tuple, simhash.components(nodes, edges, "fp", "least").collect()), key=lambda x: signed.index(x[0]))
    assert [x[1] for x in got] == classes(sorted(fps))


def test_lower_bound():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 500, dtype=np.uint64), r.integers(0, 2**63, 500, dtype=np.uint64)
    b[:250] = a[:250] ^ (np.uint64(1) << r.integers(0, 64, 250, dtype=np.uint64))
    assert simhash._linked(a, b, 4).tolist() == (np.bitwise_count(a ^ b) <= 4).tolist()


def test_empty(spark, odd_docs):
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count()


def test_null_and_repeated_ids(spark, prose):
    a, b = prose(1, 900), prose(2, 900)
    near = lambda t, k: t + f" end{k}"
    assert all((fingerprint(x) ^ fingerprint(near(x, 1))).bit_count() <= 4 for x in (a, b)) and (fingerprint(a) ^ fingerprint(b)).bit_count() > 8
    rows = [(3, a), (1, near(a, 1)), (3, b), (5, near(b, 1)), (None, near(b, 2)), (None, prose(3, 40)), (7, prose(4, 40)), (7, prose(5, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([(3, 1), (1, 1), (3, 3), (5, 3), (0, 3), (0, 0), (7, 7), (7, 7)])
    kept = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(docs, shingle=4, words=1, grid_words=1, agree=4, most=4).collect()]
    assert sorted(kept, key=repr) == sorted([(1, near(a, 1)), (3, b), (None, prose(3, 40)), (7, prose(4, 40)), (7, prose(5, 40))], key=repr)


def test_null_ids_within_chains(spark):
    fps = [0, 0b1111, 0b11111111, 1 << 60, (1 << 60) + 0b1111, 0b111111111111]
    ids = [1, None, 5, None, 9, None]
    nodes = spark.createDataFrame([(f, i) for f, i in zip(fps, ids)], "fp long, least long")
    got = {r["fp"]: r["least"] for r in simhash.components(nodes, simhash.near_links(nodes, 4), "fp", "least").collect()}
    assert got == {0: 1, 0b1111: 1, 0b11111111: 1, 0b111111111111: 1, 1 << 60: 1, (1 << 60) + 0b1111: 1}


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_of_five_words(spark, prose):
    rows, caught = [], {}
    for k in range(60):
        w = prose(k, 400).split()
        v = w[:]
        for i in range(k // 3):
            v[(i * 37 + k * 31) % 400] = f"new{i}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(60)} <= kept
    for k in range(60):
        a, b = shingles(rows[2 * k][1]), shingles(rows[2 * k + 1][1])
        alike = len(a & b) / len(a | b)
        caught.setdefault(0.9 if alike >= 0.9 else 0.8 if alike >= 0.8 else 0.7 if alike >= 0.7 else 0, []).append(2 * k + 1 not in kept)
    share = {alike: sum(c) / len(c) for alike, c in caught.items()}
    assert share[0.9] >= 0.95 and share[0.8] >= 0.6 and share[0.7] <= 0.4 and not share[0]


def test_clashing_names_and_repeated_rows(spark, prose):
    rows = [(1, prose(1), "a"), (1, prose(1), "a"), (2, prose(1), "b"), (3, None, "c"), (4, "", "d")]
    docs = spark.createDataFrame([(*r, *"wxyz") for r in rows], "doc_id long, text string, id string, k1 string, _k1 string, K2 string, `fp` string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, prose(1), "a", *"wxyz"), (3, None, "c", *"wxyz")]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_hot_cells_are_not_compared_as_a_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    r = np.random.default_rng(3)
    fps = sorted({int(1 << r.integers(0, 62)) | int(1 << r.integers(0, 62)) for _ in range(300)})
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, least long")
    got = simhash.components(nodes, simhash.near_links(nodes, 4), "fp", "least").collect()
    assert {x["least"] for x in got} == {0}


def test_a_large_group_gives_few_edges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    r = np.random.default_rng(4)
    base = r.integers(0, 256, 64, dtype=np.uint8)
    rows = []
    for i in range(400):
        bits = np.unpackbits(base)
        bits[r.choice(512, 20, replace=False)] ^= 1
        rows.append((i, bytes(np.packbits(bits))))
    nodes = spark.createDataFrame(rows, "id long, fp binary")
    edges = simhash._contracted(simhash.near_links(nodes, 80, 3, 3))
    assert edges.count() < 2 * 400
    assert {x["l"] for x in simhash.components(nodes.selectExpr("id AS node", "id AS l"), edges, "node", "l").collect()} == {0}
