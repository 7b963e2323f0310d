import bisect
import math
import zlib
from collections import Counter

import pytest
import xxhash

from tessella.llm import ring


@pytest.mark.parametrize("sub_rows", [256, 3])
def test_laws(spark, prose, odd_docs, monkeypatch, sub_rows):
    monkeypatch.setattr(ring, "SUB_ROWS", sub_rows)
    texts = [prose(i, 5) for i in range(150)] + ["same"] * 80 + [r["text"] for r in odd_docs.collect()]
    rows = ring.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    n = Counter(r["shard"] for r in rows)
    counts = [n[s] for s in range(40)]
    assert max(counts) - min(counts) <= 1
    for s in n:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n[s]))
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


def test_equal_texts_and_movement(spark, prose):
    docs = spark.createDataFrame([(i, prose(i // 2, 6)) for i in range(800)], "doc_id long, text string")
    a = {r["doc_id"]: r["shard"] for r in ring.shard(docs, 10, load=1.25).collect()}
    b = {r["doc_id"]: r["shard"] for r in ring.shard(docs, 11, load=1.25).collect()}
    assert max(Counter(a.values()).values()) <= 100
    assert sum(a[i] == a[i + 1] for i in range(0, 800, 2)) > 350
    assert sum(a[i] != b[i] for i in a) < 300


def test_empty(spark, odd_docs):
    assert ring.shard(odd_docs.limit(0)).count() == 0
    assert ring.shard(odd_docs).count() == odd_docs.count()


def walked(rows, shards, replicas, capacity):
    """Places every row by a walk round the ring, one row at a time; rows: doc_id and the place of its text, ids distinct."""
    nodes = sorted((xxhash.xxh64_intdigest(f"shard-{s}-node-{r}", 0) - 2**63, s) for s in range(shards) for r in range(replicas))
    places, room, arcs = [p for p, _ in nodes], dict(enumerate(capacity)), {}
    for doc, place, turn in rows:
        arcs.setdefault(bisect.bisect_left(places, place) % len(nodes), []).append((turn, doc))
    waiting, used, out = [], [0] * shards, {}
    for step in range(2 * len(nodes)):
        node = step % len(nodes)
        if step < len(nodes):
            waiting += [d for _, d in sorted(arcs.get(node, []))]
        shard, rest = nodes[node][1], []
        for doc in waiting:
            if room[shard]:
                room[shard] -= 1
                out[doc] = (shard, used[shard])
                used[shard] += 1
            else:
                rest.append(doc)
        waiting = rest
    return out


@pytest.mark.parametrize("shards, replicas, load, sub_rows", [(40, 64, None, 256), (7, 5, None, 3), (10, 16, 1.25, 16)])
def test_shards_and_slots_of_a_plain_walk(spark, prose, monkeypatch, shards, replicas, load, sub_rows):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ring, "SUB_ROWS", sub_rows)
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else prose(i // 2, 6)) for i in range(700)], "doc_id long, text string")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("place"), F.xxhash64("doc_id").alias("turn")).collect()
    n = len(keyed)
    capacity = [n // shards + (s < n % shards) for s in range(shards)] if load is None else [math.ceil(load * n / shards)] * shards
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in ring.shard(docs, shards, replicas, load).collect()}
    assert got == walked([tuple(r) for r in keyed], shards, replicas, capacity)


def test_little_moves(spark, prose):
    docs = spark.createDataFrame([(i, prose(i, 6)) for i in range(2000)], "doc_id long, text string")
    a, b = ({r["doc_id"]: r["shard"] for r in ring.shard(docs, n, load=1.25).collect()} for n in (20, 21))
    moved = sum(a[i] != b[i] for i in a)
    assert moved < 2 * 2000 / 21 and sum(b[i] == 20 for i in b) <= math.ceil(1.25 * 2000 / 21)


def test_rows_without_an_id_spread(spark, monkeypatch):
    monkeypatch.setattr(ring, "SUB_ROWS", 8)
    docs = spark.createDataFrame([(None, "same")] * 300 + [(1, "x")], "doc_id long, text string")
    rows = ring.shard(docs, 5, 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(5) for i in range(61 if s == 0 else 60)]
