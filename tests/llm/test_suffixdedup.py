import hashlib
import random

import numpy as np
import pytest

from tessella.llm import columnbwt, suffixdedup


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_transform_and_common_prefixes(seed):
    r = random.Random(seed)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 30))) for _ in range(12)] + [b"ab" * 20, b"ab" * 15]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    first, count = ends - [len(t) for t in texts], np.array([len(t) for t in texts])
    place, lcp = columnbwt.construct(data.astype(np.int64), first, count, 1)
    suffix = lambda p: bytes(data[p : ends[np.searchsorted(ends, p, "right")]])
    rows = [suffix(p) if p >= 0 else b"" for p in place.tolist()]
    assert rows == sorted(rows) and len(rows) == len(data) + len(texts)
    for k in range(1, len(rows)):
        n = 0
        while n < min(len(rows[k]), len(rows[k - 1])) and rows[k][n] == rows[k - 1][n]:
            n += 1
        assert lcp[k] == n


def collection(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ab", "cé", "d ", "x", "yz"]) for _ in range(r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(25)
    out = [text(r.randint(1, 60)) for _ in range(15)]
    out += [text(5) + passage + text(5) for _ in range(8)] + [passage[r.randint(0, 20) :] + text(3) for _ in range(6)]
    out += ["sting " * 60, "ing st" * 30 + "x", "a" * 300, passage + text(4) + passage]
    out += [out[3]] * 3 + [out[4] + "!", None, "", "short", "short"]
    return out


@pytest.mark.parametrize("length, hot", [(24, 2000), (40, 2000), (24, 1), (40, 1), (200, 2), (35, 3)])
def test_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    monkeypatch.setattr(suffixdedup, "PIECE", 8)
    monkeypatch.setattr(suffixdedup, "CHUNK", 256)
    monkeypatch.setattr(suffixdedup, "BUILD_BYTES", 2000)
    texts = collection(length)
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, kept string, k1 int")
    got = sorted(map(tuple, suffixdedup.digest(frame, length).collect()))
    assert got == [(i, *b) for i, b in enumerate(brute(texts, length))]


def test_cut_texts(spark, odd_docs, prose):
    assert suffixdedup.digest(odd_docs).count() == odd_docs.count()
    assert suffixdedup.digest(odd_docs.limit(0)).count() == 0
    shared = prose(9, 80)
    rows = [(1, "é" + shared + " end", "a"), (2, "start " + shared, "b"), (3, None, "c")]
    got = suffixdedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, _x string"), 50)
    assert got.columns == ["doc_id", "text", "_x"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "é end", 2: "start ", 3: None}


@pytest.mark.parametrize("length", [200, 40])
def test_edges_of_a_hot_passage(spark, monkeypatch, prose, length):
    monkeypatch.setattr(suffixdedup, "HOT", 10)
    passage = prose(1, 90)
    texts = [prose(100 + i, 12) + passage[: len(passage) - i % 7] + prose(300 + i, 12) for i in range(60)] + [prose(7, 80)] * 3 + [prose(8, 80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, suffixdedup.digest(frame, length).collect())) == [(i, *b) for i, b in enumerate(brute(texts, length))]


def test_clashing_names_and_tables_left(spark, prose):
    rows = [(i % 2, prose(9, 80), *"uvwxyz") for i in range(3)] + [(5, None, *"uvwxyz"), (6, "", *"uvwxyz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string, kept string, K1 string, k2 string, _k1 string, hits string")
    got = suffixdedup.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["kept"]) for r in got.na.fill("-", ["text"]).collect()) == [(0, "", "v"), (0, "", "v"), (1, "", "v"), (5, "-", "v"), (6, "", "v")]
    assert suffixdedup.without_repeats(docs.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessella_texts")]
