import zlib

import numpy as np
import pyarrow as pa

from tessella.llm import bytestext as bt
from tessella.llm import rules


def make(prose, n):
    docs, labels = [], []
    for i in range(n):
        t, y = prose(i, 50), int(i % 3 > 0)
        if not y:
            t = [t.upper().replace(" ", "!! "), t.replace(" ", " | "), " ".join(w for w in t.split() for _ in range(9))][i // 3 % 3]
        docs.append((i, t))
        labels.append((i, y))
    return docs, labels


def test_held_out_accuracy_and_column(spark, prose):
    docs, labels = make(prose, 300)
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = rules.train(frame, known)
    assert 0 < len(model.rules) < 200
    got = {r["doc_id"]: r for r in rules.quality(frame, known).collect()}
    y = dict(labels)
    held = [i for i in y if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in y)
    assert np.mean([got[i]["predicted"] == y[i] for i in held]) > 0.95
    data, offsets = bt.utf8(pa.array([t for _, t in docs]))
    assert np.allclose(model.predict(rules.statistics(data, offsets)), [got[i]["score"] for i, _ in docs])


def test_statistics_by_hand():
    data, offsets = bt.utf8(pa.array(["Aa aa b!\nx | x", "", None, "12"]))
    x = dict(zip(rules.STATISTICS, rules.statistics(data, offsets).T))
    assert x["n_words"].tolist() == [6, 0, 0, 1]
    assert x["same_next"][0] == 1 / 6 and x["bars"][0] == 1 / 6 and x["line_words"][0] == 3
    assert x["distinct"][0] == 4 / 6 and x["top_word"][0] == 2 / 6 and x["digits"][3] == 1


def test_odd_and_empty(spark, odd_docs):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    got = rules.quality(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert rules.quality(odd_docs.limit(0), none).count() == 0
