import itertools
import zlib

import numpy as np
import pyarrow as pa

from tessella.llm import bytestext as bt
from tessella.llm import crf


def test_marginals_by_enumeration():
    r = np.random.default_rng(0)
    model = crf.Field(turns=r.normal(size=(2, 2)))
    lengths = [1, 4, 2, 5]
    score = r.normal(size=sum(lengths)) * 2
    starts = np.cumsum([0, *lengths[:-1]])
    p, pairs = model.marginals(score, starts)
    for s, n in zip(starts, lengths):
        weight = {}
        for z in itertools.product((0, 1), repeat=n):
            weight[z] = np.exp(sum(score[s + i] * z[i] for i in range(n)) + sum(model.turns[z[i - 1], z[i]] for i in range(1, n)))
        total = sum(weight.values())
        for i in range(n):
            assert np.isclose(p[s + i], sum(w for z, w in weight.items() if z[i]) / total)
            for a, b in itertools.product((0, 1), repeat=2):
                assert np.isclose(pairs[s + i, a, b], sum(w for z, w in weight.items() if i and (z[i - 1], z[i]) == (a, b)) / total)


def make(prose, n):
    docs, labels = [], []
    for i in range(n):
        words = prose(i, 40).split()
        y = int(i % 4 == 0)
        if y:
            for k in range(3):
                words.insert(7 * k + i % 5, ["badword", "vilestka", "vilestmi", "Vilestru"][(i + k) % 4])
        docs.append((i, " ".join(words) + ".", "s"))
        labels.append((i, y))
    return docs, labels


def test_held_out_documents_and_spans(spark, prose):
    docs, labels = make(prose, 240)
    got = crf.toxicity(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    y, text = dict(labels), {d[0]: d[1] for d in docs}
    assert len(got) == 240 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in got if r["held_out"]]) > 0.97
    found = {text[r["doc_id"]][s["start"] : s["end"]].lower()[:6] for r in got for s in r["spans"]}
    assert found <= {"badwor", "vilest"} and found


def test_labels_of_held_out_rows_are_not_read(spark, prose):
    docs, labels = make(prose, 80)
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, crf.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).select("doc_id", "score").collect())) for x in (labels, other))
    assert a == b


def test_odd_and_empty(spark, odd_docs):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    got = crf.toxicity(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert crf.toxicity(odd_docs.limit(0), none).count() == 0


def test_sentences():
    data, offsets = bt.utf8(pa.array(["a b. c\nd", None, "e"]))
    w = crf.read(data, offsets)
    assert w.row.tolist() == [0, 0, 0, 0, 2] and w.sentences.tolist() == [0, 2, 3, 4]
