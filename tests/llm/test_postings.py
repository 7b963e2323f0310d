import hashlib
import re

from tessella.llm import postings

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(doc, items, window=13):
    d, hit, names = words(doc), set(), set()
    for name, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            x = w[s : s + window]
            for p in range(len(d) - len(x) + 1):
                if d[p : p + len(x)] == x:
                    hit.update(range(p, p + len(x)))
                    names.add(str(name))
    return len(d), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(d)


def check(spark, docs, items):
    got = postings.contamination(postings.build_index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in got) == sorted((i is not None, i or 0, *brute(t, [x for x in items if x[0] is not None])) for i, t in docs)


def test_brute_force(spark, prose, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT_BYTES", 3000)
    items = [(i, prose(100 + i, 20 + i)) for i in range(8)] + [(20, "ka lo"), (21, prose(100, 20)), (22, None), (23, "!!"), (None, prose(5))]
    docs = [(i, prose(i)) for i in range(12)]
    docs += [(30 + i, prose(i, 40) + " " + " ".join(prose(100 + i, 20 + i).upper().split()[2:17]) + "; " + prose(i + 50, 5)) for i in range(6)]
    docs += [(50, prose(103, 23)), (51, prose(103, 23) + "\n" + prose(103, 23)), (52, None), (53, ""), (54, "KA, lo"), (54, "KA, lo"), (None, "ka lo")]
    check(spark, docs, items)


def test_blocks_give_the_same(spark, prose, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_WORDS", 10)
    check(spark, [(1, prose(101, 20) + " " + prose(102, 20)), (2, "x")], [(1, prose(101, 20)), (2, prose(102, 20)), (3, prose(102, 15))])


def test_odd_and_empty(spark, odd_docs):
    got = postings.contamination(postings.build_index(odd_docs), spark.createDataFrame([(1, "one")], "item_id long, text string")).collect()
    assert len(got) == odd_docs.count() and sum(r["contaminated"] for r in got) == 1
    assert postings.contamination(postings.build_index(odd_docs.limit(0)), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a x b c"), (3, "c b a"), (4, "a"), (5, "b c")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    index = postings.build_index(docs)
    assert [tuple(r) for r in postings.phrase_matches(index, tests).collect()] == [(1, "9", 0, 3)]
    assert {r["doc_id"] for r in postings.phrase_matches(index, tests, slop=1).collect()} == {1, 2}
    assert {r["doc_id"] for r in postings.phrase_matches(index, tests, slop=4).collect()} == {1, 2, 3}


def test_words_that_share_a_hash(spark, prose, monkeypatch):
    real = postings.bt.hashes
    monkeypatch.setattr(postings.bt, "hashes", lambda *a: real(*a) % 5)
    from tessella.llm import bytestext as bt

    data, offsets = bt.utf8(__import__("pyarrow").array(["ka lo ka mi", "ru ka"]))
    low, row, first, end = bt.word_spans(data, offsets)
    terms, order, counts = postings._dictionary(low, first, end)
    assert sorted(zip([bytes(terms.spelled[a : a + n]) for a, n in zip(terms.starts, terms.lengths)], counts.tolist())) == [(b"ka", 3), (b"lo", 1), (b"mi", 1), (b"ru", 1)]
    assert terms.find(terms).tolist() == list(range(4))
    index = list(postings.Block([("i", "ka lo mi ru"), ("j", "lo lo")], 2).windows)
    assert index == [2]


def test_long_item_in_pieces(spark, prose, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_WORDS", 7)
    text = prose(101, 60)
    docs = [(i, " ".join(text.split()[i : i + 14]) + " zz") for i in range(0, 50, 7)] + [(90, text)]
    check(spark, docs, [(1, text), (2, prose(4, 13))])


def test_rows_that_stay(spark, prose):
    rows = [(1, prose(1, 30), "a"), (1, prose(2, 30), "b"), (None, prose(1, 30), "c"), (3, None, "d"), (4, "", "e"), (4, "", "e")]
    docs = spark.createDataFrame([(*r, *"wxyz") for r in rows], "doc_id long, text string, k1 string, k2 string, _k1 string, _row string, runs string")
    tests = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    got = postings.without_contaminated(docs, tests)
    assert got.columns == docs.columns
    assert sorted((r["k1"] for r in got.collect())) == ["b", "d", "e", "e"]
    assert postings.without_contaminated(docs.limit(0), tests).count() == 0
    assert postings.without_contaminated(docs, tests.limit(0)).count() == 6
