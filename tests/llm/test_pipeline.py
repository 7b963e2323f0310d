import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from test_postings import brute as contaminated_brute
from test_simhash import classes, fingerprint

from tessella.llm import bpe, crf


def gone(texts, length=200):
    raws, count = [t.encode() for t in texts], {}
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    for r in raws:
        dead = {j for i in range(len(r) - length + 1) if count[r[i : i + length]] > 1 for j in range(i, i + length)}
        yield bytes(c for i, c in enumerate(r) if i not in dead).decode("utf-8", "ignore")


def test_against_brute_force(spark, prose, tmp_path):
    rows, labels = [], []
    shared = prose(999, 60)
    for i in range(160):
        text, toxic = prose(i, 45) + ".", i % 5 == 0
        if toxic:
            text += " you vilestka badword and badword."
        elif i % 5 == 1:
            text = prose(i, 10) + " " + shared + " " + prose(i + 500, 10)
        elif i % 20 == 2:
            text += " " + prose(700, 15)
        elif i % 20 == 3:
            text = rows[i - 1][1] if i % 40 == 3 else None
        rows.append((i, text, "en", "s", len(text or "")))
        labels.append((i, 1, int(toxic)))
    items = [(1, prose(700, 15)), (2, prose(701, 20))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs, known = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    bad = {r["doc_id"] for r in crf.toxicity(docs, known).where("predicted = 1").collect()}
    assert len(bad ^ {i for i, _, t in labels if t}) <= 2
    left = [(i, t or "") for i, t, *_ in rows if i not in bad]
    group = classes([fingerprint(t) for _, t in left])
    left = [x for k, x in enumerate(left) if group[k] == k]
    left = list(zip([i for i, _ in left], gone([t for _, t in left])))
    left = [(i, t) for i, t in left if not contaminated_brute(t, items)[4]]
    assert sorted(got) == [i for i, _ in left] and len(left) < 130
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in left:
        r = got[i]
        assert (r["text"] or "") == t and r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert np.array(r["ids"]).tolist() == ref.encode_ordinary(t)
        assert not t or r["n_chars"] == len(t)
        assert not re.search("badword", t)


def test_odd_tables(spark, prose, odd_docs, tmp_path):
    from pyspark.sql import functions as F

    names = "_row _kept _k1 k1 K2 cell id order runs hits score ids".split()
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *[F.lit(f"own {n}").alias(n) for n in names])
    spark.createDataFrame([(1, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(3000, 20)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns and out.schema["text"] == now.schema["text"]
        assert all(r[n] == f"own {n}" for r in out.collect() for n in names), name
        empty = stage(spark, now.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == docs.columns
        now = out
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # The two equal rows are one, and the null, the empty and the blank text are copies of each other.
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in got)) == [(False, i) for i in (1, 2, 5, 6, 7)] + [(True, 0)]
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    last = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame([], kinds), str(tmp_path))
    assert last.count() == 0 and last.columns[-3:] == ["ids", "n_tokens", "round_trip"]
