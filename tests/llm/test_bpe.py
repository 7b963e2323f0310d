import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    return bpe.Codec(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80) | st.text(alphabet="ab 'sé\n\t\x1c 12!", max_size=60))
def test_like_tiktoken(both, text):
    own, ref = both
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["x" * 5000, "ab" * 3000, "é" * 2000, " " * 999 + "q", "the <|endoftext|> end"])
def test_long_pieces(both, text):
    own, ref = both
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ref.encode_ordinary(text)


def test_table(spark, both, odd_docs):
    ref = both[1]
    got = {r["doc_id"]: r for r in bpe.round_trip(odd_docs, PATH, PATTERN).collect()}
    for row in odd_docs.collect():
        raw = (row["text"] or "").encode()
        ids = np.array(ref.encode_ordinary(raw.decode()), "<u4")
        r = got[row["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
    assert bpe.round_trip(odd_docs.limit(0), PATH, PATTERN).count() == 0
    back = bpe.decode(bpe.encode(odd_docs, PATH, PATTERN), PATH, PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())


def test_small_cache(both, monkeypatch, prose):
    monkeypatch.setattr(bpe, "CACHE", 3)
    own = bpe.Codec(both[0].ranks, PATTERN)
    assert np.frombuffer(own.encode(prose(4)), "<u4").tolist() == both[1].encode_ordinary(prose(4))
