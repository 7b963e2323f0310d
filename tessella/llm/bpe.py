"""Byte-level BPE encoding and decoding.

Each pre-token is merged with a segment tree over its byte positions: a leaf holds the rank of the pair that starts
there, inner nodes the leftmost minimum, so the next merge is at the root and each merge costs three point updates.
Pre-tokens met before come from a bounded cache. Rows are independent: no shuffle, and a hot source is only more rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens that a worker remembers, twice over; longer ones than CACHED_CHARS are never kept.
CACHE, CACHED_CHARS = 200_000, 64
#: Pre-tokens that are taken from a text at once.
PIECES = 200_000
_NONE, _PLACE = 1 << 62, (1 << 34) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the leftmost pair of the lowest rank is merged next."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    width = 1 << max(0, n - 2).bit_length()
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[width + i] = r << 34 | i
    for at in range(width - 1, 0, -1):
        left, right = tree[2 * at], tree[2 * at + 1]
        tree[at] = left if left <= right else right
    # A live part that starts at i is piece[i:after[i]].
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while (low := tree[1]) != _NONE:
        i = low & _PLACE
        j = after[i]
        k = after[i] = after[j]
        before[k] = i
        r = get(piece[i : after[k]]) if k < n else None
        changes = [(j, _NONE), (i, _NONE if r is None else r << 34 | i)]
        if (h := before[i]) >= 0:
            r = get(piece[h:k])
            changes.append((h, _NONE if r is None else r << 34 | h))
        for at, value in changes:
            at += width
            if at >= 2 * width:  # the last byte starts no pair
                continue
            while tree[at] != value:
                tree[at] = value
                if (at := at >> 1) == 0:
                    break
                left, right = tree[2 * at], tree[2 * at + 1]
                value = left if left <= right else right
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoder and decoder of whole texts, with the worker's cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _miss(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, found = [], (m[0] for m in self.split.finditer(text)) if len(text) > 1 << 20 else iter(self.split.findall(text))
        while pieces := list(islice(found, PIECES)):
            known = self.new.get
            out.append(b"".join([known(p) or self._miss(p) for p in pieces]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        token = self.tokens.__getitem__
        return b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))


def _codec(sent) -> Codec:
    """One codec a worker process and vocabulary."""
    ranks, pattern, name = sent.value
    if _codec.__dict__.get("name") != name:
        _codec.name, _codec.codec = name, Codec(ranks, pattern)
    return _codec.codec


def _send(spark: SparkSession, path: str, pattern: str):
    return spark.sparkContext.broadcast((load_ranks(path), pattern, (path, pattern)))  # bounded by the vocabulary


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the column out (array<int>) of ids; null text counts as empty."""
    sent = _send(docs.sparkSession, path, pattern)

    @F.pandas_udf("array<int>")
    def ids(texts):
        codec = _codec(sent)
        return texts.map(lambda t: np.frombuffer(codec.encode(t), "<i4"))

    return docs.withColumn(out, ids(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the column out (binary) of the bytes that ids stand for; null ids give no bytes."""
    sent = _send(docs.sparkSession, path, pattern)

    @F.pandas_udf("binary")
    def back(column):
        codec = _codec(sent)
        return column.map(lambda ids: codec.decode(np.asarray(ids, "<u4").tobytes()) if ids is not None else b"")

    return docs.withColumn(out, back(F.col(ids_col)))


def tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ids (array<int>), n_tokens, and round_trip: whether the ids decode to the text's bytes again.

    Null text counts as empty. Columns of docs with these names are replaced.
    """
    sent = _send(docs.sparkSession, path, pattern)
    docs = docs.drop("ids", "n_tokens", "round_trip")
    names = docs.columns
    at = names.index(text_col)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t or "" for t in part.column(at).to_pylist()]
                coded = [codec.encode(t) for t in texts]
                same = [codec.decode(c) == t.encode() for c, t in zip(coded, texts)]
                n = np.array([len(c) // 4 for c in coded], np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(n.astype(np.int64)), pa.array(same)], names=[*names, "ids", "n_tokens", "round_trip"])

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(code, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids are never held for more than one text at once.

    Null and empty texts have no tokens; repeated rows give repeated rows; an empty table gives none.
    """
    sent = _send(docs.sparkSession, path, pattern)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
