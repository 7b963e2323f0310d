"""Toxicity with a linear-chain conditional random field over the words of each sentence.

Documents carry the labels, so the words of the training sample are labelled first: a word is toxic if its whole form or
a stem (a prefix) is far more frequent in toxic than in other documents. The field is then trained on sentences of
those labelled words. Forward-backward marginals of each word add up to the score of the document, and runs of likely
words are its offending spans. Sentences are independent and documents stay where they lie: no shuffle of texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytestext as bt
from tessella.llm.samples import held_out, labelled

#: Labelled documents of each class that the model is fitted on, at most, and the longest text among them.
TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000
THRESHOLD = 0.3
SEGMENT_BYTES = 1 << 20
#: Weights of hashed features, the stems' lengths in bytes (a word is longer than its stem), and the suffixes'.
BUCKETS, PREFIXES, SUFFIXES = 1 << 18, (3, 4, 5, 6, 7, 8, 9), (3,)
#: Least log ratio of document shares, and least toxic documents, for a word or stem to be labelled toxic.
LOG_RATIO, SUPPORT = 3.5, 5

#: Least marginal of a word that counts towards its document's score.
LIKELY = 0.25
_NO_STEM = np.uint64(0)
_ENDS = np.zeros(256, bool)
_ENDS[[10, 13, 33, 46, 63]] = True


@dataclass
class Words:
    """The lower-cased words of a slice of rows: byte spans, row and number of the distinct word; sentence starts."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    code: np.ndarray
    sentences: np.ndarray
    forms: list[np.ndarray]  # hashes of the distinct words: whole, prefixes, suffixes


def read(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = bt.LOWER[data]
    starts, ends = bt.spans(bt.WORD[low], offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    h = bt.hashes(low, starts, ends)
    distinct, at, code = np.unique(h, return_index=True, return_inverse=True)
    s, e = starts[at], ends[at]
    forms = [distinct] + [np.where(e - s > k, bt.hashes(low, s, np.minimum(s + k, e)) ^ np.uint64(k), _NO_STEM) for k in PREFIXES]
    forms += [bt.hashes(low, np.maximum(s, e - k), e) ^ np.uint64(100 + k) for k in SUFFIXES]
    ended = np.cumsum(_ENDS[data], dtype=np.int32)[starts] if len(data) else np.zeros(0, np.int64)
    change = np.ones(len(starts), bool)
    change[1:] = (ended[1:] != ended[:-1]) | (row[1:] != row[:-1])
    return Words(starts, ends, row, code, np.flatnonzero(change), forms)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


@dataclass
class Field:
    """Weights of the features for state 1 (toxic) against 0, transition scores, and the document's calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = -3.0
    turns: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))

    def emissions(self, w: Words) -> np.ndarray:
        return (self.bias + sum(self.weights[f % np.uint64(BUCKETS)] for f in w.forms))[w.code]

    def marginals(self, scores: np.ndarray, sentences: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Probability of state 1 of each word, and if asked of both states of each neighbouring pair (n, 2, 2; zero at sentence starts)."""
        n = len(scores)
        length = np.diff(np.append(sentences, n))
        order = np.argsort(-length, kind="stable")
        first, length = sentences[order], length[order]
        emit = np.stack([_sigmoid(-scores), _sigmoid(scores)], 1)
        turn = np.exp(self.turns)
        ahead, back = np.zeros((n, 2)), np.ones((n, 2))
        longest = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(1, longest + 1), "right")  # sentences longer than t
        for t in range(longest):
            at = first[: active[t]] + t
            x = emit[at] if t == 0 else (ahead[at - 1] @ turn) * emit[at]
            ahead[at] = x / x.sum(1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            at = first[: active[t + 1]] + t
            x = (emit[at + 1] * back[at + 1]) @ turn.T
            back[at] = x / x.sum(1, keepdims=True)
        single = ahead[:, 1] * back[:, 1]
        single /= single + ahead[:, 0] * back[:, 0]
        if not both:
            return single, None
        pairs = np.zeros((n, 2, 2))
        if n > 1:
            x = ahead[:-1, :, None] * turn * (emit[1:] * back[1:])[:, None, :]
            pairs[1:] = x / x.sum((1, 2), keepdims=True)
        pairs[sentences] = 0
        return single, pairs

    def word_marginals(self, w: Words) -> np.ndarray:
        return self.marginals(self.emissions(w), w.sentences, False)[0] if len(w.code) else np.zeros(0)

    def score(self, p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents from the marginals of their words; without words, the score of no evidence."""
        return _sigmoid(_evidence(p, row, n) @ self.document)


def _evidence(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Intercept; log odds of the likeliest word; number of likely words, by their marginals; their share of all words."""
    top, likely = np.full(n, 1e-3), np.where(p >= LIKELY, p, 0.0)
    np.maximum.at(top, row, p)
    top = np.minimum(top, 1 - 1e-3)
    count = np.bincount(row, likely, n)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(count), np.log1p(200 * count / np.maximum(np.bincount(row, minlength=n), 1))], 1)


def label_words(w: Words, y: np.ndarray) -> np.ndarray:
    """0 or 1 for each word of documents with labels y: toxic by its whole form or a stem of at least four bytes."""
    toxic = max(1, int(y.sum()))
    clean = max(1, len(y) - toxic)
    marked = np.zeros(len(w.code), bool)
    for k, form in enumerate(w.forms[: 1 + len(PREFIXES)]):
        if k and PREFIXES[k - 1] < 4:
            continue
        _, number = np.unique(form, return_inverse=True)
        number = number[w.code]
        word, row = np.divmod(np.unique(number * len(y) + w.row), len(y))
        inside = np.bincount(word, y[row], number.max() + 1)
        outside = np.bincount(word, 1 - y[row], number.max() + 1)
        ratio = np.log((inside + 0.5) / toxic) - np.log((outside + 0.5) / clean)
        marked |= ((ratio >= LOG_RATIO) & (inside >= SUPPORT))[number] & (form[w.code] != _NO_STEM)
    return (marked & (y[w.row] == 1)).astype(int)


def fit(texts: list[str], y: np.ndarray, rounds: int = 50, penalty: float = 1e-4, seed: int = 0) -> Field:
    """Adaptive gradient ascent of the penalised log likelihood; without toxic or without clean rows, a constant score."""
    model = Field()
    y = np.asarray(y, int)
    data, offsets = bt.utf8(pa.array(list(texts), pa.large_string()))
    w = read(data, offsets)
    if not len(w.code) or not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        model.document = np.array([math.log(share / (1 - share)), 0.0, 0.0, 0.0])
        return model
    label = label_words(w, y)
    # All sentences with a toxic word, and some others.
    n = len(w.code)
    sentence = np.searchsorted(w.sentences, np.arange(n), "right") - 1
    hot = np.bincount(sentence, label, len(w.sentences)) > 0
    keep = hot | (np.random.default_rng(seed).random(len(w.sentences)) < max(0.02, min(1.0, 4 * hot.sum() / len(hot))))
    inside = keep[sentence]
    code, target = w.code[inside], label[inside]
    starts = np.flatnonzero(np.diff(sentence[inside], prepend=-1))
    used, code = np.unique(code, return_inverse=True)
    features = np.stack([f[used] % np.uint64(BUCKETS) for f in w.forms], 1).astype(np.int64)
    seen = np.zeros((2, 2))
    follow = np.ones(len(code), bool)
    follow[starts] = False
    np.add.at(seen, (target[np.flatnonzero(follow) - 1], target[follow]), 1)
    sums = [np.full(BUCKETS, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(rounds):
        score = (model.bias + model.weights[features].sum(1))[code]
        p, pairs = model.marginals(score, starts)
        error = np.bincount(code, target - p, len(features))
        steps = [np.bincount(features.ravel(), np.repeat(error, features.shape[1]), BUCKETS) - penalty * len(code) * model.weights, error.sum(), seen - pairs.sum(0)]
        for i, g in enumerate(steps):
            sums[i] = sums[i] + g * g
        model.weights += 0.5 * steps[0] / np.sqrt(sums[0])
        model.bias += 0.5 * steps[1] / math.sqrt(sums[1])
        model.turns += 0.2 * steps[2] / np.sqrt(sums[2])
    x = _evidence(model.word_marginals(w), w.row, len(y))
    model.document = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; slopes stay positive, so more toxic words never lower a score."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ b)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(b)) * 0.05
        b = b + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.05 * b), -2, 2)
    if (b[1:] < 0).any():
        keep = np.concatenate([[True], b[1:] >= 0])
        b = np.where(keep, 0.0, 0.0)
        if keep.sum() > 1:
            b[keep] = _logistic(x[:, keep], y)
        else:
            b[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> Field:
    """A field fitted on at most `most` labelled documents of each class that are not held out."""
    rows = labelled(docs, labels, label, most, most_chars).orderBy("doc_id", "text").collect()  # bounded by most and most_chars
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows]))


def _spans(w: Words, p: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: float) -> list[list[dict]]:
    """Character offsets of the runs of words that are likely toxic, by row."""
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    hot = np.flatnonzero(p >= least)
    if not len(hot):
        return out
    chars = np.cumsum((data & 0xC0) != 0x80)
    new = np.ones(len(hot), bool)
    new[1:] = (np.diff(hot) > 1) | (w.row[hot[1:]] != w.row[hot[:-1]]) | np.isin(hot[1:], w.sentences)
    last = np.append(np.flatnonzero(new)[1:], len(hot)) - 1
    before = np.concatenate([[0], chars])
    for a, b in zip(hot[new].tolist(), hot[last].tolist()):
        r = int(w.row[a])
        base = before[offsets[r]]
        out[r].append({"start": int(before[w.starts[a]] - base), "end": int(before[w.ends[b]] - base), "marginal": float(p[a : b + 1].max())})
    return out


def tag(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, score and spans (array of start, end in characters, and marginal) of every row.

    Null and empty texts have no spans and the score of no evidence; repeated rows are scored alike.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by BUCKETS
    kind = "doc_id long, score double, spans array<struct<start: int, end: int, marginal: double>>"
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offsets = bt.utf8(batch.column(1))
            for a, b in bt.slices(offsets, SEGMENT_BYTES):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                w = read(part, off)
                p = model.word_marginals(w)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(p, w.row, b - a)), pa.array(_spans(w, p, part, off, least), arrow)], names=["doc_id", "score", "spans"])
            bt.trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tagged, kind)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sample) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row of docs, by a field trained on labels (doc_id, toxic)."""
    rows = tag(docs, train(docs, labels, **sample))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, model: Field, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offsets = bt.utf8(batch.column(at))
            for a, b in bt.slices(offsets, SEGMENT_BYTES):
                w = read(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                score = model.score(model.word_marginals(w), w.row, b - a)
                yield batch.slice(a, b - a).filter(pa.array(score < threshold))
            bt.trim()

    return docs.mapInArrow(clean, docs.schema)
