"""Quality with a sparse rule ensemble: paths of small boosted trees become conjunctive rules over text statistics, a
lasso logistic regression keeps a few of them with weights, and the rules run as Spark column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytestext as bt
from tessella.llm.samples import held_out, labelled

#: Labelled documents of each class that the rules are fitted on, at most.
TRAIN_DOCS = 10_000
THRESHOLD = 0.7
SEGMENT_BYTES = 1 << 20
TREES, DEPTH, BINS = 60, 3, 48

STATISTICS = (
    "n_words", "word_bytes", "upper", "digits", "exclaim", "bars", "symbols", "stops", "commas", "wide", "odd_end",
    "shout", "same_next", "distinct", "top_word", "short", "long", "line_words", "same_line", "capital", "singles",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_LOWER = _class(bytes(range(97, 123)))
_SYMBOL, _STOP = _class(b"#$%&*+/<=>@\\^_`{}~[]"), _class(b".!?")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by STATISTICS; texts without words have zero throughout."""
    n = len(offsets) - 1
    starts, ends = bt.spans(~bt.SPACE[data], offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(row, minlength=n).astype(float)
    each = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), np.diff(offsets))

    def per_byte(mask):
        return np.bincount(owner[mask], minlength=n)

    def per_word(mask):
        return np.bincount(row[mask], minlength=n) / each

    bytes_ = np.maximum(np.bincount(row, ends - starts, n), 1)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask[data])])
    upper, letter, lower = count(_UPPER), count(_LETTER), count(_LOWER)
    uppers, letters, lowers = (c[ends] - c[starts] for c in (upper, letter, lower))
    h = bt.hashes(bt.LOWER[data], starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    first = np.flatnonzero(fresh)
    times = np.diff(np.append(first, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, row[order][first], times)
    ls, le = bt.spans(data != 10, offsets)
    lrow, lh = np.searchsorted(offsets, ls, "right") - 1, bt.hashes(data, ls, le)
    lorder = np.lexsort((lh, lrow))
    again = np.zeros(len(lh), bool)
    again[1:] = (lh[lorder][1:] == lh[lorder][:-1]) & (lrow[lorder][1:] == lrow[lorder][:-1])
    lines = np.bincount(lrow, minlength=n)
    last = data[ends - 1]
    size = ends - starts
    columns = [
        words, bytes_ / each, per_byte(_UPPER[data]) / bytes_, per_byte(_DIGIT[data]) / bytes_, per_byte(data == 33) / each,
        per_byte(data == 124) / each, per_byte(_SYMBOL[data]) / each, per_byte(_STOP[data]) / each, per_byte(data == 44) / each,
        per_byte(data >= 128) / bytes_, per_word(~_LETTER[last] & ~_STOP[last] & (last != 44) & ~_DIGIT[last]),
        per_word((uppers > 1) & (lowers == 0)), per_word(same), np.bincount(row[order][first], minlength=n) / each, top / each,
        per_word(size <= 2), per_word(size >= 14), words / np.maximum(lines, 1), np.bincount(lrow[lorder][again], minlength=n) / np.maximum(lines, 1),
        per_word(_UPPER[data[starts]] & (lowers > 0)), np.bincount(row[order][first], times == 1, n) / each,
    ]
    out = np.stack(columns, 1)
    out[words == 0] = 0
    return out


def with_statistics(docs: DataFrame, keep: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the long columns named in keep, and the statistics as double columns of every row."""
    names = ["doc_id", *keep.split()]
    schema = ", ".join([f"{x} long" for x in names] + [f"{x} double" for x in STATISTICS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bt.utf8(batch.column(len(names)))
            for a, b in bt.slices(offsets, SEGMENT_BYTES):
                x = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(names))] + [pa.array(c) for c in x.T], names=[*names, *STATISTICS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(x).cast("long").alias(x) for x in keep.split()], F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(measure, schema)


#: A condition: statistic, whether it must be above (else at most) the bound, the bound.
Condition = tuple[int, bool, float]


def _tree(codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, rows: np.ndarray, path: tuple, paths: list, least: int) -> np.ndarray:
    """Fits one tree; adds the conditions of each node but the root to paths; returns the steps of rows."""
    total_g, total_h = grad[rows].sum(), hess[rows].sum()
    if path:
        paths.append(path)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for j in range(codes.shape[1]):
            if not len(cuts[j]):
                continue
            g = np.cumsum(np.bincount(codes[rows, j], grad[rows], len(cuts[j]) + 1))[:-1]
            h = np.cumsum(np.bincount(codes[rows, j], hess[rows], len(cuts[j]) + 1))[:-1]
            c = np.cumsum(np.bincount(codes[rows, j], minlength=len(cuts[j]) + 1))[:-1]
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            gain[(c < least) | (len(rows) - c < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        return np.full(len(rows), total_g / (total_h + 1))
    j, k = best[1]
    above = codes[rows, j] > k
    out = np.zeros(len(rows))
    for side in (False, True):
        out[above == side] = _tree(codes, cuts, grad, hess, depth - 1, rows[above == side], (*path, (j, side, float(cuts[j][k]))), paths, least)
    return out


def _shorten(path: tuple) -> tuple:
    """The tightest bound of each statistic and side."""
    bounds: dict[tuple[int, bool], float] = {}
    for j, above, cut in path:
        old = bounds.get((j, above), cut)
        bounds[j, above] = max(old, cut) if above else min(old, cut)
    return tuple(sorted((j, above, cut) for (j, above), cut in bounds.items()))


def holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, j] > cut) if above else (x[:, j] <= cut) for j, above, cut in rule])


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple, float]]
    names: tuple[str, ...] = STATISTICS

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((w * holds(x, r) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as a column expression over the statistics."""

        def fires(rule):
            return reduce(lambda a, b: a & b, [F.col(self.names[j]) > cut if above else F.col(self.names[j]) <= cut for j, above, cut in rule])

        z = reduce(lambda a, b: a + b, [F.when(fires(r), float(w)).otherwise(0.0) for r, w in self.rules], F.lit(float(self.intercept)))
        return 1 / (1 + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = 1e-3, rounds: int = 400) -> RuleModel:
    """Boosted trees, their paths as rules, then lasso logistic weights by accelerated proximal steps."""
    y = np.asarray(y, float)
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    base = math.log(share / (1 - share))
    if n < 20 or not 0 < y.sum() < n:
        return RuleModel(base, [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    score, paths = np.full(n, base), []
    least = max(5, n // 1000)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        score += 0.3 * _tree(codes, cuts, y - p, p * (1 - p), depth, np.arange(n), (), paths, least)
    rules = sorted({_shorten(p) for p in paths})
    m = np.stack([holds(x, r) for r in rules], 1).astype(np.float32)
    scale = m.std(0)
    rules = [r for r, s in zip(rules, scale) if s > 0]
    m = m[:, scale > 0]
    scale = scale[scale > 0]
    mean = m.mean(0)
    z = (m - mean) / scale
    w, v, t, b = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32), 1.0, base
    probe = np.random.default_rng(0).standard_normal(z.shape[1]).astype(np.float32)
    for _ in range(20):  # largest curvature
        probe = z.T @ (z @ (probe / np.linalg.norm(probe))) / n
    step = np.float32(4 / np.linalg.norm(probe))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(b + z @ v)))
        g = z.T @ (p - y).astype(np.float32) / n
        b -= float((p - y).mean()) * 2
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    weights = w[kept] / scale[kept]
    return RuleModel(float(b - (weights * mean[kept]).sum()), [(rules[i], float(c)) for i, c in zip(kept, weights)])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS) -> RuleModel:
    """Rules fitted on at most `most` labelled documents of each class that are not held out; whole texts are measured."""
    rows = with_statistics(labelled(docs, labels, label, most), "y").toPandas()  # bounded: 2 * most rows of numbers
    rows = rows.sort_values(["doc_id", *STATISTICS])
    return fit(rows[list(STATISTICS)].to_numpy(), rows["y"].to_numpy())


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sample) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, by rules trained on labels (doc_id, quality).

    Null and empty texts have zero statistics and the score the rules give those; repeated rows score alike.
    """
    model = train(docs, labels, **sample)
    rows = with_statistics(docs).select("doc_id", model.column().alias("score"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
