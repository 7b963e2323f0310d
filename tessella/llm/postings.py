"""Benchmark decontamination with a positional inverted index that is partitioned by document.

Each index segment holds whole documents: a sorted term dictionary with posting lists of token positions. Segments are
built where the rows lie (no shuffle of tokens), stored as a table in the shared folder, and searched in place: for each
test window the posting list of its rarest term gives candidate starts, which are intersected with the offset-adjusted
lists of the other terms, rarest first. A very frequent phrase or a hot source only makes more segments, never a larger task.

Terms are sorted by a hash of the word, and compared by their bytes. The test set is searched for in blocks of at most
BLOCK_WORDS words, one after the other: executors hold one block (about 40 MB at most), however large the test set is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytestext as bt
from tessella.llm.store import fresh, written

WINDOW = 13
#: Bytes of text in a segment; a longer document is a segment of its own.
SEGMENT_BYTES = 2 << 20
#: Words of the test set that are searched for at once; a larger set is taken in blocks, and so is a larger item.
BLOCK_WORDS = 500_000
#: Candidate starts that are intersected at once.
CANDIDATES = 2_000_000

INDEX = "segment long, doc_ids binary, known binary, doc_starts binary, terms binary, spelled binary, ends binary, counts binary, positions binary"


class Terms:
    """Distinct words in the order of their hashes (words that share a hash in the order of their bytes)."""

    def __init__(self, h: np.ndarray, spelled: np.ndarray, ends: np.ndarray):
        self.h, self.spelled = h, spelled
        self.lengths = np.diff(ends, prepend=0).astype(np.int64)
        self.starts = ends - self.lengths

    def find(self, other: Terms) -> np.ndarray:
        """The number of each word of other here; -1 where it is none of these."""
        out, at = np.full(len(other.h), -1), np.searchsorted(self.h, other.h)
        todo = np.arange(len(other.h))
        while len(todo := todo[at[todo] < len(self.h)]):
            todo = todo[self.h[at[todo]] == other.h[todo]]
            same = self.lengths[at[todo]] == other.lengths[todo]
            same[same] = bt.same(self.spelled, self.starts[at[todo[same]]], other.spelled, other.starts[todo[same]], other.lengths[todo[same]])
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
        return out


def _dictionary(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Terms, np.ndarray, np.ndarray]:
    """The distinct words, all words in their order, and how many of them are each."""
    h, lengths = bt.hashes(low, starts, ends), ends - starts
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]]) if len(h) else np.zeros(0, bool)
    known = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else order
    rest = order != known
    alike = lengths[order[rest]] == lengths[known[rest]]
    if not (alike.all() and bt.same(low, starts[order[rest]], low, starts[known[rest]], lengths[order[rest]]).all()):
        spelt = [bytes(low[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]  # two words share a hash
        order = np.array(sorted(range(len(h)), key=lambda i: (int(h[i]), spelt[i], i)))
        new = np.array([True, *(spelt[a] != spelt[b] for a, b in zip(order[1:], order[:-1]))])
    first = np.flatnonzero(new)
    each = order[first]
    take = bt.spelled(low, starts[each], lengths[each])
    return Terms(h[each], take, np.cumsum(lengths[each])), order, np.diff(np.append(first, len(h)))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        *id_columns, texts = batch.columns
        data, offsets = bt.utf8(texts)
        ids = np.stack([np.asarray(c.fill_null(0).cast(pa.int64())) for c in id_columns], 1)
        known = np.asarray(id_columns[0].is_valid())
        for a, b in bt.slices(offsets, SEGMENT_BYTES):
            low, row, first, end = bt.word_spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            # One position stays free between documents, so that no phrase crosses them.
            starts = np.searchsorted(row, np.arange(b - a + 1)) + np.arange(b - a + 1)
            position = np.arange(len(row)) + row
            terms, order, counts = _dictionary(low, first, end)
            steps = np.diff(position[order], prepend=0).astype(np.int32)
            cells = [ids[a:b], known[a:b], starts.astype(np.int64), terms.h, terms.spelled, (terms.starts + terms.lengths).astype(np.int64), counts.astype(np.int32), steps]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=[x.split()[0] for x in INDEX.split(", ")])
            number += 1
        bt.trim()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """The stored index of all rows: one row a segment. Null text has no words; repeated rows stay separate documents.

    more: further long columns that tell documents apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *more, F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(_segments, INDEX), "postings")


class Segment:
    """One row of the index, unpacked; postings are keys term number << 32 | position, in order."""

    def __init__(self, row: dict):
        self.number = row["segment"]
        self.starts = np.frombuffer(row["doc_starts"], np.int64)
        self.terms = Terms(np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["spelled"], np.uint8), np.frombuffer(row["ends"], np.int64))
        self.counts = np.frombuffer(row["counts"], np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        position = np.cumsum(np.frombuffer(row["positions"], np.int32), dtype=np.int64)
        self.postings = np.repeat(np.arange(len(self.counts)), self.counts) << 32 | position

    def documents(self, start: np.ndarray) -> np.ndarray:
        """Which document each position lies in."""
        return np.searchsorted(self.starts, start, "right") - 1

    def match(self, windows: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rows of windows (term numbers, all of one length) and positions where they start.

        slop 0: exact phrases. Otherwise proximity: anchored at the rarest term, every other term lies within slop
        positions of its place, in the same document.
        """
        empty = np.zeros(0, np.int64)
        if not len(windows):
            return empty, empty
        order = np.argsort(self.counts[windows], axis=1, kind="stable")
        rarest = windows[np.arange(len(windows)), order[:, 0]]
        load = np.cumsum(self.counts[rarest])
        found, at = [], 0
        while at < len(windows):
            to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + CANDIDATES, "right")))
            n = self.counts[rarest[at:to]]
            which = np.repeat(np.arange(at, to), n)
            within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            start = (self.postings[self.first[rarest[which]] + within] & 0xFFFFFFFF) - order[which, 0]
            if not slop:
                which, start = which[start >= 0], start[start >= 0]
            for k in range(1, windows.shape[1]):
                if not len(which):
                    break
                place = start + order[which, k]
                term = windows[which, order[which, k]] << 32
                low = high = place
                if slop:
                    doc = np.searchsorted(self.starts, start + order[which, 0], "right") - 1
                    low, high = np.maximum(place - slop, self.starts[doc]), np.minimum(place + slop, self.starts[doc + 1] - 1)
                i = np.minimum(np.searchsorted(self.postings, term | low), len(self.postings) - 1)
                ok = (self.postings[i] >= (term | low)) & (self.postings[i] <= (term | high)) & (low <= high)
                which, start = which[ok], start[ok]
            found.append((which, start))
            at = to
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


class Block:
    """Part of the test set: windows of words by length, and the item of each."""

    def __init__(self, items: list[tuple[str, pa.Array]], window: int):
        self.names = [name for name, _ in items]
        data, offsets = bt.utf8(pa.array([t for _, t in items], pa.large_string()))
        low, row, first, end = bt.word_spans(data, offsets)
        self.terms, order, counts = _dictionary(low, first, end)
        code = np.empty(len(row), np.int32)
        code[order] = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        by: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, (a, b) in enumerate(zip(np.searchsorted(row, np.arange(len(items))), np.searchsorted(row, np.arange(len(items)), "right"))):
            if a < b:
                n = min(window, int(b - a))
                by.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(code[a:b], n), i))
        self.windows = {n: (np.concatenate([w for w, _ in x]), np.concatenate([np.full(len(w), i) for w, i in x])) for n, x in by.items()}

    def search(self, segment: Segment, slop: int = 0) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, item, start) of all matches."""
        number, out = segment.terms.find(self.terms), []
        for n, (windows, item) in self.windows.items():
            terms = number[windows]
            whole = np.flatnonzero((terms >= 0).all(axis=1))
            which, start = segment.match(terms[whole], slop)
            out.append((n, item[whole[which]], start))
        return out


def blocks(tests: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Iterator[Block]:
    """The test set in blocks of BLOCK_WORDS words; items without an id or without words have no windows.

    A longer item is cut into pieces that overlap in all but one word of a window.
    """
    held, size = [], 0
    for name, text in tests.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).na.drop().toLocalIterator():
        data, offsets = bt.utf8(pa.array([text]))
        _, _, first, end = bt.word_spans(data, offsets)
        for a in range(0, max(1, len(first) - window + 1), BLOCK_WORDS):
            last = min(a + BLOCK_WORDS + window - 1, len(first))
            piece = bytes(data[first[a] : end[last - 1]]).decode() if len(first) else ""
            held.append((name, piece))
            size += last - a
            if size >= BLOCK_WORDS:
                yield Block(held, window)
                held, size = [], 0
    yield Block(held, window)


def _by_block(index: DataFrame, tests: DataFrame, window: int, find, schema: str) -> list[DataFrame]:
    """What find(segment, block) gives for each block of the tests; no executor holds two blocks."""
    out, context = [], index.sparkSession.sparkContext
    for block in blocks(tests, window=window):
        sent = context.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from find(Segment(batch.slice(i, 1).to_pylist()[0]), sent.value)
                    bt.trim()

        out.append(written(index.mapInArrow(run, schema), "matches"))
        sent.destroy()
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _facts(index: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """segment, nth, doc_id, the columns of more, and n_words of every document of the index."""
    names = ["segment", "nth", "doc_id", *more, "n_words"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                starts, known = np.frombuffer(row["doc_starts"], np.int64), np.frombuffer(row["known"], bool)
                n = len(known)
                first, *rest = np.frombuffer(row["doc_ids"], np.int64).reshape(n, -1).T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["segment"])), pa.array(np.arange(n)), pa.array(first, mask=~known), *map(pa.array, rest), pa.array(np.diff(starts) - 1)], names=names)

    return index.select("segment", "doc_ids", "known", "doc_starts").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def phrase_matches(index: DataFrame, tests: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Every match: doc_id, item_id, first_word and n_words of the place in the document."""
    names = ["segment", "nth", "item_id", "first_word", "words"]

    def find(s: Segment, block: Block):
        for n, item, start in block.search(s, slop):
            doc = s.documents(np.maximum(start, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), s.number)), pa.array(doc), pa.array([block.names[i] for i in item], pa.string()), pa.array(start - s.starts[doc]), pa.array(np.full(len(doc), n))], names=names)

    found = _union(_by_block(index, tests, window, find, "segment long, nth long, item_id string, first_word long, words long"))
    return found.join(_facts(index), ["segment", "nth"]).select("doc_id", "item_id", "first_word", F.col("words").alias("n_words"))


def _runs(s: Segment, block: Block) -> Iterator[pa.RecordBatch]:
    """segment, nth, runs (first and end words that matches cover) and items of each document with matches."""
    marks = np.zeros(int(s.starts[-1]) + 1, np.int64)
    pairs = []
    for length, item, start in block.search(s):
        np.add.at(marks, start, 1)
        np.add.at(marks, start + length, -1)
        pairs.append(np.unique(np.stack([s.documents(start), item], 1), axis=0))
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    if not len(pairs):
        return
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(marks) > 0).view(np.int8), [0]])))
    first, end = edge[::2], edge[1::2]
    doc, begin = np.unique(pairs[:, 0], return_index=True)
    a, b = np.searchsorted(first, s.starts[doc]), np.searchsorted(first, s.starts[doc + 1])
    runs = [(np.stack([first[i:j], end[i:j]], 1) - s.starts[d]).astype("<i8").tobytes() for d, i, j in zip(doc, a, b)]
    items = [[block.names[i] for i in part] for part in np.split(pairs[:, 1], begin[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), s.number)), pa.array(doc), pa.array(runs, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["segment", "nth", "runs", "items"])


def contamination(index: DataFrame, tests: DataFrame, window: int = WINDOW, more: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit (words inside any matched window), n_items, items_sha256, contaminated.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null or empty texts have no words and are never contaminated;
    repeated rows are judged one by one; an empty table gives an empty result. Columns of more come along.
    """
    found = _union(_by_block(index, tests, window, _runs, "segment long, nth long, runs binary, items array<string>"))
    found = found.groupBy("segment", "nth").agg(F.collect_list("runs").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def judge(batches):
        for batch in batches:
            *ids, n_words, runs, items = batch.columns
            hit = []
            for parts in runs.to_pylist():
                spans = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in parts]) if parts else np.zeros((0, 2), np.int64)
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                reach = np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]
                before = np.concatenate([[0], reach[:-1]]) if len(spans) else reach
                hit.append(int(np.maximum(spans[:, 1] - np.maximum(spans[:, 0], before), 0).sum()))
            names = [x or [] for x in items.to_pylist()]
            hit, n = np.array(hit, np.int64), np.asarray(n_words)
            shas = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else NOTHING for x in names]
            yield pa.RecordBatch.from_arrays([*ids, n_words, pa.array(hit), pa.array([len(x) for x in names], pa.int64()), pa.array(shas, pa.string()), pa.array((hit > 0) & (20 * hit >= n))], names=["doc_id", *more, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    joined = _facts(index, more).join(found, ["segment", "nth"], "left").select("doc_id", *more, "n_words", "runs", "items")
    return joined.mapInArrow(judge, ", ".join(f"{c} long" for c in ("doc_id", *more, "n_words", "n_hit", "n_items")) + ", items_sha256 string, contaminated boolean")


#: Digest of no items.
NOTHING = hashlib.sha256(b"").hexdigest()


def without_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated.

    Null and empty texts stay; repeated rows stay or go together; rows are told apart by two hashes of their text, as
    nothing else decides; extra columns pass through whatever their names; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = fresh(docs.columns, "k1"), fresh(docs.columns, "k2")
    keys = {k1: F.xxhash64(F.lit(4), text), k2: F.xxhash64(text, F.lit(6))}
    index = build_index(docs.select(keys[k1].alias("k1"), keys[k2].alias("k2"), F.col(text_col).alias("text")), "k1", more=("k2",))
    bad = contamination(index, tests, window, more=("k2",)).where("contaminated").select(F.col("doc_id").alias(k1), F.col("k2").alias(k2)).distinct()
    return docs.withColumns(keys).join(bad, [k1, k2], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
