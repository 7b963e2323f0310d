"""Removal of long repeated byte strings, found by sorted suffixes of the whole collection.

The collection is cut without loss into short texts, so that column-wise construction (columnbwt) stays cheap and
distributed. Of the hashes of all q-byte grams inside a window of `length` bytes the least one is the window's anchor;
equal windows have equal anchors. Maximal runs of windows with one anchor are the texts. Anchors that occur once cannot
hold a repeat and drop out by a count; the texts of each other anchor meet in one task, which builds their transform and
common prefixes: a window is repeated where a sorted neighbour shares all its bytes.

Skew: equal documents and equal cuttings are one text with a weight, combined before they are sent; in the transform one
suffix stands for its copies, which would be its neighbours with all symbols in common. An anchor with more than
HOT texts (a passage that many documents share) is split by the place of the anchor in the window and by the bytes that
all windows of a piece share, which no pair of equal windows can differ in. Pieces at the edge of a passage share those
bytes and differ in the rest; where more than HOT meet, they are split further into single windows, by all their bytes.
So no more than HOT texts of one anchor meet: 2 MB at the default length, transform included 50 MB.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytestext as bt
from tessella.llm import columnbwt
from tessella.llm.store import Scratch, fresh, release, written

LENGTH = 200
SEGMENT_BYTES = 1 << 20
#: Windows whose anchors are searched at once; with a window's grams they must fit the 20 bits of a place.
CHUNK = 1 << 17
#: Texts of one anchor beyond which it is split, and windows of a piece then.
HOT, PIECE = 2000, 32
#: Tasks that look up one window of a hot anchor.
SALTS = 16
#: Bytes of texts whose transform is built at once; more only if one anchor has more, which HOT bounds.
BUILD_BYTES = 64_000
BUCKET_BYTES = 16 << 20

_PLACE = np.uint64((1 << 20) - 1)


def shape(length: int) -> tuple[int, int, int]:
    """Bytes of a gram, grams in a window, and bytes of a symbol for windows of `length` bytes."""
    if length < 16:
        raise ValueError("windows have 16 bytes at least")
    gram = 8 * max(1, min(6, length // 32))
    return gram, length - gram + 1, max(w for w in range(1, 9) if length % w == 0)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows within rows: first window, number of windows (up to twice a window's grams), anchor hash, number of anchor places."""
    gram, grams, _ = shape(length)
    n, found = len(data), []
    raw = data.tobytes()
    end = np.repeat(offsets[1:], np.diff(offsets))
    for c in range(0, n - length + 1, CHUNK):
        windows = min(CHUNK, n - length + 1 - c)
        count = windows + grams - 1
        word = np.ndarray((count + gram - 8,), "<u8", raw, offset=c, strides=(1,))
        h = np.full(count, 0x9E3779B97F4A7C15, np.uint64)
        for k in range(0, gram, 8):
            h ^= word[k : k + count]
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        key = h & ~_PLACE | np.arange(count, dtype=np.uint64)
        span = 1
        while 2 * span <= grams:  # least key of 2, 4, 8, ... neighbours
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < grams:
            key = np.minimum(key[: len(key) - (grams - span)], key[grams - span :])
        place = (key & _PLACE).astype(np.int64)
        at = np.arange(c, c + windows)
        inside = at + length <= end[at]
        anchor = h[place]
        new = np.ones(windows, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (end[at[1:]] != end[at[:-1]]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, windows))
        cut = 2 * grams
        pieces = -(-size // cut)
        owner = np.repeat(np.arange(len(start)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size = start[owner] + nth * cut, np.minimum(size[owner] - nth * cut, cut)
        moves = np.concatenate([[0], np.cumsum(np.diff(place) != 0)])
        places = moves[start + size - 1] - moves[start] + 1
        keep = inside[start]
        found.append((at[start[keep]], size[keep], anchor[start[keep]], places[keep]))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _aligned(piece: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """Pieces (key, first window, windows) of a hot run, by the place of the least gram and the bytes that all of a piece's windows share."""
    gram, grams, _ = shape(length)
    data = np.frombuffer(piece, np.uint8)
    h = np.full(len(data) - gram + 1, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(0, gram, 8):
        h ^= np.ndarray((len(h),), "<u8", piece, offset=k, strides=(1,))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    h = h >> np.uint64(20)
    windows = len(data) - length + 1
    place = np.lib.stride_tricks.sliding_window_view(h, grams).argmin(1)  # 0 is the window's first gram
    block = place // PIECE
    moved = np.ones(windows, bool)
    moved[1:] = (np.diff(place) != -1) | (block[1:] != block[:-1])
    starts = np.flatnonzero(moved).tolist()
    for a, b in zip(starts, [*starts[1:], windows]):
        # All windows of this block hold the bytes around the gram that its first and last place allow.
        anchor, low = a + int(place[a]), int(block[a]) * PIECE
        left, right = anchor - low, anchor + length - (low + PIECE - 1)
        core = piece[left:right] if right > left else b""
        yield xxhash.xxh64_intdigest(core, low + 1), a, b - a


def _texts(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """All distinct texts with their two hashes, as a table bucketed by them: later joins move only their other side."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(8, min(100_000, total // BUCKET_BYTES, max(2000, total // (16 * BUCKET_BYTES)))))

    def once(batches):
        seen = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = [k not in seen and not seen.add(k) for k in keys]
            yield batch.filter(pa.array(new, pa.bool_()))
            bt.trim()

    kind = "k1 long, k2 long, text string"
    distinct = rows.mapInArrow(once, kind).repartition(buckets, "k1", "k2").mapInArrow(once, kind)
    distinct.write.bucketBy(buckets, "k1", "k2").option("compression", "zstd").format("parquet").saveAsTable(name)
    release(spark)
    return spark.table(name)


def _windows(length: int):
    """Texts (h, c1, c2, weight, bytes) to their windows (h, c1, c2, i, w1, w2, weight), told by all their bytes."""

    def windows(batches):
        for batch in batches:
            for h, c1, c2, weight, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                n = len(text) - length + 1
                w = np.array([divmod(xxhash.xxh128_intdigest(text[i : i + length]), 2**64) for i in range(n)], np.uint64).view(np.int64).reshape(n, 2)
                same = [pa.array(np.full(n, x, np.int64)) for x in (h, c1, c2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(np.full(n, weight, np.int32))], names=["h", "c1", "c2", "i", "w1", "w2", "weight"])

    return windows


def _runs_of(length: int):
    """(h, c1, c2, spans) from the numbers of the repeated windows of each text."""

    def runs(batches):
        for batch in batches:
            out = []
            for at in batch.column(3).to_pylist():
                at = np.sort(np.array(at))
                first = np.concatenate([[True], np.diff(at) > 1])
                out.append(np.stack([at[first], at[np.append(first[1:], True)] + length], 1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["h", "c1", "c2", "spans"])

    return runs


def _spans(texts: DataFrame, copied: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """k1, k2 and spans (binary: pairs of first and end byte) of the texts with repeated windows; copied: k1, k2 of texts that several rows hold."""
    spark = texts.sparkSession
    width = shape(length)[2]

    def find(batches):
        for batch in batches:
            data, offsets = bt.utf8(batch.column(2))
            for a, b in bt.slices(offsets, SEGMENT_BYTES):
                off = offsets[a : b + 1] - offsets[a]
                first, size, anchor, places = anchors(data[offsets[a] : offsets[b]], off, length)
                row = np.searchsorted(off, first, "right") - 1
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array((first - off[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.minimum(places, 2).astype(np.int32)), batch.column(3).take(take)], names=["h", "k1", "k2", "first", "size", "places", "weight"])
            bt.trim()

    weighed = texts.join(copied.withColumn("twice", F.lit(2)), ["k1", "k2"], "left").select("k1", "k2", "text", F.coalesce("twice", F.lit(1)).alias("weight"))
    found = scratch.written(weighed.mapInArrow(find, "h long, k1 long, k2 long, first int, size int, places int, weight int"), "runs")
    counts = found.groupBy("h").agg(F.sum(F.greatest("places", "weight")).alias("n")).where("n > 1")
    runs = found.join(counts, "h").select("k1", "k2", F.struct("h", "first", "size", (F.col("n") > HOT).alias("hot"), "weight").alias("run"))
    runs = scratch.written(runs.groupBy("k1", "k2").agg(F.collect_list("run").alias("runs")), "candidates")
    scratch.drop(found)
    release(spark)

    def cut(batches):
        """The candidate texts; bytes come with the first of equal ones in a batch, and how many of them there are."""
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                out, seen = [], {}
                for k1, k2, text, found in zip(*(part.column(i).to_pylist() for i in range(4))):
                    raw = text.encode()
                    for run in found:
                        piece = raw[run["first"] : run["first"] + run["size"] + length - 1]
                        todo = [(run["h"], 0, run["size"])]
                        if run["hot"]:
                            todo = [((run["h"] ^ key) & 2**64 - 1, i, n) for key, i, n in _aligned(piece, length)]
                        for h, i, n in todo:
                            text_ = piece[i : i + n + length - 1]
                            digest = xxhash.xxh128_intdigest(text_)
                            key = (h & 2**64 - 1, digest)
                            if key in seen:
                                out[seen[key]][6] += run["weight"]
                            else:
                                seen[key] = len(out)
                            out.append([h, digest >> 64, digest & 2**64 - 1, k1, k2, run["first"] + i, run["weight"], text_ if seen[key] == len(out) else None])
                columns = list(zip(*out)) if out else [()] * 8
                signed = lambda c: pa.array(np.array([x & 2**64 - 1 for x in c], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([signed(columns[0]), signed(columns[1]), signed(columns[2]), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.int32()), pa.array(columns[7], pa.binary())], names=["h", "c1", "c2", "k1", "k2", "first", "weight", "bytes"])
            bt.trim()

    cuts = texts.select("k1", "k2", "text").join(runs, ["k1", "k2"]).select("k1", "k2", "text", "runs")
    cuts = scratch.written(cuts.mapInArrow(cut, "h long, c1 long, c2 long, k1 long, k2 long, first int, weight int, bytes binary"), "cuts")
    scratch.drop(runs)

    def build(batches):
        """Rows by h: transform and common prefixes of whole anchors at a time."""
        held, size, last, texts_at = [], 0, None, {}

        def flush():
            if not held:
                return
            length_of = np.array([len(r[3]) for r in held])
            ends = np.cumsum(length_of)
            hit = columnbwt.repeated(np.frombuffer(b"".join(r[3] for r in held), np.uint8), ends - length_of, ends, length, width, np.array([r[4] for r in held]))
            out = []
            for (h, c1, c2, text, _), a, b in zip(held, (ends - length_of).tolist(), ends.tolist()):
                mine = hit[a : b - length + 1]
                if mine.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                    out.append((h, c1, c2, np.stack([edge[::2], edge[1::2] + length - 1], 1).astype("<i8").tobytes()))
            if out:
                h, c1, c2, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c1), pa.array(c2), pa.array(s, pa.binary())], names=["h", "c1", "c2", "spans"])

        for batch in batches:
            for h, c1, c2, weight, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if h != last:
                    if size >= BUILD_BYTES:
                        yield from flush()
                        held, size = [], 0
                    last, texts_at = h, {}
                if (c1, c2) in texts_at:
                    held[texts_at[c1, c2]][4] += weight
                    continue
                texts_at[c1, c2] = len(held)
                held.append([h, c1, c2, text, weight])
                size += len(text)
            bt.trim()
        yield from flush()

    distinct = cuts.where("bytes is not null").select("h", "c1", "c2", "weight", "bytes")
    # Copies of one piece are one text, so only pieces that differ count.
    heavy = distinct.groupBy("h", "c1", "c2").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h")
    heavy = scratch.written(heavy, "heavy")
    kind = "h long, c1 long, c2 long, spans binary"
    light = distinct.join(heavy, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    marks = scratch.written(light.mapInArrow(build, kind), "marks")
    if not heavy.isEmpty():
        single = distinct.join(heavy, "h", "left_semi").mapInArrow(_windows(length), "h long, c1 long, c2 long, i int, w1 long, w2 long, weight int")
        single = scratch.written(single, "windows")
        often = single.groupBy("h", "w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1").select("h", "w1", "w2")
        # A window that thousands of texts hold is looked up in SALTS tasks.
        salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        at = single.withColumn("salt", F.pmod("c1", F.lit(SALTS)).cast("int")).join(salted, ["h", "w1", "w2", "salt"]).groupBy("h", "c1", "c2").agg(F.collect_set("i").alias("at"))
        marks = marks.unionByName(scratch.written(at.mapInArrow(_runs_of(length), kind), "marks"))
    release(spark)
    hits = cuts.select("h", "c1", "c2", "k1", "k2", "first").join(marks, ["h", "c1", "c2"])
    return scratch.written(hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "spans")).alias("hits")), "hits")


def _removed(hits: list | None) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the maximal removed runs."""
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.concatenate([np.frombuffer(h["spans"], "<i8").reshape(-1, 2) + h["first"] for h in hits])
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(pairs)) - 1
    return pairs[new, 0], reach[last]


def _solve(docs: DataFrame, id_col: str, text_col: str, length: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (id, k1, k2), and the solution of each distinct text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")), "rows")

    def solve(batches):
        for batch in (whole.slice(a, 256) for whole in batches for a in range(0, whole.num_rows, 256)):
            out = []
            for k1, k2, text, hits in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = text.encode()
                a, b = _removed(hits)
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((k1, k2, len(raw), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text and len(a) else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            bt.trim()

    with Scratch(spark) as scratch:
        name = f"tessella_texts_{uuid.uuid4().hex}"
        scratch.names.append(name)
        texts = _texts(docs, text_col, name)
        copied = rows.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2")
        hits = _spans(texts, copied, length, scratch)
        solved = texts.select("k1", "k2", "text").join(hits, ["k1", "k2"], "left").select("k1", "k2", "text", "hits")
        solved = written(solved.mapInArrow(solve, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"), "solved")
    release(spark)
    return rows, solved


def digest(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte is removed if a string of `length` bytes over it also starts anywhere else, in the same row or another; texts
    shorter than that lose nothing; null counts as empty; repeated rows are copies of each other; an empty table gives none.
    """
    rows, solved = _solve(docs, id_col, text_col, length, False)
    return rows.join(solved.drop("kept"), ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes cut out of text_col; a character that loses one of its bytes goes whole.

    All rows stay, also those whose text becomes empty; null and empty texts stay as they are; repeated rows lose all
    that is as long as a window; extra columns pass through whatever their names; an empty table gives an empty result.
    """
    _, solved = _solve(docs, id_col, text_col, length, True)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2, kept = (fresh(docs.columns, c) for c in ("k1", "k2", "kept"))
    keyed = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit(1), text)})
    cut = solved.where("n_removed > 0").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("kept").alias(kept))
    joined = keyed.join(cut, [k1, k2], "left")
    return joined.select(*[F.coalesce(F.col(kept), F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
