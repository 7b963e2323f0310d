"""SimHash near-duplicates, found through an embedding in bit counts.

A fingerprint is one or more words of 64 bits. A word is cut into overlapping segments of two bits (each byte is eight
segments, the last one closing the circle); the vector of their bit counts is the embedding. Fingerprints that agree on a
block (a byte) agree on its counts, so the grids are choices of blocks: rows that share the counts of all blocks of one
choice share a cell. For one word and a limit of `most` bits, at most `most` of its eight blocks can hold a difference,
so the grids over 8 - most blocks miss no pair. Candidates are kept if the Manhattan distance of the counts of disjoint
segments, a lower bound, is within the limit, and are then compared exactly.

Equal fingerprints are one class before any join. Cells beyond CELL rows are dealt out in blocks: each block is compared
with itself and with the first block, and only cells that still hold several components are compared block by block.
Within a cell only a spanning forest of the links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytestext as bt
from tessella.llm.components import components
from tessella.llm.store import Scratch, fresh, written

SHINGLE, SEED, MOST_BITS = 4, 42, 4
SEGMENT_BYTES = 1 << 20
#: Rows of a cell that one task compares with each other; larger cells are dealt out in blocks of about as many.
CELL = 256
#: Rows of cells that one task writes; later tasks count as many, which holds their memory down.
SPREAD = 1_000_000
_BLOCKS = 8

_LANES = np.zeros(256, np.uint64)
for _j in range(8):
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_j)) & np.uint64(1)) << np.uint64(8 * _j)
#: Code of a byte: the counts of its eight overlapping segments of two bits as digits of base 3.
_CODE = np.array([sum(((v >> s & 1) + (v >> (s + 1) % 8 & 1)) * 3**s for s in range(8)) for v in range(256)], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes of word k: those of XXH64 for word 0, and a mix of them for each other word."""
    if not k:
        return h
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93 * (2 * k + 1) % 2**64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED, words: int = 1) -> np.ndarray:
    """SimHash of each row's whole text, a row of `words` 64-bit words each; rows without words of text have zero."""
    n = len(offsets) - 1
    low = bt.LOWER[data]
    inside = ~bt.SPACE[low]
    starts, ends = bt.spans(inside, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    lengths = ends - starts
    # Words with one space after each: a shingle is then a slice of the result.
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    flat = np.full(at[-1], 32, np.uint8)
    room = np.ones(at[-1], bool)
    room[at[1:] - 1] = False
    flat[room] = low[inside]
    n_words = np.bincount(row, minlength=n)
    n_shingles = np.where(n_words, np.maximum(1, n_words - shingle + 1), 0)
    first_word = np.cumsum(n_words) - n_words
    total = int(n_shingles.sum())
    done = np.cumsum(n_shingles)
    owner = np.repeat(np.arange(n), n_shingles)
    begin = np.repeat(first_word, n_shingles) + np.arange(total) - np.repeat(done - n_shingles, n_shingles)
    last = np.minimum(begin + shingle, first_word[owner] + n_words[owner]) - 1
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[s:e], seed) for s, e in zip(at[begin].tolist(), (at[last] + lengths[last]).tolist())), np.uint64, total)
    # Bits are counted in eight byte lanes of a word, over at most 255 shingles at a time.
    out = np.zeros((n, words), np.uint64)
    if not total:
        return out
    within = np.arange(total) - np.repeat(done - n_shingles, n_shingles)
    cut = np.flatnonzero(within % 255 == 0)
    rows, begins = np.unique(owner[cut], return_index=True)
    half = n_shingles[rows]
    for k in range(words):
        bytes_ = _mixed(h, k).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            lanes = np.add.reduceat(_LANES[bytes_[:, b]], cut).view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(lanes.astype(np.int64), begins, axis=0)
            for j in range(8):
                out[rows, k] |= (2 * counts[:, j] > half).astype(np.uint64) << np.uint64(8 * b + j)
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the long columns named in keep, and fp (binary, 8 bytes a word) of every row; null and empty texts have zeros."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *ids, texts = batch.columns
            data, offsets = bt.utf8(texts)
            for a, b in bt.slices(offsets, SEGMENT_BYTES):
                fp = fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle, words=words)
                column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), b - a, [None, pa.py_buffer(np.ascontiguousarray(fp.astype("<u8")))])
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in ids], column.cast(pa.binary())], names=["doc_id", *keep, "fp"])
            bt.trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in keep], F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(prints, ", ".join(f"{c} long" for c in ("doc_id", *keep)) + ", fp binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Fingerprints of a binary column, a row each."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u8").reshape(len(rows), -1)


def _grids(words: int, agree: int) -> list[tuple[int, ...]]:
    """Choices of `agree` blocks of one word, for each of the first `words` words."""
    if not 1 <= agree <= _BLOCKS:
        raise ValueError(f"grids are over 1 to {_BLOCKS} blocks of a word")
    return [tuple(_BLOCKS * w + b for b in blocks) for w in range(words) for blocks in combinations(range(_BLOCKS), agree)]


def _cells(grids: list[tuple[int, ...]]):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = _CODE[_matrix(batch.column(1)).view(np.uint8).reshape(batch.num_rows, -1)]
            for g, blocks in enumerate(grids):
                key = np.full(batch.num_rows, g, np.uint64)
                for b in blocks:  # beyond four blocks the number wraps, which may only add candidates
                    key = key * np.uint64(6561) + code[:, b]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["cell", "id"])
            bt.trim()

    return cells


def _linked(a, b, most: int) -> np.ndarray:
    """Which fingerprints differ in at most `most` bits; a and b: an array, or an array for each word.

    The Manhattan distance of the counts of disjoint two-bit segments comes first, then the exact comparison of what is left.
    """
    if isinstance(a, np.ndarray):
        a, b = [a], [b]
    low, one = np.uint64(0x5555555555555555), np.uint64(1)
    bound = 0
    for x, y in zip(a, b):
        # |u - v| for u, v in 0..2, two bits each: 0 if equal, 2 for 0 against 2, else 1.
        diff = ((x & low) + ((x >> one) & low)) ^ ((y & low) + ((y >> one) & low))
        odd = diff & low
        far = (diff >> one) & low & ~odd
        bound = bound + np.bitwise_count(odd).astype(np.int16) + 2 * np.bitwise_count(far).astype(np.int16)
    near = np.asarray(bound <= most)
    at = np.nonzero(near)
    near[at] = sum(np.bitwise_count(np.broadcast_to(x, near.shape)[at] ^ np.broadcast_to(y, near.shape)[at]).astype(np.int64) for x, y in zip(a, b)) <= most
    return near


def _forest(fp: np.ndarray, side: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row numbers) of a spanning forest of the links; with side, only links between side 0 and side 1 count."""
    n = len(fp)
    link = _linked([w[:, None] for w in fp.T], [w[None, :] for w in fp.T], most)
    if side is not None:
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    parent = np.full(n, -1)
    seen = ~link.any(axis=1)
    while not seen.all():
        frontier = np.array([int(np.flatnonzero(~seen)[0])])
        seen[frontier] = True
        while len(frontier):
            reach = link[frontier] & ~seen[None, :]
            new = np.flatnonzero(reach.any(axis=0))
            parent[new] = frontier[reach[:, new].argmax(axis=0)]
            seen[new] = True
            frontier = new
    child = np.flatnonzero(parent >= 0)
    return np.minimum(parent[child], child), np.maximum(parent[child], child)


def _links(most: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cell, part, side, id, fp), in the order of cell and part: edges within each run.

        Trees begin at the first row of a run, so runs that share rows, in one order everywhere, share edges; a comes
        before b in that order.
        """
        held = None
        for table in _and_none(batches):
            if table is None:
                if held is None:
                    return
                cols, cut = held, len(held[0])
            else:
                if not table.num_rows:
                    continue
                cols = [*(np.asarray(table.column(i)) for i in range(4)), _matrix(table.column(4))]
                if held is not None:
                    cols = [np.concatenate(x) for x in zip(held, cols)]
                change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
                cut = int(change[-1]) + 1 if len(change) else 0
                held = [c[cut:] for c in cols]
            cell, part, side, ids, fp = (c[:cut] for c in cols)
            if not cut:
                continue
            first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]))
            size = np.diff(np.append(first, cut))
            a, b = [], []
            pairs = first[size == 2]
            pairs = pairs[(side[pairs] < 0) | (side[pairs] != side[pairs + 1])]
            pairs = pairs[_linked(list(fp[pairs].T), list(fp[pairs + 1].T), most)]
            a.append(ids[pairs])
            b.append(ids[pairs + 1])
            for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                x, y = _forest(fp[s : s + n], side[s : s + n] if side[s] >= 0 else None, most)
                a.append(ids[s + x])
                b.append(ids[s + y])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                edges = np.unique(np.stack([a, b], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return links


def _and_none(batches):
    yield from batches
    yield None


def near_links(classes: DataFrame, most: int = MOST_BITS, grid_words: int = 1, agree: int | None = None) -> DataFrame:
    """Edges (a, b) between ids whose components are those of all pairs that share a cell and differ in at most `most` bits.

    classes: distinct columns id (long) and fp (binary), or fp alone as long, which is the id then. agree None: 8 - most
    blocks of one word, so no pair is missed.
    """
    if "id" not in classes.columns:
        classes = classes.select(F.col("fp").alias("id"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))
    if agree is None and not 0 <= most < _BLOCKS:
        raise ValueError(f"without a choice of grids the limit must be 0 to {_BLOCKS - 1} bits")
    grids = _grids(grid_words, _BLOCKS - most if agree is None else agree)

    turn = _turn("id")  # block 0 holds the first rows of each cell

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.join(classes.select("id", "fp"), "id").select("cell", "part", "side", "id", "fp")
        return rows.repartition("cell", "part").sortWithinPartitions("cell", "part", turn).mapInArrow(_links(most), "a long, b long").distinct()

    with Scratch(classes.sparkSession) as scratch:
        tasks = max(1, -(-classes.count() * len(grids) // SPREAD))  # a small table of fingerprints lies in few files, but each gives many rows
        cells = scratch.written(classes.select("id", "fp").repartition(tasks, "id").mapInArrow(_cells(grids), "cell long, id long"), "cells")
        counts = cells.groupBy("cell").count().where("count > 1")
        n = F.ceil(F.col("count") / F.lit(CELL)).cast("int")
        block = F.least(F.floor((turn / F.lit(2.0**64) + 0.5) * n), n - 1).cast("int")
        rows = scratch.written(cells.join(counts, "cell").select("cell", "id", n.alias("blocks"), block.alias("i")).repartition("id"), "shared")  # few of the rows are left, so few files
        scratch.drop(cells)
        # Each block meets itself and block 0, whose rows go to all parts: no more rows than the cell has.
        parts = F.when(F.col("i") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("i"))
        first = rows.select("cell", F.explode(parts).alias("part"), F.lit(-1).alias("side"), "id")
        edges = written(compared(first), "links")
        hot = rows.where("blocks > 1")
        if hot.isEmpty():
            return edges
        # What is in one component already needs no further link.
        root = components(classes.select("id", F.lit(None).cast("long").alias("label")), _contracted(edges), "id", "label", roots=True).select("id", "root")
        hot = scratch.written(hot.join(root, "id"), "hot")
        open_ = hot.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
        across = hot.join(open_, "cell", "left_semi").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> j")
        lo, hi = F.least("i", "j"), F.greatest("i", "j")
        across = across.select("cell", (lo * F.col("blocks") + hi).cast("long").alias("part"), (F.col("i") > F.col("j")).cast("int").alias("side"), "id")
        return edges.unionByName(written(compared(across), "links"))


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of edges of near_links, about one a node.

    A node is linked to the first row of its run in each of its cells; it keeps the first of these, to which the others
    are linked instead. A node has as many of them as grids at most, so the lists are short.
    """
    first = F.struct(_turn("a").alias("turn"), F.col("a").alias("id"))
    stars = edges.groupBy("b").agg(F.sort_array(F.collect_set(first)).alias("to"))
    pair = lambda x: F.struct(F.col("to")[0]["id"].alias("a"), x.alias("b"))
    pairs = F.concat(F.array(pair(F.col("b"))), F.transform(F.slice("to", 2, 1 << 20), lambda x: pair(x["id"])))
    return written(stars.select(F.explode(pairs).alias("e")).select("e.a", "e.b").distinct(), "links")


def _turn(column: str):
    """The order of ids in all cells."""
    return F.xxhash64(column, F.lit(7))


def _classes(prints: DataFrame) -> DataFrame:
    """id, fp and the least doc_id of each distinct fingerprint; written, so that ids stay."""
    return written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select(F.monotonically_increasing_id().alias("id"), "fp", "least"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id that links lead to) of every row.

    Texts without words have fingerprint zero, linked like any other; repeated rows share a component; a null doc_id
    takes part but is no component's id unless its component has no other; rows that share an id are told apart by their
    fingerprints; an empty table gives an empty result.
    """
    prints = written(with_fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    classes = _classes(prints)
    labels = components(classes, _contracted(near_links(classes, most)), "id", "least").join(classes.select("id", "fp"), "id")
    named = prints.join(labels, "fp", "left")
    return named.select("doc_id", F.lower(_hex("fp")).alias("fingerprint"), F.col("least").alias("component_id"))


def _hex(column: str):
    """Hex digits of little-endian bytes, the highest first."""
    return F.concat(*[F.hex(F.substring(column, k, 1)) for k in range(8, 0, -1)])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, words: int = 8, grid_words: int = 3, agree: int = 3, most: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the least id stays, once.

    Near copies have fingerprints of `words` words that differ in at most `most` bits and share a cell of the grids over
    `agree` blocks of one of the first `grid_words` words. 80 of 512 bits is what texts with 0.8 of their five-word
    shingles in common differ in. Rows with a null id stay only where their component has no other; of those, and of rows
    that share the least id, one stays, but unlike texts with one id are components of their own. Null and empty texts
    are copies of each other; extra columns pass through whatever their names; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    r1, r2 = F.xxhash64(F.lit(3), F.col(id_col), text), F.xxhash64(text, F.col(id_col), F.lit(5))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1) - F.abs(F.shiftright(r1, 2)))
    rows = docs.select(order.alias("order"), r1.alias("r1"), r2.alias("r2"), F.col(text_col).alias("text"))
    prints = written(with_fingerprint(rows, "order", "text", shingle, words, ("r1", "r2")), "fingerprints")
    classes = _classes(prints)
    labels = components(classes, _contracted(near_links(classes, most, grid_words, agree)), "id", "least", roots=True).join(classes.select("id", "fp"), "id")
    first = prints.join(labels, "fp").where(F.col("doc_id") == F.col("least")).groupBy("root").agg(F.min(F.struct("r1", "r2")).alias("row"))
    k1, k2 = fresh(docs.columns, "k1"), fresh(docs.columns, "k2")
    first = first.select(F.col("row.r1").alias(k1), F.col("row.r2").alias(k2))
    kept = docs.withColumns({k1: r1, k2: r2}).join(first, [k1, k2], "left_semi").dropDuplicates([k1, k2])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
