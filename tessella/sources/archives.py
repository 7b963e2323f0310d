"""Lump archives and zip packs: read from binary rows, written one file a tile."""

from __future__ import annotations

import io
import os
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the format: header and directory entry, little-endian.
_HEADER, _ENTRY = struct.Struct("<4sii"), struct.Struct("<ii8s")


def pack_lumps(lumps: list[tuple[str, bytes]]) -> bytes:
    """An archive of named lumps; empty ones are markers, at offset zero."""
    at, body, entries = _HEADER.size, [], []
    for name, data in lumps:
        if len(name) > 8:
            raise ValueError(f"a lump's name has 8 characters at most: {name}")
        entries.append(_ENTRY.pack(at if data else 0, len(data), name.upper().encode("ascii")))
        body.append(data)
        at += len(data)
    return b"".join([_HEADER.pack(b"PWAD", len(lumps), at), *body, *entries])


def lump_directory(data: bytes) -> list[tuple[str, int, int]]:
    """(name, offset, size) in order; raises where it is no archive."""
    kind, count, at = _HEADER.unpack_from(data)
    if kind not in (b"IWAD", b"PWAD"):
        raise ValueError("neither an IWAD nor a PWAD")
    found = (_ENTRY.unpack_from(data, at + _ENTRY.size * i) for i in range(count))
    return [(name.rstrip(b"\0").decode("ascii", "replace"), offset, size) for offset, size, name in found]


def texture_names(data: bytes) -> list[str]:
    """Names that a texture lump lists."""
    if len(data) < 4:
        return []
    (count,) = struct.unpack_from("<i", data)
    return [data[o : o + 8].rstrip(b"\0").decode("ascii", "replace") for o in struct.unpack_from(f"<{count}i", data, 4)]


def read_lumps(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, place, name, offset, size and data of every lump; files as spark.read.format("binaryFile") gives them."""
    files = files.select(F.col(key).alias("key"), content)
    kind = files.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                if data is None:
                    continue
                found = lump_directory(data)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[i].as_py()] * len(found), batch.schema.field(0).type), pa.array(range(len(found)), pa.int64()), pa.array([n for n, _, _ in found], pa.string()),
                    pa.array([o for _, o, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int64()), pa.array([data[o : o + s] for _, o, s in found], pa.binary()),
                ], names=["key", "place", "name", "offset", "size", "data"])

    return files.mapInArrow(run, f"key {kind}, place long, name string, offset long, size long, data binary").withColumnRenamed("key", key)


def between(lumps: DataFrame, key: str, starts: list[str], ends: list[str]) -> DataFrame:
    """Lumps with data between start and end markers."""
    mark = F.when(F.col("name").isin(starts), 1).when(F.col("name").isin(ends), 0)
    inside = F.last(mark, ignorenulls=True).over(W.partitionBy(key).orderBy("place"))
    return lumps.withColumns({"_in": inside, "_mark": mark}).where("_in = 1 AND _mark IS NULL AND size > 0").drop("_in", "_mark")


def map_archives(maps: DataFrame, key: str, name: str = "map_name", text: str = "text") -> DataFrame:
    """key and content: an archive of the map's marker, its text and the end marker."""
    maps = maps.select(F.col(key).alias("key"), name, text)
    kind = maps.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = [pack_lumps([(n, b""), ("TEXTMAP", (t or "").encode()), ("ENDMAP", b"")]) for n, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "content"])

    return maps.mapInArrow(run, f"key {kind}, content binary").withColumnRenamed("key", key)


def last_members(*layers: DataFrame) -> DataFrame:
    """pack, member, data of all layers; of equal names the one of the last layer."""
    ranked = [layer.select("pack", "member", "data", F.lit(i).alias("layer")) for i, layer in enumerate(layers)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more)
    best = rows.groupBy("pack", "member").agg(F.max_by("data", "layer").alias("data"))
    return best


def write_packs(members: DataFrame, folder: str) -> DataFrame:
    """One zip a pack in a folder that all executors share: pack, path, members, bytes.

    Members are sorted within tasks and streamed into the zip; a pack is renamed into place when it is whole, so a lost
    task leaves nothing that counts as done. Equal members give equal files: entries carry a fixed date.
    """

    def run(batches):
        current, zipped, temporary, count = None, None, None, 0

        def close():
            zipped.close()
            path = f"{folder}/{current}.pk3"
            size = os.path.getsize(temporary)
            os.replace(temporary, path)
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["pack", "path", "members", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                pack, member, data = (batch.column(k)[i].as_py() for k in range(3))
                if pack != current:
                    if zipped:
                        yield close()
                    current, count = pack, 0
                    temporary = f"{folder}/.{pack}.{os.getpid()}.tmp"
                    os.makedirs(folder, exist_ok=True)
                    zipped = zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED)
                zipped.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), data or b"", zipfile.ZIP_DEFLATED)
                count += 1
        if zipped:
            yield close()

    rows = members.select(F.col("pack").cast("string").alias("pack"), "member", "data")
    return rows.repartition("pack").sortWithinPartitions("pack", "member").mapInArrow(run, "pack string, path string, members long, bytes long")


def read_packs(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, member, size, crc of every member of each zip."""
    files = files.select(F.col(key).cast("string").alias("key"), content)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = zipfile.ZipFile(io.BytesIO(batch.column(1)[i].as_py())).infolist()
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(found), pa.string()), pa.array([z.filename for z in found], pa.string()), pa.array([z.file_size for z in found], pa.int64()), pa.array([z.CRC for z in found], pa.int64())], names=["key", "member", "size", "crc"])

    return files.mapInArrow(run, "key string, member string, size long, crc long").withColumnRenamed("key", key)
