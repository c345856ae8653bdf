"""Executable containers: thin and fat files to slices and load commands, one row each, damaged ones to error rows.

Only headers are read, by their public layout: a magic number gives byte order and word size, then commands of
(kind, size) follow each other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magic numbers with (byte order, 64-bit), the fat magic, and command kinds that are taken apart.
MAGIC = {0xFEEDFACE: False, 0xFEEDFACF: True}
FAT, MOST_SLICES = 0xCAFEBABE, 128
SEGMENT, SEGMENT_64, SYMTAB, UUID, ENTRY = 0x1, 0x19, 0x2, 0x1B, 0x80000028
LIBRARIES = {0xC: "library", 0x80000018: "weak_library", 0x8000001F: "reexported_library", 0xD: "own_id"}
ENCRYPTION = {0x21: "encryption", 0x2C: "encryption"}

SCHEMA = "path string, slice int, cpu_type long, ordinal int, command long, kind string, name string, vm_start long, vm_size long, file_offset long, file_size long, number long, error string"
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in SCHEMA.split(", ")])


def slices(data: bytes) -> list[tuple[int, int]]:
    """(offset, size) of each slice; they lie inside the file and do not overlap."""
    if len(data) >= 8 and struct.unpack_from(">I", data)[0] == FAT:
        n = struct.unpack_from(">I", data, 4)[0]
        if not 1 <= n <= MOST_SLICES or len(data) < 8 + 20 * n:
            raise ValueError("slice_count")
        found = sorted(struct.unpack_from(">II", data, 8 + 20 * i + 8) for i in range(n))
        end = 8 + 20 * n
        for offset, size in found:
            if offset < end or offset + size > len(data):
                raise ValueError("slice_bounds")
            end = offset + size
        return found
    return [(0, len(data))]


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def commands(data: bytes) -> Iterator[dict]:
    """The load commands of one slice."""
    order = next((o for o in "<>" if len(data) >= 28 and struct.unpack_from(o + "I", data)[0] in MAGIC), None)
    if order is None:
        raise ValueError("magic")
    wide = MAGIC[struct.unpack_from(order + "I", data)[0]]
    cpu, _, _, n, total = struct.unpack_from(order + "5I", data, 4)
    at, end = 32 if wide else 28, (32 if wide else 28) + total
    if end > len(data):
        raise ValueError("command_bounds")
    for ordinal in range(n):
        if at + 8 > end:
            raise ValueError("command_bounds")
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 8 or at + size > end:
            raise ValueError("command_size")
        row = {"cpu_type": cpu, "ordinal": ordinal, "command": kind, "kind": "other"}
        if kind in (SEGMENT, SEGMENT_64) and size >= (72 if kind == SEGMENT_64 else 56):
            start, length, offset, filed = struct.unpack_from(order + ("4Q" if kind == SEGMENT_64 else "4I"), data, at + 24)
            row |= {"kind": "segment", "name": _text(data[at + 8 : at + 24]), "vm_start": start, "vm_size": length, "file_offset": offset, "file_size": filed}
        elif kind in LIBRARIES and size >= 24:
            place = struct.unpack_from(order + "I", data, at + 8)[0]
            row |= {"kind": LIBRARIES[kind], "name": _text(data[at + place : at + size]) if place < size else None, "number": struct.unpack_from(order + "I", data, at + 16)[0]}
        elif kind in ENCRYPTION and size >= 20:
            offset, filed, scheme = struct.unpack_from(order + "3I", data, at + 8)
            row |= {"kind": "encryption", "file_offset": offset, "file_size": filed, "number": scheme}
        elif kind == SYMTAB and size >= 24:
            offset, count = struct.unpack_from(order + "II", data, at + 8)
            row |= {"kind": "symbols", "file_offset": offset, "number": count}
        elif kind == UUID and size >= 24:
            row |= {"kind": "uuid", "name": data[at + 8 : at + 24].hex()}
        elif kind == ENTRY and size >= 24:
            row |= {"kind": "entry", "file_offset": struct.unpack_from(order + "Q", data, at + 8)[0]}
        yield row
        at += size


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            rows, path, content = [], file["path"], file["content"] or b""
            try:
                for i, (offset, size) in enumerate(slices(content)):
                    try:
                        rows += [{"path": path, "slice": i} | c for c in list(commands(content[offset : offset + size]))]
                    except ValueError as e:
                        rows.append({"path": path, "slice": i, "error": str(e)})
            except ValueError as e:
                rows.append({"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def load_commands(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for files (path, content)."""
    return files.select("path", "content").mapInArrow(_decode, SCHEMA)


def encrypted(found: DataFrame) -> DataFrame:
    """C4: slices whose encryption scheme is not nought."""
    return found.where("kind = 'encryption' and number <> 0").select("path", "slice")


def file_offset(addresses: DataFrame, found: DataFrame) -> DataFrame:
    """(path, slice, address, offset): the file place of each address by the segment that holds it, NULL where none does.

    Segments of one slice do not overlap, so the one that starts last before an address decides: a union and one
    running window instead of a theta join.
    """
    from pyspark.sql.window import Window

    segments = found.where("kind = 'segment' and vm_size > 0").select("path", "slice", F.col("vm_start").alias("address"), F.struct("vm_start", "vm_size", "file_offset", "file_size").alias("segment"))
    both = segments.unionByName(addresses.select("path", "slice", "address"), allowMissingColumns=True)
    w = Window.partitionBy("path", "slice").orderBy("address", F.col("segment").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("last", F.last("segment", ignorenulls=True).over(w)).where("segment is null")
    into = F.col("address") - F.col("last.vm_start")
    return last.select("path", "slice", "address", F.when((into < F.col("last.vm_size")) & (into < F.col("last.file_size")), F.col("last.file_offset") + into).alias("offset"))
