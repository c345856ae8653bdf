"""Pictures: chunk lists with their checksums, and phone-optimised PNG files made standard again.

The optimised form holds raw deflate data of premultiplied blue-green-red-alpha pixels. Rows are unfiltered as
numpy arrays; only the two predictors that need the pixel to the left go pixel by pixel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A PNG's first bytes, its end, the mark of the optimised form, and JPEG's frame markers.
SIGNATURE, END, OPTIMISED = b"\x89PNG\r\n\x1a\n", b"IEND", b"CgBI"
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
STORED = 65_535


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, content) up to the end chunk; damaged, endless or continued files are errors."""
    if not data.startswith(SIGNATURE):
        raise ValueError("signature")
    out, at = [], len(SIGNATURE)
    while not out or out[-1][0] != END:
        if at + 12 > len(data):
            raise ValueError("no_end")
        (n,) = struct.unpack_from(">I", data, at)
        if at + 12 + n > len(data):
            raise ValueError("chunk_bounds")
        whole = data[at + 4 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(whole):
            raise ValueError("checksum")
        out.append((whole[:4], whole[4:]))
        at += 12 + n
    if at != len(data):
        raise ValueError("data_after_end")
    return out


def chunk(kind: bytes, content: bytes) -> bytes:
    return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))


def stored(data: bytes) -> bytes:
    """A zlib stream of stored blocks, the same on every machine."""
    blocks = [data[i : i + STORED] for i in range(0, len(data), STORED)] or [b""]
    body = b"".join(struct.pack("<BHH", i == len(blocks) - 1, len(b), len(b) ^ 0xFFFF) + b for i, b in enumerate(blocks))
    return b"\x78\x01" + body + struct.pack(">I", zlib.adler32(data))


def _paeth(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours the nearest to left + above - corner, in this order."""
    guess = left + above - corner
    a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))


def unfiltered(raw: bytes, width: int, height: int) -> np.ndarray:
    """Pixels (height, width, 4) of filtered rows."""
    if len(raw) != height * (4 * width + 1):
        raise ValueError("row_size")
    rows = np.frombuffer(raw, np.uint8).reshape(height, 4 * width + 1)
    out = np.zeros((height + 1, width + 1, 4), np.int16)  # a row above and a pixel to the left of nought
    for y, (kind, row) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:].reshape(height, width, 4).astype(np.int16), strict=True), 1):
        here, above = out[y, 1:], out[y - 1]
        if kind == 0:
            here[:] = row
        elif kind == 1:
            here[:] = np.cumsum(row, axis=0) % 256
        elif kind == 2:
            here[:] = (row + above[1:]) % 256
        elif kind in (3, 4):
            for x in range(width):
                left = out[y, x]
                guess = (left + above[x + 1]) // 2 if kind == 3 else _paeth(left, above[x + 1], above[x])
                here[x] = (row[x] + guess) % 256
        else:
            raise ValueError("filter")
    return out[1:, 1:].astype(np.uint8)


def standard(data: bytes) -> tuple[bytes, bool]:
    """(file, whether it was optimised): an optimised file as a standard one, others as they are."""
    found = chunks(data)
    if not any(kind == OPTIMISED for kind, _ in found):
        return data, False
    head = next((c for k, c in found if k == b"IHDR"), b"")
    if len(head) != 13:
        raise ValueError("header")
    width, height, *form = struct.unpack(">II5B", head)
    if form != [8, 6, 0, 0, 0]:
        raise ValueError("pixel_form")
    try:
        raw = zlib.decompress(b"".join(c for k, c in found if k == b"IDAT"), -15)
    except zlib.error as e:
        raise ValueError("deflate") from e
    pixels = unfiltered(raw, width, height).astype(np.int32)
    alpha = pixels[..., 3:]
    whole = np.minimum(255, (pixels[..., 2::-1] * 255 + alpha // 2) // np.maximum(alpha, 1))
    colours = np.where(alpha > 0, whole, pixels[..., 2::-1])
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.concatenate([colours, alpha], 2).astype(np.uint8).reshape(height, -1)], 1)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", stored(rows.tobytes())) + chunk(END, b""), True


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """A26 for JPEG: (width, height) of the first frame; None if there is none."""
    at = 2 if data.startswith(b"\xff\xd8") else len(data)
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker, at = data[at + 1], at + 2
        if marker in (0xD8, 0xD9):
            continue
        n = struct.unpack_from(">H", data, at)[0] if at + 2 <= len(data) else 0
        if n < 2 or at + n > len(data):
            return None
        if marker in FRAMES and n >= 7:
            height, width = struct.unpack_from(">HH", data, at + 3)
            return width, height
        at += n
    return None


_ARROW = pa.schema([("path", pa.string()), ("content", pa.binary()), ("optimised", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("error", pa.string())])


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {"path": batch.column("path")[i].as_py()}
            data = batch.column("content")[i].as_py() or b""
            try:
                if size := jpeg_size(data):
                    row |= {"content": data, "optimised": False, "width": size[0], "height": size[1]}
                else:
                    row["content"], row["optimised"] = standard(data)
                    row["width"], row["height"] = struct.unpack_from(">II", chunks(data)[1 if row["optimised"] else 0][1])
            except (ValueError, struct.error) as e:
                row["error"] = str(e) if isinstance(e, ValueError) else "header"
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)


def pictures(files: DataFrame) -> DataFrame:
    """(path, content, optimised, width, height, error) of PNG files, made standard where needed, and JPEG files."""
    return files.select("path", "content").mapInArrow(_convert, "path string, content binary, optimised boolean, width int, height int, error string")
