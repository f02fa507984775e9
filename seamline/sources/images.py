"""Image files below a folder and their sizes, from the headers alone."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The endings of image files.
ENDINGS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of every image below a folder. Contents are only read
    if they are selected, so a listing is `read_images(...).select("path").orderBy("path")`."""
    glob = f"*.{{{','.join(ENDINGS)}}}"
    return spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(path).select("path", "length", "content")


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Of the first start of frame; other segments are passed over by their lengths."""
    at = 2
    while data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # filling
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # no length follows
            at += 2
        elif marker in (0xD9, 0xDA):
            return None
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        else:
            at += 2 + max(2, struct.unpack_from(">H", data, at + 2)[0])
    return None


def tiff_size(data: bytes) -> tuple[int, int] | None:
    """Of the first directory's tags 256 and 257."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    found = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind = struct.unpack_from(order + "HH", data, at + 2 + 12 * k)
        if tag in (256, 257) and kind in (3, 4):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * k)[0]
    return (found[256], found[257]) if len(found) == 2 else None


def header_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height), or None for what is no whole header of a known kind or has no area."""
    size, data = None, data or b""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            size = struct.unpack_from(">II", data, 16)
        elif data[:2] == b"BM":
            old = struct.unpack_from("<I", data, 14)[0] == 12
            size = struct.unpack_from("<HH" if old else "<ii", data, 18)
            size = size[0], abs(size[1])  # rows from the top have a negative height
        elif data[:2] == b"\xff\xd8":
            size = jpeg_size(data)
        elif data[:4] in (b"II*\0", b"MM\0*"):
            size = tiff_size(data)
    except (struct.error, IndexError):
        return None
    return size if size and 0 < size[0] < 1 << 31 and 0 < size[1] < 1 << 31 else None


def with_size(images: DataFrame, content: str = "content") -> DataFrame:
    """images with width and height in place of their content; null where it tells none."""
    rest = [c for c in images.columns if c not in (content, "width", "height")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [header_size(x.as_py()) or (None, None) for x in batch.column(content)]
            wh = [pa.array([s[i] for s in sizes], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *wh], [*rest, "width", "height"])

    kinds = "".join(f"`{c}` {images.schema[c].dataType.simpleString()}, " for c in rest)
    return images.select(*(F.col(f"`{c}`") for c in rest), content).mapInArrow(run, f"{kinds}width int, height int")
