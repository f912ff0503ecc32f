"""Image and matrix file formats, as functions between bytes and rows.

Readers take the rows of Spark's ``binaryFile`` source (path, content), so files come from any store that
Spark reads; writers give rows of (path, content).
"""

from __future__ import annotations

import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RASTER = "path string, r int, c int, ch int, v double"


#: Cells after which a batch of images is handed on.
BATCH_CELLS = 1 << 16


def _tall(images: list[tuple[str, np.ndarray]]) -> pd.DataFrame:
    """The cells of images (path, rows x columns x channels), one image after the other."""
    at = [np.indices(a.shape).reshape(3, -1) for _, a in images]
    r, c, ch = np.concatenate(at, axis=1)
    return pd.DataFrame({"path": np.repeat([p for p, _ in images], [a.size for _, a in images]), "r": r, "c": c, "ch": ch, "v": np.concatenate([a.ravel() for _, a in images]).astype(float)})


def _header(data: bytes, fields: int) -> tuple[list[bytes], int]:
    """White-space separated fields, comments left out, and where the pixels start."""
    found, at = [], 0
    while len(found) < fields:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        found.append(data[at:end])
        at = end
    return found, at + 1


def parse_pgm(data: bytes) -> np.ndarray | None:
    """Grey values in 0..1 of a P5 file; None unless its greatest value is 255."""
    (magic, w, h, top), at = _header(data, 4)
    if magic != b"P5" or top != b"255":
        return None
    return np.frombuffer(data, np.uint8, int(w) * int(h), at).reshape(int(h), int(w)) / 255.0


def parse_ppm(data: bytes) -> np.ndarray | None:
    """Bytes of a P6 file of 8 or 16 bits (high byte first), scaled by 255 / greatest value and cut to whole numbers."""
    (magic, w, h, top), at = _header(data, 4)
    if magic != b"P6":
        return None
    n = int(w) * int(h) * 3
    a = np.frombuffer(data, np.uint8 if int(top) < 256 else ">u2", n, at).reshape(int(h), int(w), 3)
    return (a.astype(np.int64) * 255 // int(top)).astype(float)


def parse_raw(data: bytes, rows: int, columns: int, packed: bool = False) -> np.ndarray:
    """Raw RGB bytes, or with ``packed`` 24-bit numbers; gzip is told by its first bytes."""
    data = zlib.decompressobj(31).decompress(data) if data[:2] == b"\x1f\x8b" else data
    a = np.frombuffer(data, np.uint8, rows * columns * 3).reshape(rows, columns, 3).astype(float)
    return a[..., 0] * 65536 + a[..., 1] * 256 + a[..., 2] if packed else a


def write_pgm(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.clip(a * 255, 0, 255).astype(np.uint8).tobytes()


def write_ppm(a: np.ndarray, deep: bool = False) -> bytes:
    return b"P6\n%d %d\n%d\n" % (a.shape[1], a.shape[0], 65535 if deep else 255) + a.astype(">u2" if deep else np.uint8).tobytes()


def write_bank(a: np.ndarray) -> bytes:
    """Rows, columns and channels as 32-bit integers, then 32-bit floats."""
    return struct.pack("<iii", *a.shape) + a.astype("<f4").tobytes()


def parse_bank(data: bytes) -> np.ndarray:
    shape = struct.unpack_from("<iii", data)
    return np.frombuffer(data, "<f4", int(np.prod(shape)), 12).reshape(shape).astype(float)


# Element and array class codes of the MAT 5 format.
MI = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MI_MATRIX, MI_COMPRESSED, MI_UTF8, MI_UTF16, MI_UTF32 = 14, 15, 16, 17, 18
MX_CELL, MX_STRUCT, MX_CHAR = 1, 2, 4


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """(type, payload, where the next one starts). Small elements keep up to 4 bytes in their tag."""
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    end = at + 8 + size
    return kind, data[at + 8 : end], end if kind == MI_COMPRESSED else end + (-size % 8)


def _numbers(kind: int, payload: bytes, order: str) -> np.ndarray:
    return np.frombuffer(payload, order + MI[kind])


def _matrix(data: bytes, order: str) -> tuple[str, object]:
    _, flags, at = _element(data, 0, order)
    klass, bits = flags[0 if order == "<" else 3], flags[1 if order == "<" else 2]
    kind, payload, at = _element(data, at, order)
    dims = [int(x) for x in _numbers(kind, payload, order)]
    _, name, at = _element(data, at, order)

    def part(at: int) -> tuple[object, int]:
        _, payload, at = _element(data, at, order)
        return (_matrix(payload, order)[1] if payload else np.zeros((0, 0))), at

    n = int(np.prod(dims))
    if klass == MX_CELL:
        value = []
        for _ in range(n):
            v, at = part(at)
            value.append(v)
    elif klass == MX_STRUCT:
        kind, payload, at = _element(data, at, order)
        length = int(_numbers(kind, payload, order)[0])
        _, payload, at = _element(data, at, order)
        fields = [payload[i : i + length].split(b"\0")[0].decode() for i in range(0, len(payload), length)]
        value = []
        for _ in range(n):
            row = {}
            for f in fields:
                row[f], at = part(at)
            value.append(row)
    elif klass == MX_CHAR:
        kind, payload, at = _element(data, at, order)
        text = payload.decode({MI_UTF8: "utf-8", MI_UTF16: "utf-16-le" if order == "<" else "utf-16-be", MI_UTF32: "utf-32-le"}.get(kind, "latin-1")) if kind in (MI_UTF8, MI_UTF16, MI_UTF32) else "".join(map(chr, _numbers(kind, payload, order)))
        value = ["".join(text[i :: dims[0]]) for i in range(dims[0])]
    else:
        kind, payload, at = _element(data, at, order)
        value = _numbers(kind, payload, order).reshape(dims, order="F")
        if bits & 8:
            kind, payload, at = _element(data, at, order)
            value = value + 1j * _numbers(kind, payload, order).reshape(dims, order="F")
    return name.decode(), value


def parse_mat5(data: bytes) -> dict[str, object]:
    """All arrays of a MAT 5 file by name: numbers as arrays, text as lists of rows, cells as lists, structs as lists of dicts."""
    order = "<" if data[126:128] == b"IM" else ">"
    out, at = {}, 128
    while at + 8 <= len(data):
        kind, payload, at = _element(data, at, order)
        if kind == MI_COMPRESSED:
            kind, payload, _ = _element(zlib.decompress(payload), 0, order)
        if kind == MI_MATRIX:
            name, value = _matrix(payload, order)
            out[name] = value
    return out


#: Class code, element code and type of the numbers that arrays are written as.
MX_NUMBERS = {"f8": (6, 9), "f4": (7, 7), "i1": (8, 1), "u1": (9, 2), "i2": (10, 3), "u2": (11, 4), "i4": (12, 5), "u4": (13, 6)}


def _written(kind: int, payload: bytes, order: str) -> bytes:
    return struct.pack(order + "II", kind, len(payload)) + payload + b"\0" * (-len(payload) % 8)


def _array(name: str, value: object, order: str) -> bytes:
    """An array as a matrix element: text as characters, a list as cells, a dict as a struct, numbers (also complex and truth values) as they are."""
    bits, put = 0, lambda kind, payload: _written(kind, payload, order)
    if isinstance(value, str):
        klass, dims, body = MX_CHAR, (1, len(value)), put(4, np.array([ord(c) for c in value], order + "u2").tobytes())
    elif isinstance(value, list):
        klass, dims, body = MX_CELL, (1, len(value)), b"".join(_array("", v, order) for v in value)
    elif isinstance(value, dict):
        names = b"".join(k.encode().ljust(32, b"\0") for k in value)
        klass, dims, body = MX_STRUCT, (1, 1), put(5, np.array([32], order + "i4").tobytes()) + put(1, names) + b"".join(_array("", v, order) for v in value.values())
    else:
        a = np.atleast_2d(np.asarray(value))
        bits, dims = (8 if a.dtype.kind == "c" else 0) | (2 if a.dtype.kind == "b" else 0), a.shape
        sides = [a.real, a.imag] if a.dtype.kind == "c" else [a.astype("u1")] if a.dtype.kind == "b" else [a]
        code = sides[0].dtype.str[1:] if sides[0].dtype.str[1:] in MX_NUMBERS else "f8"
        klass, kind = MX_NUMBERS[code]
        body = b"".join(put(kind, x.astype(order + code).tobytes(order="F")) for x in sides)
    head = put(6, struct.pack(order + "II", bits << 8 | klass, 0)) + put(5, np.asarray(dims, order + "i4").tobytes()) + put(1, name.encode())
    return put(MI_MATRIX, head + body)


def write_mat5(arrays: dict[str, object], compressed: bool = False, order: str = "<") -> bytes:
    """Named arrays as a MAT 5 file: matrices of numbers, truth values or complex ones, text, lists as cells, dicts as structs."""
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    for name, value in arrays.items():
        whole = _array(name, value, order)
        if compressed:
            z = zlib.compress(whole)
            whole = struct.pack(order + "II", MI_COMPRESSED, len(z)) + z
        out += whole
    return out


def parse_bmp(data: bytes) -> np.ndarray | None:
    """Rows x columns x (blue, green, red), from the top row down, of a bitmap of 24 bits without compression; None for any other."""
    if data[:2] != b"BM":
        return None
    start, _, columns, rows, _, bits, compression = struct.unpack_from("<IIiiHHI", data, 10)
    if bits != 24 or compression:
        return None
    width = columns * 3 + (-columns * 3) % 4
    lines = np.frombuffer(data, np.uint8, abs(rows) * width, start).reshape(abs(rows), width)[:, : columns * 3].reshape(abs(rows), columns, 3)
    return lines[::-1] if rows > 0 else lines


def write_bmp(a: np.ndarray) -> bytes:
    """Rows x columns x (red, green, blue) as a bitmap of 24 bits: rows from the bottom up, blue first, each filled up to four bytes."""
    rows, columns, _ = a.shape
    lines = np.zeros((rows, columns * 3 + (-columns * 3) % 4), np.uint8)
    lines[:, : columns * 3] = a[::-1, :, ::-1].reshape(rows, columns * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + lines.size, 0, 0, 54, 40, columns, rows, 1, 24, 0, lines.size, 0, 0, 0, 0) + lines.tobytes()


def _text(value: str) -> bytes:
    """Text with its length in bytes before it, seven bits a byte, the lowest first."""
    data, n, out = value.encode(), len(value.encode()), b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out + data


def _read_text(data: bytes, at: int) -> tuple[str, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        at, shift, more = at + 1, shift + 7, data[at] > 127
        if not more:
            return data[at : at + n].decode(), at + n


NODE = struct.Struct("<Biif")


def write_histogram(name: str, nodes: list[tuple[int, int, int, float]]) -> bytes:
    """A tree histogram: its name, the number of nodes, and of each tree, place, leaf number and value."""
    return _text(name) + struct.pack("<i", len(nodes)) + b"".join(NODE.pack(*n) for n in nodes)


def parse_histograms(data: bytes) -> list[tuple[str, list[tuple[int, int, int, float]]]]:
    """All the histograms that follow each other in a file. What is left at the end, shorter than any, is passed over."""
    out, at = [], 0
    while at + 5 <= len(data):
        name, at = _read_text(data, at)
        (count,) = struct.unpack_from("<i", data, at)
        at += 4
        out.append((name, [NODE.unpack_from(data, at + NODE.size * k) for k in range(count)]))
        at += NODE.size * count
    return out


def write_labels(labels: list[tuple[int, str, int, int, int]]) -> bytes:
    """A label dictionary: the number of labels, and of each its number, name, red, green and blue."""
    return struct.pack("<i", len(labels)) + b"".join(struct.pack("<h", k) + _text(name) + bytes(rgb) for k, name, *rgb in labels)


def parse_labels(data: bytes) -> list[tuple[int, str, int, int, int]]:
    (count,), at, out = struct.unpack_from("<i", data), 4, []
    for _ in range(count):
        (k,) = struct.unpack_from("<h", data, at)
        name, at = _read_text(data, at + 2)
        out.append((k, name, *data[at : at + 3]))
        at += 3
    return out


def write_match(trees: int, levels: int, normalised: bool) -> bytes:
    """The settings of a pyramid match."""
    return struct.pack("<ii?", trees, levels, normalised)


def parse_match(data: bytes) -> tuple[int, int, bool]:
    return struct.unpack_from("<ii?", data)


def save_files(files: DataFrame, path: str) -> None:
    """Rows (name, content) as files of a folder that any store may hold, one a row, written by Spark's tasks.

    The bytes are kept as they are; a newline follows them, which ``scan_files`` takes off again.
    """
    files.select("name", F.col("content").cast("string").alias("value")).write.partitionBy("name").text(path)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, content) of a folder that ``save_files`` has written, by Spark's scan of whole files; the path is the name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.col("name").cast("string").alias("path"), F.expr("substring(content, 1, length(content) - 1)").alias("content"))


#: Most files of an archive, and bytes after which one is closed.
ARCHIVE_FILES, ARCHIVE_BYTES = 2000, 1 << 24


def save_archives(files: DataFrame, path: str) -> None:
    """Rows (path, content) as tar archives of a folder, so that the number of files to list and commit stays small.

    A task fills its archives one after the other, each up to ``ARCHIVE_FILES`` files or about ``ARCHIVE_BYTES``; it holds one at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        out, held, done = io.BytesIO(), 0, 0
        tar = tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT)

        def closed() -> pd.DataFrame:
            tar.close()
            return pd.DataFrame({"name": [f"archive-{TaskContext.get().partitionId()}-{done}"], "content": [out.getvalue()]})

        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                head = tarfile.TarInfo(name)
                head.size = len(content)
                tar.addfile(head, io.BytesIO(content))
                held += 1
                if held >= ARCHIVE_FILES or out.tell() >= ARCHIVE_BYTES:
                    yield closed()
                    out, held, done = io.BytesIO(), 0, done + 1
                    tar = tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT)
        if held:
            yield closed()

    save_files(files.select("path", "content").mapInPandas(run, "name string, content binary"), path)


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, content) of the files in the archives of a folder that ``save_archives`` has written."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:") as tar:
                    rows = [(head.name, tar.extractfile(head).read()) for head in tar]
                yield pd.DataFrame(rows, columns=["path", "content"])

    return scan_files(spark, path).mapInPandas(run, "path string, content binary")


def parsed(files: DataFrame, parse) -> DataFrame:
    """Rows (path, content) as tall rasters; files that ``parse`` gives None for have no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found, cells = [], 0
            for path, content in zip(f["path"], f["content"], strict=True):
                a = parse(bytes(content))
                if a is None:
                    continue
                found.append((path, a if a.ndim == 3 else a[..., None]))
                cells += a.size
                if cells >= BATCH_CELLS:
                    yield _tall(found)
                    found, cells = [], 0
            if found:
                yield _tall(found)

    return files.select("path", "content").mapInPandas(run, RASTER)


def written(images: DataFrame, write, prefix: str = "image") -> DataFrame:
    """Packed images (image_id, data, rows, columns) as rows (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": [f"{prefix}-{i}" for i in f["image_id"]], "content": [write(np.asarray(d, float).reshape(r, c)) for d, r, c in zip(f["data"], f["rows"], f["columns"], strict=True)]})

    return images.mapInPandas(run, "path string, content binary")
