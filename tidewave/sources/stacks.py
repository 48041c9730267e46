"""TIFF stacks as a data source: ``spark.read.format("tiff_stack").load(path)`` gives pixels of all pages of all files under a path.

A file is cut into byte splits like any other source's. A task walks the page directories, which are small, and reads the strips that begin in its
split, so one stack of many pages is read by many tasks, and the driver lists files and opens none. Strips outside the options ``frames`` and
``rows`` are not read. These are options, not pushed filters: Spark 4.1 keeps a filter pushed to a Python source with the loaded frame,
so a second query on the same frame would miss what only the first one left out.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "tiff_stack"
SCHEMA = "seq string, file string, page int, frame long, y int, x int, intensity long"
#: Bytes of a file one task reads, unless the option ``split_bytes`` says otherwise.
SPLIT = 64 << 20

# Fixed values of the format: tags read, bytes and codes of the types of values, and the packings that are understood.
WIDTH, HEIGHT, BITS, PACKING, PLACES, CHANNELS, ROWS, LENGTHS, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
KINDS = {1: "B", 3: "H", 4: "I", 16: "Q"}
PLAIN, PACKBITS, DEFLATE = (1,), (32773,), (8, 32946)


@dataclass(frozen=True)
class Page:
    """A page: its number, shape, bits and the places, lengths and rows of its strips."""

    number: int
    width: int
    height: int
    bits: int
    packing: int
    predictor: int
    rows: int
    places: tuple[int, ...]
    lengths: tuple[int, ...]


def pages(file) -> Iterator[tuple[Page, str]]:
    """Every page of an open file in turn, with the byte order; classic and big files. Pixels are not read."""
    file.seek(0)
    start = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    kind = struct.unpack(order + "H", start[2:4])[0] if order and len(start) >= 8 else 0
    if kind not in (42, 43):
        raise ValueError("no TIFF file")
    big = kind == 43
    word, size, step, few = ("Q", 8, 20, 8) if big else ("I", 4, 12, 4)
    at = struct.unpack_from(order + word, start, 8 if big else 4)[0]
    number, seen = 0, set()
    while at:
        if at in seen:
            raise ValueError("the pages of the file form a ring")
        seen.add(at)
        file.seek(at)
        head = file.read(8 if big else 2)
        n = struct.unpack(order + ("Q" if big else "H"), head)[0]
        body = file.read(n * step + size)
        tags = {}
        for k in range(n):
            tag, form, count = struct.unpack_from(order + "HH" + word, body, k * step)
            if form in KINDS:
                length = struct.calcsize(KINDS[form]) * count
                raw = body[k * step + step - few : k * step + step]
                if length > few:
                    file.seek(struct.unpack(order + word, raw)[0])
                    raw = file.read(length)
                tags[tag] = struct.unpack(f"{order}{count}{KINDS[form]}", raw[:length])
        one = lambda tag, default: tags.get(tag, (default,))[0]
        if one(CHANNELS, 1) != 1 or one(BITS, 1) not in (8, 16, 32) or PLACES not in tags:
            raise ValueError(f"page {number}: only strips of one channel of 8, 16 or 32 bits are read")
        if one(PACKING, 1) not in PLAIN + PACKBITS + DEFLATE:
            raise ValueError(f"page {number}: packing {one(PACKING, 1)} is not read")
        height = one(HEIGHT, 0)
        yield Page(number, one(WIDTH, 0), height, one(BITS, 1), one(PACKING, 1), one(PREDICTOR, 1), min(one(ROWS, height), height) or 1, tags[PLACES], tags[LENGTHS]), order
        at = struct.unpack_from(order + word, body, n * step)[0]
        number += 1


def unpackbits(raw: bytes) -> bytes:
    """Runs and literal stretches of the byte packing; a count of -128 says nothing."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at] - 256 if raw[at] > 127 else raw[at]
        if n >= 0:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > -128:
                out += raw[at + 1 : at + 2] * (1 - n)
            at += 2 if n > -128 else 1
    return bytes(out)


def strip(page: Page, order: str, k: int, raw: bytes) -> np.ndarray:
    """Rows of strip ``k`` as numbers."""
    raw = zlib.decompress(raw) if page.packing in DEFLATE else unpackbits(raw) if page.packing in PACKBITS else raw
    rows = min(page.rows, page.height - k * page.rows)
    pixels = np.frombuffer(raw, f"{order}u{page.bits // 8}", rows * page.width).reshape(rows, page.width)
    if page.predictor == 2:  # each pixel holds its difference to the one on its left
        pixels = np.cumsum(pixels, axis=1, dtype=np.uint64).astype(f"u{page.bits // 8}")
    return pixels


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__((self.path, self.start, self.end))


def spans(text: str | None) -> list[tuple[int, int]]:
    """Spans of whole numbers written as ``3,7-9``, ends included; None for all."""
    if text is None:
        return [(-(1 << 62), 1 << 62)]
    parts = [re.fullmatch(r"\s*(-?\d+)\s*(?:-\s*(-?\d+))?\s*", part) for part in text.split(",")]
    if not all(parts):
        raise ValueError(f"no list of spans: {text!r}")
    return [(int(p[1]), int(p[2] or p[1])) for p in parts]


def meets(held: list[tuple[int, int]], first: int, last: int) -> bool:
    return any(first <= high and last >= low for low, high in held)


class StackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT))
        self.glob, self.pattern = re.compile(options.get("name", r"\.tiff?$"), re.I), re.compile(options.get("frame", r"t(\d+)\.tiff?$"), re.I)
        self.frames, self.rows = spans(options.get("frames")), spans(options.get("rows"))

    def partitions(self) -> list[Split]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and self.glob.search(f.base_name))
        # The last split has no end, so that a strip said to lie behind the file fails instead of being in no split.
        splits = [Split(path, at, at + self.split if at + self.split < size else 1 << 63) for path, size in files for at in range(0, max(size, 1), self.split)]
        return splits or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        name = self.pattern.search(split.path.rsplit("/", 1)[-1])
        first = int(name[1]) if name else 0
        with store.open_input_file(split.path) as file:
            for page, order in pages(file):
                frame = first + page.number
                if not meets(self.frames, frame, frame):
                    continue
                for k, (place, length) in enumerate(zip(page.places, page.lengths)):
                    top = k * page.rows
                    if split.start <= place < split.end and meets(self.rows, top, min(top + page.rows, page.height) - 1):
                        file.seek(place)
                        pixels = strip(page, order, k, file.read(length))
                        y, x = np.indices(pixels.shape)
                        keep = np.array([meets(self.rows, v, v) for v in range(top, top + len(pixels))])[:, None] & np.ones(page.width, bool)
                        n = int(keep.sum())
                        whole = lambda v, t: pa.array(np.full(n, v), t)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([split.path.rpartition("/")[0]] * n), pa.array([split.path] * n), whole(page.number, pa.int32()), whole(frame, pa.int64()), pa.array((y + top)[keep], pa.int32()), pa.array(x[keep], pa.int32()), pa.array(pixels[keep].astype(np.int64))],
                            names=[c.split()[0] for c in SCHEMA.split(", ")],
                        )


class TiffStack(DataSource):
    """Options: ``frames`` and ``rows`` (y), as ``3,7-9``; ``split_bytes``; ``name``, a pattern of file names; ``frame``, a pattern whose group is the frame of a file's first page (else 0)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StackReader:
        return StackReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session."""
    spark.dataSource.register(TiffStack)
