"""Multi-page TIFF stacks through the data source: packings, big files, splits over tasks, and strips that filters leave unread."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.sources import stacks


def pack(raw: bytes) -> bytes:
    """Byte packing with a run wherever a byte repeats."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = 1
        while at + n < len(raw) and raw[at + n] == raw[at] and n < 128:
            n += 1
        out += bytes([257 - n, raw[at]]) if n > 1 else bytes([0, raw[at]])
        at += n
    return bytes(out)


def stack(images, order="<", packing=1, rows=2, big=False, predictor=1, lost=()):
    """A stack of pages; strips of the pages in ``lost`` point behind the end of the file."""
    word, size, few = ("Q", 8, 8) if big else ("I", 4, 4)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HHQ", 8, 0, 0) if big else struct.pack(order + "I", 0)))
    link = 8 if big else 4
    for number, image in enumerate(images):
        places, lengths = [], []
        for top in range(0, len(image), rows):
            part = image[top : top + rows]
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype))
            raw = part.astype(f"{order}u{image.itemsize}").tobytes()
            raw = zlib.compress(raw) if packing == 8 else pack(raw) if packing == 32773 else raw
            places.append(1 << 30 if number in lost else len(out))
            lengths.append(len(raw))
            out += raw
        lists = []
        for values in (places, lengths):
            lists.append(len(out))
            out += struct.pack(f"{order}{len(values)}{word}", *values)
        kind = 16 if big else 4
        tags = [(256, 3, 1, image.shape[1]), (257, 3, 1, image.shape[0]), (258, 3, 1, 8 * image.itemsize), (259, 3, 1, packing), (273, kind, len(places), lists[0] if len(places) > 1 else places[0]), (277, 3, 1, 1), (278, 3, 1, rows), (279, kind, len(places), lists[1] if len(places) > 1 else lengths[0]), (317, 3, 1, predictor)]
        at = len(out)
        out[link : link + size] = struct.pack(order + word, at)
        out += struct.pack(order + ("Q" if big else "H"), len(tags))
        for tag, form, count, value in tags:
            held = struct.pack(order + "H", value) if form == 3 else struct.pack(order + word, value)
            out += struct.pack(order + "HH" + word, tag, form, count) + held.ljust(few, b"\0")
        link = len(out)
        out += struct.pack(order + word, 0)
    return bytes(out)


@pytest.fixture
def read(spark):
    stacks.register(spark)
    return lambda path, **options: spark.read.format(stacks.NAME).options(**options).load(str(path))


def values(rows):
    return {(r.frame, r.y, r.x): r.intensity for r in rows.collect()}


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("packing, predictor", [(1, 1), (8, 1), (8, 2), (32773, 1)])
@pytest.mark.parametrize("big", [False, True])
def test_packings(read, tmp_path, order, packing, predictor, big):
    rng = np.random.default_rng(0)
    images = [(rng.integers(0, 4, (5, 7)) * 9000).astype(np.uint16) for _ in range(3)]
    (tmp_path / "a_t4.tif").write_bytes(stack(images, order, packing, 2, big, predictor))
    assert values(read(tmp_path)) == {(4 + t, y, x): int(images[t][y, x]) for t in range(3) for y in range(5) for x in range(7)}


def test_many_tasks_read_one_stack(read, tmp_path):
    images = [np.full((8, 32), t, np.uint8) for t in range(100)]
    (tmp_path / "s.TIF").write_bytes(stack(images, rows=4))
    rows = read(tmp_path, split_bytes=2048)
    got = rows.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("frames")).collect()
    assert sum(r.n for r in got) == 100 * 8 * 32 and len(got) > 10 and max(r.frames for r in got) < 20
    assert rows.groupBy("frame").agg(F.min("intensity").alias("lo"), F.max("intensity").alias("hi"), F.count("*").alias("n")).filter("lo <> frame OR hi <> frame OR n <> 256").count() == 0


def test_pages_and_strips_left_out_are_not_read(read, tmp_path):
    """Strips of the other pages lie behind the end of the file: to read one is to fail."""
    images = [np.full((4, 4), t, np.uint16) for t in range(30)]
    (tmp_path / "s_t100.tif").write_bytes(stack(images, packing=8, lost=set(range(30)) - {3, 7, 8}))
    assert {k[0] for k in values(read(tmp_path, frames="103, 107"))} == {103, 107}
    assert {k[0] for k in values(read(tmp_path, frames="107-108"))} == {107, 108}
    assert values(read(tmp_path, frames="103", rows="2-9")) == {(103, y, x): 3 for y in (2, 3) for x in range(4)}
    assert values(read(tmp_path, frames="103", rows="1")) == {(103, 1, x): 3 for x in range(4)}
    assert read(tmp_path, frames="5").count() == 0
    rows = read(tmp_path, frames="103-108").filter("frame <> 104 AND frame < 104")
    with pytest.raises(Exception):
        rows.count()
    with pytest.raises(Exception):
        read(tmp_path).count()
    with pytest.raises(ValueError):
        stacks.spans("3,x")


def test_wrong_files_fail_and_none_is_no_row(read, tmp_path):
    assert read(tmp_path).count() == 0
    (tmp_path / "x.tif").write_bytes(b"none at all of it")
    with pytest.raises(Exception, match="no TIFF file"):
        read(tmp_path).count()
    with pytest.raises(Exception):
        read(tmp_path / "missing").count()
