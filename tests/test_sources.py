"""Frames, folders, snapshots and settings on files written by the tests."""

import struct

import numpy as np
import pytest

from tidewave.functions.detrend import Minima
from tidewave.sources import exports, recordings


def tiff(image: np.ndarray, order: str = "<") -> bytes:
    """A baseline file of two strips."""
    data, bits = image.astype(f"{order}u{image.itemsize}").tobytes(), 8 * image.itemsize
    half = len(data) // 2
    tags = [(256, 3, 1, image.shape[1]), (257, 3, 1, image.shape[0]), (258, 3, 1, bits), (259, 3, 1, 1), (273, 4, 2, 200), (277, 3, 1, 1), (279, 4, 2, 208)]
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags))
    for tag, kind, count, value in tags:
        head += struct.pack(order + "HHI", tag, kind, count) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    return head.ljust(200, b"\0") + struct.pack(order + "IIII", 300, 300 + half, half, len(data) - half) + b"\0" * 84 + data


@pytest.mark.parametrize("order", "<>")
def test_tiff(order):
    for kind in (np.uint8, np.uint16):
        image = np.arange(24, dtype=kind).reshape(4, 6) * 9
        assert np.array_equal(recordings.decode_tiff(tiff(image, order)), image)
    with pytest.raises(ValueError):
        recordings.decode_tiff(b"none")


def test_frames_and_folders(spark, tmp_path):
    image = np.arange(6, dtype=np.uint16).reshape(2, 3)
    for folder in ("a/IS2", "a/IS1", "a/IS1/Output"):
        (tmp_path / folder).mkdir(parents=True)
        for t in (2, 10):
            (tmp_path / folder / f"x_t{t}.TIF").write_bytes(tiff(image + t))
    rows = recordings.frames(spark, f"{tmp_path}/a/IS2").collect()
    assert len(rows) == 12 and {(r.frame, r.y, r.x): r.intensity for r in rows}[10, 1, 2] == 15
    assert [r.folder.rsplit("/", 1)[1] for r in recordings.folders(spark, str(tmp_path)).collect()] == ["IS1", "IS2"]


def test_snapshots(spark, tmp_path):
    recordings.save_snapshot(spark.range(3), f"{tmp_path}/s")
    assert recordings.load_snapshot(spark, f"{tmp_path}/s", "id long").count() == 3
    assert recordings.load_snapshot(spark, f"{tmp_path}/none", "id long").count() == 0


def test_settings(tmp_path):
    path = f"{tmp_path}/s.json"
    recordings.write_settings(Minima(order=7), path)
    assert recordings.read_settings(Minima, path) == Minima(order=7)
    (tmp_path / "s.json").write_text('{"wrong": 1}')
    with pytest.raises(ValueError):
        recordings.read_settings(Minima, path)


def test_sequences_and_merged_tables(spark):
    rows = recordings.sequences(spark, [{"path": "p", "date": "2024", "image_sequence": "IS1"}])
    assert exports.experiments_table(rows).first().dataset == "2024_IS1"
    with pytest.raises(ValueError):
        recordings.sequences(spark, [{"colour": "red"}])
    with pytest.raises(ValueError):
        exports.merge({"a": None}, rows)


def test_tables_have_their_columns(spark):
    e = spark.createDataFrame([(1, "SequentialEvent", 3, 9, 6, 4)], "event long, kind string, onset long, last long, duration long, n_cells long")
    out = exports.events_table(e, exports.Units(rate=2.0))
    row = out.first()
    assert len(out.columns) == 27 and row["Event onset time (s)"] == 51.5 and row["Event duration (s)"] == 3.0 and row["DAG depth"] is None
