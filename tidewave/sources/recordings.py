"""Recordings on disk: folders, frames as TIFF files, snapshots, the list of sequences and settings as JSON."""

from __future__ import annotations

import dataclasses
import json
import logging
import struct

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEQUENCES = "path string, date string, image_sequence string, experiment_type string, condition string, confluency long, concentration string, time string"


def folders(spark: SparkSession, root: str, name: str = "IS[^/]*", without: str = "Output") -> DataFrame:
    """(folder) of all folders below ``root`` whose name matches, none inside ``without``, in the order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    found = files.select(F.regexp_extract("path", rf"^(.*/{name})/", 1).alias("folder")).filter((F.col("folder") != "") & ~F.col("folder").contains(f"/{without}/") & ~F.col("folder").endswith(f"/{without}"))
    return found.distinct().orderBy("folder")


def decode_tiff(data: bytes) -> np.ndarray:
    """The first image of a baseline TIFF file: one uncompressed channel of 8 or 16 bits, in strips."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags, sizes = {}, {1: 1, 2: 1, 3: 2, 4: 4}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind in sizes:
            size, place = sizes[kind] * count, at + 10 + 12 * k
            if size > 4:
                place = struct.unpack(order + "I", data[place : place + 4])[0]
            tags[tag] = struct.unpack(f"{order}{count}{'BBHI'[kind - 1]}", data[place : place + size])
    # The tags of width, height, bits, compression, strip places, channels, strip sizes.
    width, height, bits, packed, starts, channels, lengths = (tags.get(t, d) for t, d in ((256, ()), (257, ()), (258, (1,)), (259, (1,)), (273, ()), (277, (1,)), (279, ())))
    if packed[0] != 1 or channels[0] != 1 or bits[0] not in (8, 16) or not starts:
        raise ValueError("only uncompressed images of one channel of 8 or 16 bits are read")
    raw = b"".join(data[s : s + n] for s, n in zip(starts, lengths))
    return np.frombuffer(raw, f"{order}u{bits[0] // 8}", width[0] * height[0]).reshape(height[0], width[0])


def frames(spark: SparkSession, root: str, glob: str = "*.TIF", pattern: str = r"t(\d+)\.TIF$") -> DataFrame:
    """(seq, frame, y, x, intensity) of all frames below ``root``: the sequence is the file's folder, the frame the number in its name. Files that cannot be read fail."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("seq"), F.regexp_extract("path", pattern, 1).try_cast("int").alias("frame"), "content")

    def pixels(batches):
        for pdf in batches:
            for seq, frame, content in zip(pdf["seq"], pdf["frame"], pdf["content"]):
                image = decode_tiff(content)
                y, x = np.indices(image.shape)
                yield pd.DataFrame({"seq": seq, "frame": frame, "y": y.ravel(), "x": x.ravel(), "intensity": image.ravel().astype(np.int64)})

    return named.mapInPandas(pixels, "seq string, frame int, y long, x long, intensity long")


def save_snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The snapshot at ``path``; where there is none, a warning and an empty table. Nothing is ever unpickled."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        logging.getLogger(__name__).warning("no snapshot at %s", path)
        return spark.createDataFrame([], schema)


def sequences(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The list of image sequences, given inline as dictionaries; fields left out are null, unknown ones fail."""
    names = [f.split()[0] for f in SEQUENCES.split(", ")]
    for e in entries:
        if unknown := set(e) - set(names):
            raise ValueError(f"unknown fields {sorted(unknown)}")
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], SEQUENCES)


def write_settings(settings, path: str) -> None:
    """A dataclass of settings as JSON, nested ones included."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(dataclasses.asdict(settings), f, indent=1)


def read_settings(kind, path: str):
    """Settings of the dataclass ``kind`` from JSON; fields left out keep their defaults, unknown ones fail."""

    def build(kind, held: dict):
        fields = {f.name: f for f in dataclasses.fields(kind)}
        if unknown := set(held) - set(fields):
            raise ValueError(f"unknown settings {sorted(unknown)}")
        inner = {n: dataclasses.is_dataclass(f.default) and type(f.default) for n, f in fields.items()}
        return kind(**{n: build(inner[n], v) if inner[n] and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for n, v in held.items()})

    with open(path, encoding="utf-8") as f:
        return build(kind, json.load(f))
