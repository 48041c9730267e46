"""Recording tables as CSV or Parquet files, and frame files named by their frame number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """CSV files with a header, one a dataset, with their label as ``dataset``. Types come from ``schema`` and are never inferred."""
    out = None
    for label, path in paths.items():
        part = spark.read.schema(schema).option("header", True).csv(path).withColumn("dataset", F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset is named")
    return out


def write_csv(rows: DataFrame, path: str) -> None:
    """Arrays are written as JSON, which ``json_list`` reads back."""
    columns = [F.to_json(c.name).alias(c.name) if c.dataType.typeName() == "array" else F.col(f"`{c.name}`") for c in rows.schema]
    rows.select(columns).write.mode("overwrite").option("header", True).csv(path)


def write_dataset(rows: DataFrame, path: str) -> None:
    """Parquet, one folder a dataset; a write replaces only the datasets it holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def json_list(column: str):
    """Whole numbers held as a JSON list, a comma list or one number; anything else is null, blanks are an empty list."""
    text = F.trim(F.col(column))
    bare = F.regexp_replace(text, r"^\[|\]$", "")
    parts = F.transform(F.split(bare, ","), lambda p: F.trim(p))
    good = bare.rlike(r"^\s*-?\d+(\s*,\s*-?\d+)*\s*$")
    return F.when(text.isNull(), None).when(F.trim(bare) == "", F.array().cast("array<long>")).when(good, F.transform(parts, lambda p: p.try_cast("long")))


def frame_number(path: str, pattern: str = r"t(\d+)\.TIF$"):
    """The frame number in a file's path, null if it has none; files need no renaming to sort in time."""
    return F.regexp_extract(path, pattern, 1).try_cast("int")
