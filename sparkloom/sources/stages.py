"""Write-once stages with a record of what they were made from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def stage(df: DataFrame, path: str, config: dict, inputs: dict[str, str] | None = None) -> str:
    """Writes df and its manifest under path, which mustn't be there yet; returns the stage's digest."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    record = {"config": config, "inputs": inputs or {}, "schema": df.schema.jsonValue()}
    row = df.sparkSession.range(1).select(F.lit(json.dumps(record, sort_keys=True)).alias("record"), F.lit(digest(record)).alias("digest"))
    row.write.mode("errorifexists").parquet(f"{path}/manifest")
    return digest(record)


def validated(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stage whose manifest is intact."""
    row = spark.read.parquet(f"{path}/manifest").first()
    record = json.loads(row["record"])
    if digest(record) != row["digest"]:
        raise ValueError(f"{path}: its manifest was changed")
    rows = spark.read.parquet(f"{path}/rows")
    if [f["name"] for f in record["schema"]["fields"]] != rows.columns:
        raise ValueError(f"{path}: its columns were changed")
    return rows


def disjoint(output: str, protected: list[str]) -> None:
    """Fails if the output lies in a protected folder, or one in it."""
    own = output.rstrip("/") + "/"
    for p in protected:
        other = p.rstrip("/") + "/"
        if own.startswith(other) or other.startswith(own):
            raise ValueError(f"{output} overlaps {p}")


def pending(expected: DataFrame, completed: DataFrame) -> DataFrame:
    return expected.subtract(completed)
