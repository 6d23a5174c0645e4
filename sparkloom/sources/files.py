"""JSON lines, JSON catalogues, CSV audits and manifests of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of JSON lines.  Blank lines are skipped; a line that isn't JSON is an error that names its file."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("__file", F.col("_metadata.file_path"))
    parsed = lines.withColumn("__v", F.try_parse_json("value"))
    bad = parsed.where(F.col("__v").isNull()).select("__file", "value").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]}: not JSON: {bad[0][1][:80]}")
    return lines.select(F.from_json("value", _struct(schema)).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> int:
    """Writes rows as JSON lines, and returns how many; fails if the folder is there."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(path)
    return seen.get["n"]


def read_catalog(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of one JSON file that is an array or {"data": [...]}, or of JSON lines; what isn't an object is dropped."""
    struct = _struct(schema)
    whole = spark.read.text(path, wholetext=True).select(F.col("value"))
    head = whole.select(F.substr(F.ltrim("value"), F.lit(1), F.lit(1)).alias("c"), F.get_json_object("value", "$.data").alias("d")).first()
    if head is None:
        return spark.createDataFrame([], struct)
    if head.c == "[" or head.d is not None:
        listed = F.col("value") if head.c == "[" else F.get_json_object("value", "$.data")
        return whole.select(F.explode(F.from_json(listed, T.ArrayType(struct))).alias("r")).where("r is not null").select("r.*")
    return read_jsonl(spark, path, struct)


def union_sources(frames: list[DataFrame], formats: list[str] | None = None) -> DataFrame:
    """All rows by column name; with formats, those of these formats."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out if formats is None else out.where(F.lower("format").isin(*(f.lower() for f in formats)))


def write_audit(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The path modified last among those that match."""
    row = spark.read.format("binaryFile").load(pattern).agg(F.max_by("path", "modificationTime")).first()
    return row[0] if row else None


def key_presence(rows: DataFrame, column: str) -> DataFrame:
    """key, n: how many JSON texts have each top-level key."""
    return rows.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def write_vectors(df: DataFrame, path: str, parts: list[str]) -> None:
    """An immutable checkpoint of vectors: one folder for each seed and representation."""
    df.write.mode("errorifexists").partitionBy(*parts).parquet(path)


def checked_vectors(spark: SparkSession, path: str, key: str, vector: str, dims: int) -> DataFrame:
    """Vectors whose length and components are as promised; reading any other fails."""
    rows = spark.read.parquet(path)
    fine = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    return rows.withColumn(vector, F.when(fine & F.col(key).isNotNull(), F.col(vector)).otherwise(F.raise_error(F.lit("bad vector")).cast(rows.schema[vector].dataType)))
