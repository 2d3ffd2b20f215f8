"""File sources: strict and tolerant JSON lines, format by suffix, and sinks with the matching layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Strict JSON lines (gzip by suffix): a bad line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def jsonl_tolerant(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good rows, issues): issues have kind (malformed or non_object), the file and the text of the line. Blank lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    lines = lines.withColumn("v", F.try_parse_json("value"))
    kind = F.when(F.col("v").isNull(), "malformed").when(~F.schema_of_variant("v").startswith("OBJECT"), "non_object")
    lines = lines.withColumn("kind", kind)
    good = lines.where("kind IS NULL").select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")
    return good, lines.where("kind IS NOT NULL").select("kind", "file", "value")


def rows(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """By suffix: .jsonl(.gz), .csv (all strings), .parquet or .pq; anything else is a JSON array of objects."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    name = path.lower().rstrip("/")
    if name.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if name.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=False)
    return reader.json(path, multiLine=not name.endswith((".jsonl", ".jsonl.gz")))


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.select(*sorted(df.columns)).write.json(path, compression="gzip" if gzip else "none")


def write_csv(df: DataFrame, path: str, preferred: list[str] = ()) -> None:
    """Preferred columns first, the rest in their order."""
    df.select(*preferred, *(c for c in df.columns if c not in preferred)).write.csv(path, header=True)
