"""Readers and writers with fixed schemas; nulls and column order survive a round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of unknown shape: one column ``payload`` of variants, a row for each file."""
    return spark.read.option("multiLine", True).option("singleVariantColumn", "payload").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, keys sorted, nulls written."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, with or without a byte order mark; numbers are cast where they are used."""
    t = spark.read.option("header", True).csv(path)
    t = t.withColumnsRenamed({c: c.lstrip("﻿") for c in t.columns})
    return t.select(*columns) if columns else t


def read_typed_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Columns with types: those of ``schema``, matched by the header, or else inferred from all rows. A cell that isn't of
    its type is an error; empty cells are null."""
    if not schema:
        return spark.read.option("header", True).option("inferSchema", True).option("mode", "FAILFAST").csv(path)
    t = read_csv(spark, path)
    fields = T.StructType.fromDDL(schema).fields
    return t.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Exactly these columns; further ones are an error."""
    if extra := set(df.columns) - set(columns):
        raise ValueError(f"columns outside the schema: {sorted(extra)}")
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def union_of_fields(frames: list[DataFrame]) -> DataFrame:
    """All rows with all columns in order of first sight, null where a table has no such column."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def summary_json(df: DataFrame) -> DataFrame:
    """Each row as compact JSON with sorted keys."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def publish(spark: SparkSession, tables: dict[str, DataFrame], schema: str, fmt: str = "parquet", partition_by: dict[str, list[str]] | None = None) -> None:
    """Create the schema and save each table in it, replacing what is there."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    for name, df in tables.items():
        w = df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
        if keys := (partition_by or {}).get(name):
            w = w.partitionBy(*keys)
        w.saveAsTable(f"{schema}.{name}")
