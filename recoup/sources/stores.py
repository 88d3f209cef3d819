"""Text and columnar stores: semicolon CSV with decimal comma, parquet tables, models, catalog."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared folder."""
    return os.path.join(shared_dir(spark), spark.sparkContext.applicationId,
                        f"{name}-{uuid.uuid4().hex}")


def decimal_comma(x: Column) -> Column:
    """A double as text with a decimal comma and never an exponent."""
    plain = x.cast("string")
    wide = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    return F.regexp_replace(F.when(plain.contains("E"), wide).otherwise(plain), r"\.", ",")


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    text = [decimal_comma(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema]
    df.select(*text).write.csv(path, sep=sep, header=True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";") -> DataFrame:
    """Read the same dialect back; the schema is given, never inferred."""
    raw = T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DoubleType) else f.dataType)
        for f in schema])
    df = spark.read.csv(path, sep=sep, header=True, schema=raw)
    return df.select(*[
        F.regexp_replace(f.name, ",", ".").cast("double").alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in schema])


def round_trip(df: DataFrame, name: str) -> DataFrame:
    """Write compressed parquet and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_tables(spark: SparkSession, frames: dict[str, DataFrame]) -> str:
    """Save several result tables under one folder."""
    folder = scratch(spark, "tables")
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}")
    return folder


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def list_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """Row count and column list of registered tables, one aggregate per table."""
    present = {t.name for t in spark.catalog.listTables()}
    out = None
    for n in names:
        if n not in present:
            continue
        df = spark.table(n)
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(n).alias("name"), "rows", F.lit(len(df.columns)).alias("n_columns"),
            F.lit(",".join(df.columns)).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out
