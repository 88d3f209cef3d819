"""Schemas and record batches for functions that run inside tasks."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def schemas(fields: list[tuple[str, T.DataType]]) -> tuple[T.StructType, pa.Schema]:
    """The same columns for Spark and for Arrow."""
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return schema, to_arrow_schema(schema)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with the columns in the schema's order and types."""
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def fresh(name: str, columns: list[str]) -> str:
    """The name, or a longer one that none of the columns has (whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
