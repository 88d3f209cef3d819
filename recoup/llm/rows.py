"""Rows of their own: what names a row where several share an id."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def own_rows(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A column that names each row of ``docs``: its id, or, if any id (null included) has several
    texts, the id with a hash of the text, in this order. What an operator finds in a row follows from
    its id and text, so rows that share both may share a name. ``named`` gives the id back."""
    if not docs.groupBy(F.col(id_col).alias("d")).count().where("count > 1").limit(1).count():  # without reading the texts
        return F.col(id_col)
    shared = docs.groupBy(F.col(id_col).alias("d")).agg(F.min(F.xxhash64(text_col)).alias("a"), F.max(F.xxhash64(text_col)).alias("b")).where("a <> b")
    if shared.limit(1).count():
        return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    return F.col(id_col)


def named(df: DataFrame, name: str, id_type: T.DataType) -> Column:
    """The id behind the names in column ``name``, whichever kind they are."""
    return F.col(name) if df.schema[name].dataType == id_type else F.col(f"{name}.id")
