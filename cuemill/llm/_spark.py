"""Helpers of this subpackage that touch the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut, table

__all__ = ["body", "cut", "schema_of", "shuffle_partitions", "small", "table", "with_body"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is, for a shuffled join. df should be cheap
    to compute or written already: its rows are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def schema_of(df: DataFrame, keep: list[str], more: str) -> T.StructType:
    """The fields of df named in keep, then those of a DDL string."""
    return T.StructType([*[df.schema[c] for c in keep], *T.StructType.fromDDL(more).fields])


def body(batch, text: str):
    """The texts of an Arrow batch: a column, or a field of a struct column ("column.field")."""
    column, _, field = text.partition(".")
    return batch[column].field(field) if field else batch[column]


def with_body(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    """The columns in keep with the texts, and where body() finds them. A field of a kept struct is not sent twice."""
    if text.partition(".")[0] in keep and "." in text:
        return df.select(*keep), text
    return df.select(*keep, F.col(text).alias("_text")), "_text"
