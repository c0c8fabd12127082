"""Running sums and maxima in an order, also over single keys of more rows than a task can hold.

Plain windows put a key in one task. With huge, rows are dealt by ranges of key and order into as many parts as there are
shuffle partitions; each part runs over its own rows, and what all earlier parts of a key hold is carried into it. A key has
at most one row of totals a part, so the carried table has parts plus keys rows; only keys that span parts need it, at most
two a part, so that is what is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

_WHOLE = {"sum": F.sum, "max": F.max}
_JOINED = {"sum": lambda own, carried: F.when(own.isNull(), carried).when(carried.isNull(), own).otherwise(own + carried), "max": lambda own, carried: F.greatest(own, carried)}


class Scan:
    """df with running values. key: a column's name; order: columns that leave no ties within a key."""

    def __init__(self, df: DataFrame, key: str, order: list[str], huge: bool = False):
        self.key, self.order, self.huge, self.df = key, order, huge, df
        if huge:
            parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            self.df = cut(df.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), "ranges")

    def add(self, before: bool = False, **values: tuple[str, Column]) -> Scan:
        """Adds columns, name=("sum" or "max", value), over all rows up to each row, itself included unless before is
        set. Nulls are passed over; before the first value they are null."""
        end = -1 if before else Window.currentRow
        keys = ["_part", self.key] if self.huge else [self.key]
        rows = Window.partitionBy(*keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, end)
        own = self.df.withColumns({n: _WHOLE[kind](value).over(rows) for n, (kind, value) in values.items()})
        if self.huge:
            earlier = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
            totals = self.df.groupBy(F.col(self.key).alias("_key"), F.col("_part").alias("_p")).agg(*[_WHOLE[kind](value).alias(f"_{n}") for n, (kind, value) in values.items()])
            carried = totals.withColumns({f"_{n}": _WHOLE[kind](f"_{n}").over(earlier) for n, (kind, _) in values.items()}).withColumn("_first", F.min("_p").over(Window.partitionBy("_key"))).where("_p > _first").drop("_first")
            own = own.join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & F.col(self.key).eqNullSafe(F.col("_key")), "left")
            own = own.withColumns({n: _JOINED[kind](F.col(n), F.col(f"_{n}")) for n, (kind, _) in values.items()}).drop("_key", "_p", *[f"_{n}" for n in values])
        self.df = own
        return self

    def done(self) -> DataFrame:
        return self.df.drop("_part")
