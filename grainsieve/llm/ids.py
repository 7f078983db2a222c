"""Ids of any type as 64-bit numbers, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType

from grainsieve.llm.store import written


class Ids:
    """The numbers that stand for the values of a column.

    Whole numbers stand for themselves. Other values (strings, decimals, dates, ...) are numbered in
    their order by a written table, which is joined to find them again: numbers compare as the
    values do, so that the smallest stays the smallest.
    """

    def __init__(self, table: DataFrame, column: str):
        self.kind: DataType = table.schema[column].dataType
        self.column = column
        self.names = None
        if not isinstance(self.kind, (ByteType, ShortType, IntegerType, LongType)):
            values = table.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct()
            self.names = written(values.orderBy("value").select("value", F.monotonically_increasing_id().alias("id")), "ids")

    def rows(self, table: DataFrame, *columns: str | object) -> DataFrame:
        """``id`` and the columns, of the rows whose id isn't null."""
        at = F.col(f"`{self.column}`")
        if self.names is None:
            return table.select(at.cast("long").alias("id"), *columns).where("id is not null")
        out = table.select(at.alias("value"), *columns).join(self.names, "value").drop("value")
        return out.select("id", *[c for c in out.columns if c != "id"])

    def back(self, table: DataFrame, **names: str) -> DataFrame:
        """``table`` with the numbers of ``names`` (column = new name) as the values that they stand for."""
        order = [names.get(c, c) for c in table.columns]
        for column, name in names.items():
            if self.names is None:
                table = table.withColumn(column, F.col(column).cast(self.kind)).withColumnRenamed(column, name)
            else:
                known = self.names.select(F.col("id").alias(column), F.col("value").alias("__value"))
                table = table.join(known, column).drop(column).withColumnRenamed("__value", name)
        return table.select(*[F.col(f"`{c}`") for c in order])
