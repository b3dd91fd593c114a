"""Numbering rows in an order, over all rows or within keys, where a key may hold any part of them: range partitions and a small table of offsets, no window over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import cut

#: Bits of monotonically_increasing_id for the place within a partition.
_PLACE_BITS = 33
#: A table of at most so many rows is broadcast.
FEW = 100_000


def copies(table: DataFrame, into: str, n: Column | int) -> DataFrame:
    """table n times, numbered by the column ``into`` from 0."""
    return table.withColumn(into, F.explode(F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)) - 1)))


def with_small(rows: DataFrame, small: DataFrame, salts: int = 16, by: str = "id") -> DataFrame:
    """rows with the columns of small, a table with one row for each name; a name's rows are dealt, by a column of theirs, over copies of it.

    It has a row for each name and is not broadcast, however small its files are.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    return rows.withColumn("_salt", salt).join(copies(small, "_salt", salts).hint("merge"), ["name", "_salt"]).drop("_salt")


def numbered(df: DataFrame, order: list[str | Column], name: str = "rank", keys: list[str] = [], parts: int | None = None) -> DataFrame:  # noqa: B006
    """df with name: 1, 2, ... by order among the rows of equal keys, as row_number gives; order should tell rows apart, else equal ones come in any order.

    Rows are dealt to ``parts`` ranges of (keys, order), so a key goes over as many as it needs; sorted there, each has its place in its range; a key's rows in the ranges
    before come from a table of a row for each key and range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    runs = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # Without keys this has a row for each range only.
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = runs.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_in"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    same = F.col("_part") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(offsets if keys else F.broadcast(offsets), same).withColumn(name, F.col("_at") + F.col("_offset")).select(*df.columns, name)


def dense_numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with name: the place of by among its different values, from 1; the values are numbered in a table of their own, which is broadcast while it is small."""
    values = cut(numbered(df.select(by).distinct(), [by], name), "values")
    return df.join(F.broadcast(values) if values.count() <= FEW else values, by)
