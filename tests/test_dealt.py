"""A task's share of the rows doesn't grow with the table."""

from pyspark.sql import functions as F

from strandframe.plans import fixtures as fx


def test_atoms_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    n = 3000
    item = spark.range(n).select(
        *[(F.col("id") % m).alias(c) for c, m in (("l_orderkey", 977), ("l_partkey", 500), ("l_suppkey", 50), ("l_linenumber", 7))], F.lit(5.0).alias("l_quantity"), F.lit(0.1).alias("l_discount"),
        F.lit(0.1).alias("l_tax"), F.col("id").cast("double").alias("l_extendedprice"), F.lit("1995-01-01").cast("date").alias("l_shipdate"),
    )
    item.write.parquet(str(tmp_path / "lineitem.parquet"))
    few = fx.atoms(spark, str(tmp_path))
    monkeypatch.setattr(fx, "_DEALT", 250)
    many = fx.atoms(spark, str(tmp_path))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    held = many.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("name").alias("n")).collect()
    assert len(held) > 8 and sum(r["n"] for r in held) == 500
