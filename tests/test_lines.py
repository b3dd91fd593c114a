"""Lines and numbers are worked out once, and as they were by patterns, decimals and rounding."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.plans import fixtures as fx
from strandframe.sources import structures as S


def test_insertion_codes_equal_patterns(spark):
    rng = random.Random(2)
    texts = ["", "A", "52A", "-3", "+4", "5AB", "A5B", "--5", "5-", "1-2", ".7", "-.7", "5.7", "1e3", "5A\r", "7\r", "7 ", "é5", "5é", "99999999999", "0012", "-", "- 5", "5 A", "\t5", "٣", None]
    texts += ["".join(rng.choice("0123456789-+. AzZa\r") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            number, icode = S.split_insertion_code(F.col("t"))
            want = df.select("t", F.regexp_extract("t", "-?[0-9]+", 0).try_cast("int") - 1, F.regexp_extract("t", "[A-Za-z]$", 0))
            assert df.select("t", number, icode).collect() == want.collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")


def test_numbers_of_a_line_are_parsed_once(spark):
    lines = spark.createDataFrame([("s", 0, "ATOM      1  CA  ALA A   5A      1.500   0.250  -3.125  1.00  0.00           C"), ("s", 1, "HETATM    2  CA  MSE A   6       1.500     bad  -3.125")], "name string, line_no long, line string")
    found = S.parse_atoms(S.normalize_mse(lines))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as double)") == 3 and plan.count("MET") == 1
    assert [(r["resseq"], r["icode"], r["x"], r["y"], r["z"], r["res3"]) for r in found.collect()] == [(4, "A", 1.5, 0.25, -3.125, "ALA")]
    assert [r["line_no"] for r in S.rejected_atoms(S.normalize_mse(lines)).collect()] == [1]


def test_plain_coordinates_equal_format(spark):
    rng = random.Random(3)
    xs = [round(rng.uniform(-999, 999), rng.choice([0, 1, 2, 3, 3, 4, 17])) for _ in range(3000)] + [0.0, -0.0, 0.0005, -0.0005, 998.9995, 0.001, -0.001, 1e-9, -1e-9, 1e300, float("inf"), 0.1 + 0.2]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S._plain(F.col("x")).alias("mine"), F.format_string("%8.3f", "x").alias("text"))
    assert [r for r in df.collect() if r["mine"] != (r["text"] if abs(r["x"]) < 999 else None)] == []


def test_atoms_are_rounded_as_before(spark, tmp_path):
    rng = random.Random(4)
    odd = [0.0, 0.00005, -0.00005, 1.0005, 2.5, 0.0004999999, 1e9, 1e17, -0.0004, 7.000000000000001, float("nan"), None]
    rows = [(i % 13, i % 5, i % 3, i % 7 + 1, *[rng.choice(odd) if i % 2 else round(rng.uniform(-60, 60), 4) for _ in range(3)]) for i in range(600)]
    item = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double, l_extendedprice double")
    item = item.withColumn("l_quantity", F.when(F.col("l_orderkey") % 3 == 0, 5.0005).otherwise(F.col("l_orderkey") * 0.5)).withColumn("l_shipdate", F.lit("1995-01-01").cast("date"))
    item.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = fx.atoms(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan
    raw = spark.sql(fx._RES_RAW.format(prefix="P", key="l_partkey", lineitem="{lineitem}"), lineitem=spark.read.parquet(str(tmp_path / "lineitem.parquet")))
    want = spark.sql(fx._ATOMS, raw=raw)
    text = lambda t: sorted(str(tuple(r)) for r in t.select(*[c for c in t.columns if c != "line_no"]).collect())
    assert text(found) == text(want)


@pytest.mark.parametrize("mode", ["true", "false"])
def test_large_numbers_do_not_overflow(spark, mode):
    spark.conf.set("spark.sql.ansi.enabled", mode)
    try:
        assert [r[0] for r in spark.createDataFrame([(1e300,), (None,), (-5.0,)], "x double").select(S._plain(F.col("x"))).collect()] == [None, None, "  -5.000"]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
