"""Residues lie by name at once; constraints meet them with what follows from a constraint worked out in its own rows; a scorer's features are worked out once."""

import pytest
from pyspark.sql import functions as F

from strandframe.functions.letters import MODEL_ORDER
from strandframe.operators import constraints as C
from strandframe.operators import residues as R
from strandframe.operators import scoring as S
from strandframe.plans import constraint_plans  # noqa: F401
from strandframe.plans import fixtures as fx
from strandframe.plans import residue_plans as plans
from strandframe.plans.registry import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("tables")
    spark.range(3000).select(
        *[(F.col("id") % m).alias(c) for c, m in (("l_orderkey", 977), ("l_partkey", 500), ("l_suppkey", 50))], (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), F.lit(5.0).alias("l_quantity"),
        F.lit(0.1).alias("l_discount"), F.lit(0.1).alias("l_tax"), F.col("id").cast("double").alias("l_extendedprice"), F.lit("1995-01-01").cast("date").alias("l_shipdate"),
    ).write.parquet(str(to / "lineitem.parquet"))
    spark.range(500).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(str(to / "part.parquet"))
    return str(to)


def test_residues_lie_by_name_at_once(spark, tables):
    """One shuffle places them, whether line numbers are asked for or not, and structures are counted without their atoms."""
    placed = plans.residues(spark, tables).select("name", "chain", "pos")
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    atoms = plans.read_atoms(spark, tables)
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, R.residue_table(atoms).select("name", "chain", "pos").collect())) and placed.count() >= 3000
    held = fx.named(spark, tables).groupBy("name").count().join(R.residues_from_atoms(atoms).groupBy("name").agg(F.count("*").alias("n")), "name", "right")
    assert held.filter("n > count OR count IS NULL").count() == 0


def test_digits_of_omitted_letters_need_no_lambda(spark, tables):
    found = QUERIES["apply_omit"](spark, tables)
    assert "lambda" not in _plan(found)
    assert {r["omit"] for r in found.collect()} == {"0" * 21, "".join("1" if c in "CW" else "0" for c in MODEL_ORDER)}


def _keys(spark):
    return spark.createDataFrame([("a", "A", 1), ("a", "A", 2), ("a", "B", 1), ("b", "A", 1), (None, "A", 1)], "name string, chain string, pos int")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bias_is_added_in_the_rows_of_the_constraint(spark):
    rules = [("a", "A", 1, "L", 1.5), ("a", "A", 1, "L", 0.25), ("a", "A", 1, "G", None), ("a", "B", 1, "?", 3.0), ("b", "A", 1, None, 2.0), ("z", "A", 1, "A", 1.0)]
    found = C.apply_bias(_keys(spark), spark.createDataFrame(rules, "name string, chain string, pos int, aa string, bias double"), {"G": 40.1})
    assert "lambda" not in _plan(found)
    plain = [40.1 if c == "G" else 0.0 for c in MODEL_ORDER]
    ruled = [v + (1.75 if c == "L" else 0.0) for c, v in zip(MODEL_ORDER, plain, strict=True)]
    assert {tuple(r)[:3]: r["bias"] for r in found.collect()} == {tuple(k): ruled if tuple(k) == ("a", "A", 1) else plain for k in _keys(spark).collect()}


def test_letters_are_marked_in_the_rows_of_the_constraint(spark):
    rules = [("a", "A", 1, "C"), ("a", "A", 1, "C"), ("a", "A", 1, "X"), ("a", "B", 1, None), ("b", "A", 1, "?"), ("z", "A", 1, "A")]
    found = C.apply_omit(_keys(spark), spark.createDataFrame(rules, "name string, chain string, pos int, aa string"))
    assert "array_contains" not in _plan(found)
    ruled = [1.0 if c in "CX" else 0.0 for c in MODEL_ORDER]
    assert {tuple(r)[:3]: r["omit_mask"] for r in found.collect()} == {tuple(k): ruled if tuple(k) == ("a", "A", 1) else [0.0] * 21 for k in _keys(spark).collect()}


def echo_scorer():
    def score(pdf):
        assert list(pdf.columns) == ["name", "global_pos", "aa", "mask"] and not pdf.duplicated(["name", "global_pos"]).any()
        assert pdf.equals(pdf.sort_values(["name", "global_pos"], ignore_index=True)) and pdf.groupby("name").size().nunique() == 1
        return pdf

    return score


def test_features_are_worked_out_once(spark, monkeypatch):
    """Gaps are X with mask 0, places past the longest go, as do rows without a place; nulls take X and 0."""
    df = spark.range(4000).select(F.concat(F.lit("s"), (F.col("id") % 400).cast("string")).alias("name"), F.floor(F.col("id") / 400).alias("global_pos"), F.lit("A").alias("aa"), F.lit(1).alias("mask"))
    odd = spark.createDataFrame([("t", 0, None, 1), ("t", 2, "C", None), ("t", 7, "D", 1), ("u", None, "E", 1)], "name string, global_pos long, aa string, mask int")
    found = S.score_with_model(df.unionByName(odd), "name string, global_pos long, aa string, mask int", echo_scorer, 256)
    assert "Range (" not in _plan(found)
    monkeypatch.setattr(S, "_SCORED", 500)
    many = S.score_with_model(df, "name string, global_pos long, aa string, mask int", echo_scorer, 256)
    assert "Exchange hashpartitioning(bucket" in many._jdf.queryExecution().executedPlan().toString() and many.rdd.getNumPartitions() == 8 and many.count() == 4000
    rows = sorted(map(tuple, found.collect()))
    assert [r for r in rows if r[0] == "t"] == [("t", 0, "X", 1), ("t", 1, "X", 0), ("t", 2, "C", 0)] and [r for r in rows if r[0] == "u"] == [("u", 0, "X", 0)]
    assert [r for r in rows if r[0][0] == "s"] == sorted(map(tuple, df.collect()))
