"""One structure that holds a third of all rows: places, indices, batches and constraints equal brute force, and its rows go over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions.letters import CHAINS
from strandframe.operators import constraints as C
from strandframe.operators import residues as R

SCHEMA = "name string, chain string, resseq int, icode string, aa string, res3 string, n double, ca double, c double, o double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for name, chain, lo, hi, keep in [("big", "A", -700, 4000, 0.8), ("big", "b", 3, 9, 1), ("big", "7", 1, 1200, 0.02), *((f"s{i}", c, rng.randint(-9, 9), rng.randint(10, 60), 0.7) for i in range(60) for c in "AZ")]:
        numbers = [x for x in range(lo, hi) if rng.random() < keep] or [lo]
        for number in numbers:
            for icode in ["", "A", "B", "C"][: rng.choice([1, 1, 1, 2, 4])]:
                out.append((name, chain, number, icode, rng.choice("ACDEFG")))
    return out


def _brute(rows):
    chains = {}
    for name, chain, number, icode, aa in rows:
        chains.setdefault((name, chain), []).append((number, icode, aa))
    filled = {}
    for key, own in chains.items():
        held = {r[0] for r in own}
        gaps = [(x, "", "-") for x in range(min(held), max(held) + 1) if x not in held]
        filled[key] = sorted(own + gaps)
    out = []
    for name in {k[0] for k in filled}:
        start = 0
        for no, chain in enumerate(sorted((c for n, c in filled if n == name), key=lambda c: (CHAINS + "0123456789").index(c)), 1):
            for pos, (number, icode, aa) in enumerate(filled[name, chain], 1):
                out.append((name, chain, number, icode, aa, pos, start + pos - 1, 100 * (no - 1) + start + pos - 1))
            start += len(filled[name, chain])
    return sorted(out)


def test_places_and_indices(spark, rows):
    df = spark.createDataFrame([(*r, "ALA", 1.0, 1.0, None, 1.0) for r in rows], SCHEMA).repartition(7)
    columns = ["name", "chain", "resseq", "icode", "aa", "pos", "global_pos", "residue_idx"]
    table = R.placed(df)
    want = _brute(rows)
    assert sorted(tuple(r) for r in R.with_index(table).select(*columns).collect()) == want
    assert sorted(tuple(r) for r in R.with_index(table.drop("start", "chain_no")).select(*columns).collect()) == want
    assert table.filter("aa = '-' AND (ca IS NOT NULL OR res3 IS NOT NULL OR icode <> '')").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows end in one task
    held = [r["n"] for r in R.placed(df).groupBy(F.spark_partition_id()).agg(F.count_if(F.col("name") == "big").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([n for n in held if n]) > 1
    assert R.placed(df.limit(0)).count() == 0


def test_chains_from_atoms(spark, rows):
    lines = [(n, c, x, i, j, "CA", "ALA" if aa == "A" else "CYS", 0.0, 0.0, 0.0) for j, (n, c, x, i, aa) in enumerate(rows)]
    atoms = spark.createDataFrame(lines, "name string, chain string, resseq int, icode string, line_no int, atom string, res3 string, x double, y double, z double")
    got = {(r["name"], r["chain"]): (r["seq"], r["len"]) for r in R.chain_table(atoms).collect()}
    want = {}
    for name, chain, _, _, aa, *_ in sorted(_brute(rows), key=lambda r: (r[0], r[1], r[5])):
        want[name, chain] = want.get((name, chain), "") + {"-": "-", "A": "A"}.get(aa, "C")
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_repeated_constraint_rows(spark):
    """A row given twice changes nothing; of different PSSM rows for a position one counts, and no residue is doubled."""
    residues = spark.createDataFrame([("s", "A", 1), ("s", "A", 2), ("t", "B", 1)], "name string, chain string, pos int")
    one = ("s", "A", 1, 1.0, [0.1] * 21, [2.0] * 21)
    pssm = spark.createDataFrame([one, one, ("s", "A", 1, 0.5, [9.0] * 21, [9.0] * 21)], "name string, chain string, pos int, coef double, bias array<double>, log_odds array<double>")
    got = {(r["name"], r["pos"]): (r["coef"], r["bias"][0], r["log_odds"][3]) for r in C.apply_pssm(residues, pssm).collect()}
    assert got == {("s", 1): (1.0, 0.1, 2.0), ("s", 2): (0.0, 0.0, 10000.0), ("t", 1): (0.0, 0.0, 10000.0)} and C.apply_pssm(residues, pssm).count() == 3
    fixed = residues.filter("name = 's'").union(residues.filter("name = 's'"))
    assert C.apply_fixed(residues, fixed).count() == 3


def test_strict_callers(spark):
    residues = spark.createDataFrame([("s", "A", 1), ("t", "B", 1)], "name string, chain string, pos int")
    assert C.require_keys(residues, residues).count() == 2
    with pytest.raises(ValueError, match="'t', 'B'"):
        C.require_keys(residues, residues.filter("name = 's'"))
