"""Complexes as JSON lines: letters and coordinates are written from one grouping and read in one pass."""

import json

from pyspark.sql import functions as F

from strandframe.operators import residues as R
from strandframe.plans import files
from strandframe.sources import records, structures

SF = "/root/testdata/sf0.001"


def _table(spark):
    rows = [(f"s{i % 5}", i, "ATOM", a, r, "ABb1"[i % 4], i % 11, "" if i % 9 else "A", i * 0.5, i * 0.25, -i * 1.0, "C") for i in range(400) for a, r in [(("N", "CA", "C", "O", "CB")[i % 5], ("ALA", "GLY", "XXX")[i % 3])]]
    return R.residue_table(spark.createDataFrame(rows, "name string, line_no long, record string, atom string, res3 string, chain string, resseq int, icode string, x double, y double, z double, element string"))


def test_one_grouping_writes_the_same_lines(spark):
    table = _table(spark)
    one = records.render_complexes(table)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, records.render_complex_json(R.chain_sequences(table), table).collect()))
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert all(json.loads(r["line"])["num_of_chains"] > 1 for r in one.collect())


def test_every_position_comes_back(spark):
    """scan_complex_jsonl gave chains and sequences and left the coordinates out."""
    table = _table(spark)
    axes = [f"{a}_{c}" for a in ("n", "ca", "c", "o") for c in "xyz"]
    got = records.complex_positions(records.parse_complexes(records.render_complexes(table)))
    want = table.select("name", "chain", "pos", "aa", *[F.col(a)[i].alias(f"{a}_{c}") for a in ("n", "ca", "c", "o") for i, c in enumerate("xyz")])
    assert got.columns == ["name", "chain", "pos", "aa", *axes] and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.filter("ca_x IS NOT NULL").count() > 9


def test_what_an_object_lacks_is_null(spark):
    texts = [
        '{"seq_chain_A": "AC", "coords_chain_A": {"N_chain_A": [[1.0, 2.0, 3.0], [NaN, NaN, NaN], [4, 5, 6]], "CA_chain_A": []}, "name": "X", "num_of_chains": 2, "seq": "AC"}',
        '{"coords_chain_B_chain_": {"O_chain_B_chain_": [[7.5, 8.5, 9.5]]}, "seq_chain_Q": "", "name": "Y"}', '{"seq_chain_A": "G", "name": "Z"}', "broken", "{}",
    ]
    chains = records.parse_complexes(spark.createDataFrame([(t,) for t in texts], "line string"))
    assert sorted((r["name"], r["chain"], r["seq"], r["num_of_chains"], r["whole"]) for r in chains.collect() if r["seq"] is not None) == [("X", "A", "AC", 2, "AC"), ("Y", "Q", "", None, None), ("Z", "A", "G", None, None)]
    got = [(r["name"], r["chain"], r["pos"], r["aa"], r["n_x"], r["ca_x"], r["o_z"]) for r in records.complex_positions(chains).orderBy("name", "chain", "pos").collect()]
    assert got == [("X", "A", 1, "A", 1.0, None, None), ("X", "A", 2, "C", None, None, None), ("X", "A", 3, None, 4.0, None, None), ("Y", "B_chain_", 1, None, None, None, 9.5), ("Z", "A", 1, "G", None, None, None)]


def test_lines_are_made_once_and_read_once(spark, monkeypatch):
    """The structures' lines were rendered and parsed three times, for a count, for letters and for coordinates; the objects were read twice and joined."""
    made, own = [], R.residues_from_atoms
    monkeypatch.setattr(structures, "render_atoms", lambda atoms, f=structures.render_atoms: (made.append("lines"), f(atoms))[1])
    monkeypatch.setattr(R, "residue_table", lambda atoms, counted=None, f=R.residue_table: (made.append(counted is not None and "line" not in counted._jdf.queryExecution().optimizedPlan().toString().split("l_partkey")[0]), f(atoms, counted))[1])
    found = files.write_complex_jsonl(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert made == ["lines", True] and own is R.residues_from_atoms and "Join" not in plan and "Exchange" not in plan
