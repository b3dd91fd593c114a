"""Structure operators on a few hand-made lines."""

from pyspark.sql import functions as F

from strandframe.operators import residues as R
from strandframe.sources import records, structures

LINES = [
    "HEADER    MADE BY HAND",
    "ATOM      1  N  AALA A  -1      11.104   6.134  -6.504  1.00  0.00           N",
    "ATOM      2  N  BALA A  -1      99.000   9.000   9.000  1.00  0.00           N",
    "ATOM      3  CA  ALA A  -1      11.639   6.071  -5.147  1.00  0.00           C",
    "ATOM      4  C   ALA A  -1      11.000   6.000  -4.000  1.00  0.00           C",
    "ATOM      5  O   ALA A  -1      10.000   6.000  -4.000  1.00  0.00           O",
    "ATOM      6  CA  GLY A   1      12.000   7.000  -3.000  1.00  0.00           C",
    "ATOM      7  CA  TRP A   1A     13.000   7.000  -3.000  1.00  0.00           C",
    "HETATM    8  CA  MSE A   2      14.000   7.000  -3.000  1.00  0.00           C",
    "ATOM      9  HA  TRP B   5      14.000   7.000  -3.000  1.00  0.00           H",
    "HETATM   10  O   HOH B   9      14.000   7.000  -3.000  1.00  0.00           O",
    "TER",
]


def _lines(spark):
    return spark.createDataFrame([("X", i, t) for i, t in enumerate(LINES)], "name string, line_no int, line string")


def test_residues_first_wins_and_gaps(spark):
    atoms = structures.parse_atoms(structures.normalize_mse(_lines(spark)))
    table = R.residue_table(atoms).orderBy("chain", "pos").collect()
    own = [r for r in table if r["chain"] == "A"]
    assert "".join(r["aa"] for r in own) == "A-GWM"
    assert [(r["resseq"], r["icode"], r["pos"]) for r in own] == [(-2, "", 1), (-1, "", 2), (0, "", 3), (0, "A", 4), (1, "", 5)]
    assert own[0]["n"] == [11.104, 6.134, -6.504] and own[0]["mask"] == 1 and own[1]["mask"] == 0 and own[1]["ca"] is None
    assert [r["aa"] for r in table if r["chain"] == "B"] == ["W"]


def test_mirror_twice_is_identity(spark):
    atoms = structures.parse_atoms(_lines(spark))
    assert R.mirror(R.mirror(atoms)).collect() == atoms.collect()


def test_filters_on_lines(spark):
    kept = [r["line_no"] for r in structures.drop_hydrogens(_lines(spark)).orderBy("line_no").collect()]
    assert kept == [1, 2, 3, 4, 5, 6, 7, 8, 10]
    assert [r["line_no"] for r in structures.select_backbone(_lines(spark), "B").orderBy("line_no").collect()] == [1, 2, 3, 4, 5, 6, 7, 11]


def test_files_round_trip(spark, tmp_path):
    atoms = structures.parse_atoms(_lines(spark))
    structures.write_structures(structures.render_atoms(atoms), str(tmp_path / "out"))
    back = structures.parse_atoms(structures.scan_structures(spark, str(tmp_path / "out"), "*.txt"))
    cols = ["name", "atom", "chain", "resseq", "icode", "x", "y", "z"]
    assert sorted(back.select(cols).collect()) == sorted(atoms.select(cols).collect())


def test_scan_names_files(spark, tmp_path):
    (tmp_path / "5ABC.pdb").write_text("\n".join(LINES) + "\n")
    (tmp_path / "skip.txt").write_text("no")
    lines = structures.scan_structures(spark, str(tmp_path)).filter("line <> ''").orderBy("line_no").collect()
    assert {r["name"] for r in lines} == {"5ABC"} and [r["line"] for r in lines] == [x.rstrip() for x in LINES]


def test_chains_and_next_letter(spark):
    atoms = structures.parse_atoms(_lines(spark), ("ATOM", "HETATM"))
    assert R.next_free_chain(atoms).collect()[0]["design_chain"] == "C"
    chains = R.chain_sequences(R.residue_table(atoms))
    whole = R.complexes(chains).collect()[0]
    assert whole["num_of_chains"] == 2 and whole["length"] == whole["seq"].__len__()


def test_json_round_trip(spark):
    chains = spark.createDataFrame([("X", "A", "AC-"), ("X", "B", "GG")], "name string, chain string, seq string")
    lines = records.render_complex_json(chains)
    assert lines.collect()[0]["line"] == '{"seq_chain_A": "AC-", "seq_chain_B": "GG", "name": "X", "num_of_chains": 2, "seq": "AC-GG"}'
    assert sorted(records.parse_complex_json(lines).collect()) == sorted(chains.collect())


def test_json_is_escaped_and_holds_coordinates(spark, tmp_path):
    import json

    rows = [("X\"1", c, 'A"C' if c == "b" else "GX") for c in ("1", "b", "A", "12")]
    chains = spark.createDataFrame(rows, "name string, chain string, seq string")
    residues = spark.createDataFrame(
        [(n, c, p, [1.5, float(p), -2.0], None, [0.0, 0.0, 0.25], [9.0, 9.0, 9.0]) for n, c, _ in rows for p in (2, 1)],
        "name string, chain string, pos int, n array<double>, ca array<double>, c array<double>, o array<double>",
    )
    lines = records.render_complex_json(chains, residues)
    found = json.loads(lines.collect()[0]["line"])
    assert [k for k in found if k.startswith("seq_chain_")] == ["seq_chain_A", "seq_chain_b", "seq_chain_1", "seq_chain_12"]
    assert found["name"] == 'X"1' and found["num_of_chains"] == 4 and found["seq"] == 'GXA"CGXGX' and found["seq_chain_b"] == 'A"C'
    assert found["coords_chain_b"]["N_chain_b"] == [[1.5, 1.0, -2.0], [1.5, 2.0, -2.0]] and all(x != x for p in found["coords_chain_A"]["CA_chain_A"] for x in p)
    lines.select("line").write.text(str(tmp_path / "j"))
    back = records.parse_complex_coords(spark.read.text(str(tmp_path / "j")).withColumnRenamed("value", "line")).collect()
    assert len(back) == 16 and all(r["coords"][0][0] == {"N": 1.5, "C": 0.0, "O": 9.0}[r["atom"]] for r in back if r["atom"] != "CA")
    assert all(x != x for r in back if r["atom"] == "CA" for p in r["coords"] for x in p)


def test_chains_are_listed_letters_first(spark):
    chains = spark.createDataFrame(
        [("X", c, c * 2, 2) for c in ("1", "b", "10", "A", "2", "Z", "a")],
        "name string, chain string, seq string, len long",
    )
    assert R.complexes(chains).collect()[0]["seq"] == "AAZZaabb11221010"
    assert [r["chain"] for r in R.chain_offsets(chains).orderBy("start").collect()] == ["A", "Z", "a", "b", "1", "2", "10"]
    table = chains.select("name", "chain", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"))
    assert [r["chain"] for r in R.with_index(table).orderBy("global_pos").collect()][::2] == ["A", "Z", "a", "b", "1", "2", "10"]


def test_atom_lines_with_long_numbers_and_rejects(spark):
    lines = spark.createDataFrame(
        [
            ("X", 0, "ATOM100001  N   ALA A   1      11.104   6.134  -6.504"),
            ("X", 1, "ATOM      2  N   ALA A          11.104   6.134  -6.504"),
            ("X", 2, "ATOM      3  N   ALA A   2      11.1x4   6.134  -6.504"),
            ("X", 3, "HETATM    4  N   ALA A   2      11.104   6.134  -6.504"),
        ],
        "name string, line_no int, line string",
    )
    assert [(r["line_no"], r["record"], r["resseq"]) for r in structures.parse_atoms(lines).collect()] == [(0, "ATOM", 0)]
    assert sorted(r["line_no"] for r in structures.rejected_atoms(lines).collect()) == [1, 2]


def test_last_chain_letter(spark):
    import pytest
    from pyspark.errors import PySparkException

    atoms = spark.createDataFrame([("X", f"c{i}") for i in range(52)] + [("Y", "A")], "name string, chain string")
    assert [r["design_chain"] for r in R.next_free_chain(atoms.filter("name = 'Y'")).collect()] == ["B"]
    with pytest.raises(PySparkException, match="no chain letter"):
        R.next_free_chain(atoms).collect()


def test_more_constraint_json(spark):
    one = lambda text: spark.createDataFrame([("f", 0, text)], "file string, line_no int, line string")
    assert [(r["aa"], r["bias"]) for r in records.parse_bias(one('{"G": 40.1}')).collect()] == [("G", 40.1)]
    rows = [[float(j) for j in range(21)], [0.5] * 21]
    got = records.parse_bias_by_residue(one('{"X": {"A": ' + str(rows) + "}}")).orderBy("pos").collect()
    assert [(r["name"], r["chain"], r["pos"], r["bias"]) for r in got] == [("X", "A", 1, rows[0]), ("X", "A", 2, rows[1])]
    pssm = records.parse_pssm_json(one('{"X": {"A": {"pssm_coef": [1.0], "pssm_bias": [[0.1, 0.2]], "pssm_log_odds": [[3.0, 4.0]]}}}')).collect()
    assert [(r["pos"], r["coef"], r["bias"], r["log_odds"]) for r in pssm] == [(1, 1.0, [0.1, 0.2], [3.0, 4.0])]
    tied = records.parse_tied(one('{"X": [{"C": [5, 4], "A": [[7], [-1.0]]}]}')).orderBy("member").collect()
    assert [(r["member"], r["chain"], r["pos"], r["beta"]) for r in tied] == [(0, "C", 5, 1.0), (1, "C", 4, 1.0), (2, "A", 7, -1.0)]


def test_fasta_lines(spark):
    native = spark.createDataFrame(
        [("X", 1.03125, "ACD/GG", ["B"], ["C", "A"], "v1")],
        "name string, score double, sequence string, fixed_chains array<string>, designed_chains array<string>, model_name string",
    )
    samples = spark.createDataFrame(
        [("X", 0.15, 2, 0.91966, 0.5147059, "ACE/GG"), ("X", 0.1, 7, 2.0, 1.0, "AAA/GG")],
        "name string, temperature double, sample_id long, score double, recovery double, sequence string",
    )
    assert [r["line"] for r in records.render_fasta(native, samples).orderBy("line_no").collect()] == [
        ">X, score=1.0312, fixed_chains=['B'], designed_chains=['A', 'C'], model_name=v1", "ACD/GG", ">T=0.1, sample=7, score=2.0000, seq_recovery=1.0000", "AAA/GG", ">T=0.15, sample=2, score=0.9197, seq_recovery=0.5147", "ACE/GG"]


def test_constraint_json(spark):
    one = lambda text: spark.createDataFrame([(text,)], "line string")
    tied = records.parse_tied(one('{"X": [{"A": [1], "C": [2]}, {"A": [[3], [-0.5]]}]}'))
    assert sorted((r["group_id"], r["chain"], r["pos"], r["beta"]) for r in tied.collect()) == [(0, "A", 1, 1.0), (0, "C", 2, 1.0), (1, "A", 3, -0.5)]
    roles = records.parse_chain_roles(one('{"X": [["A", "B"], ["C"]]}'))
    assert sorted((r["chain"], r["role"], r["list_pos"]) for r in roles.collect()) == [("A", "designed", 0), ("B", "designed", 1), ("C", "fixed", 0)]
    omit = records.parse_omit(one('{"X": {"A": [[[1, 2], "CW"]], "B": []}}'))
    assert sorted((r["chain"], r["pos"], r["aa"]) for r in omit.collect()) == [("A", 1, "C"), ("A", 1, "W"), ("A", 2, "C"), ("A", 2, "W")]
    coords = records.parse_complex_coords(
        one('{"coords_chain_A": {"N_chain_A": [[1.0, 2.0, 3.0], [NaN, NaN, NaN]]}, "name": "X"}'.replace("NaN", "0.5"))
    )
    assert coords.collect()[0]["coords"] == [[1.0, 2.0, 3.0], [0.5, 0.5, 0.5]]


def test_design_fasta(spark):
    text = [
        ">6XYZ, score=1.5, fixed_chains=['B'], designed_chains=['A', 'C'], model_name=v",
        "ACD/GG",
        ">T=0.1, sample=2, score=0.9, seq_recovery=0.5147",
        "ACE/GG",
    ]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no int, line string")
    native, sample = records.parse_design_fasta(lines).orderBy("line_no").collect()
    assert native["native"] and native["name"] == "6XYZ" and native["designed_chains"] == ["A", "C"] and native["fixed_chains"] == ["B"] and native["sequence"] == "ACD/GG"
    assert not sample["native"] and (sample["temperature"], sample["sample"], sample["score"], sample["recovery"]) == (0.1, 2, 0.9, 0.5147)


def test_thread_sequence_stops_with_it(spark):
    atoms = structures.parse_atoms(_lines(spark))
    designs = spark.createDataFrame([("X", "A", "CD")], "name string, chain string, sequence string")
    # Lines 6 and 7 are residues 1 and 1A, one run; the third run would begin after the last line of chain A, so chain B stays.
    got = R.thread_sequence(atoms, designs).orderBy("line_no").collect()
    assert [(r["line_no"], r["res3"]) for r in got] == [*((i, "CYS") for i in range(1, 6)), (6, "ASP"), (7, "ASP"), (9, "TRP")]
    short = spark.createDataFrame([("X", "A", "C", 1), ("X", "A", "W", 2)], "name string, chain string, sequence string, sample int")
    got = R.thread_sequence(atoms, short).orderBy("sample", "line_no").collect()
    assert [(r["sample"], r["line_no"], r["res3"]) for r in got] == [(k, i, a) for k, a in ((1, "CYS"), (2, "TRP")) for i in range(1, 6)]


def test_empty_tables(spark):
    none = _lines(spark).filter(F.lit(False))
    table = R.residue_table(structures.parse_atoms(none))
    assert table.count() == 0 and R.complexes(R.chain_sequences(table)).count() == 0
