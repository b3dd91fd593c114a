"""Designs on atom lines: runs are counted where the lines lie."""


def test_threading_joins_no_lines(spark):
    from strandframe.operators import residues as R

    atoms = spark.createDataFrame([("s", "AB"[i % 2], i, "ATOM" if i % 5 else "HETATM", ("N", "CB", "CA", None)[i % 4], i // 6, "GLY") for i in range(60)] + [("s", None, 60, "ATOM", "CA", 1, "GLY")], "name string, chain string, line_no int, record string, atom string, resseq int, res3 string")
    designs = spark.createDataFrame([("s", "A", "ACD", 1), ("s", "B", "EFGHIKLMNP", 2)], "name string, chain string, sequence string, sample int")
    found = R.thread_sequence(atoms, designs)
    runs = R.residue_runs(R.backbone(atoms)).select("name", "chain", "line_no", "run_id")
    want = []
    for d in designs.collect():
        stop = min((r["line_no"] for r in runs.collect() if r["chain"] == d["chain"] and r["run_id"] == len(d["sequence"]) + 1), default=99)
        for a in atoms.filter("record = 'ATOM'").join(runs, ["name", "chain", "line_no"], "left").collect():
            if a["line_no"] < stop and a["chain"] is not None and (a["chain"] != d["chain"] or a["run_id"]):
                three = {"A": "ALA", "C": "CYS", "D": "ASP", "E": "GLU", "F": "PHE", "G": "GLY", "H": "HIS", "I": "ILE", "K": "LYS", "L": "LEU", "M": "MET", "N": "ASN", "P": "PRO"}
                want.append((a["line_no"], three[d["sequence"][a["run_id"] - 1]] if a["chain"] == d["chain"] else "GLY", d["sample"]))
    assert sorted((r["line_no"], r["res3"], r["sample"]) for r in found.collect()) == sorted(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
