"""Lines are rendered once and as by format_string; small structures are placed and joined to neighbours without further shuffles."""

from pyspark.sql import functions as F

from strandframe.sources import structures as S


def test_rendered_lines_equal_format_string(spark):
    xs = [0.0, -0.0, -0.0004, 0.0005, -0.0005, 1.0005, 2.5, -999.9995, 998.9996, 12345.678, 1e16, -1e20, float("nan"), float("inf"), None, 8.0625, -7.1245]
    rows = [("a", 70001 * i, x, n, r, c, 977 * i - 3000, "C" * (i % 4)) for i, x in enumerate(xs) for n in ("CA", "HG11", None, "LONGER", "") for r, c in (("ATOM", "B"), ("HETATM", ""), (None, None), ("REMARKS", "AB"))]
    df = spark.createDataFrame(rows, "name string, line_no long, x double, atom string, record string, chain string, resseq int, icode string")
    df = df.select("*", F.col("x").alias("y"), (-F.col("x")).alias("z"), F.lit("ALA").alias("res3"), F.lit("C").alias("element"))
    atom = F.when(F.length("atom") < 4, F.concat(F.lit(" "), F.col("atom"))).otherwise(F.col("atom"))
    want = F.format_string(
        "%-6s%5d %-4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", "record", (F.col("line_no") % 100000).cast("int"), atom, "res3", "chain", (F.col("resseq") + 1).cast("int"),
        F.when(F.col("icode") == "", " ").otherwise(F.col("icode")), "x", "y", "z", F.lit(1.0), F.lit(0.0), "element",
    )
    assert [r["line"] for r in S.render_atoms(df).collect()] == [r[0] for r in df.select(want).collect()]


def test_filters_do_not_render_again(spark):
    atoms = spark.range(10).selectExpr(
        "'s' AS name", "id AS line_no", "'ATOM' AS record", "'CA' AS atom", "'ALA' AS res3", "'A' AS chain", "int(id) AS resseq", "'' AS icode", "double(id) AS x", "0D AS y", "1D AS z", "'C' AS element"
    )
    lines = S.render_atoms(atoms)
    for found in (S.parse_atoms(lines), S.select_backbone(lines, "B"), S.drop_hydrogens(lines), S.parse_atoms(S.normalize_mse(lines))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("format_string") == 1 and found.count() == 10


def test_small_structures_share_one_row(spark):
    """Neighbours with carried columns come from a row a structure; ids apart and more points than a block go by joins, with the same result."""
    from strandframe.operators import graph as G

    rows = [(f"s{i}", j * (1 if i % 2 else 300), (j * 7 % 11) * 1.5, (j * 5 % 13) * 1.0, (j * 3 % 7) * 2.0, f"c{j}", int(j % 3 > 0)) for i in range(4) for j in range(20)]
    p = spark.createDataFrame(rows, "name string, id long, x double, y double, z double, tag string, mask int")
    columns = ["name", "src", "dst", "rank", "dist"]
    found = G.knn_graph(p, 4, carried=("tag",))
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, G.knn_graph(p, 4, small=0).select(*columns).collect()))
    tags = {(r[0], r[1]): r[5] for r in rows}
    assert all((r["s_tag"], r["d_tag"]) == (tags[r["name"], r["src"]], tags[r["name"], r["dst"]]) for r in found.collect())
    near = G.knn_graph(p.filter("name IN ('s1', 's3')"), 4, carried=("tag",))
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString() and near.count() == 160
    one = lambda n: sorted((r["src"], r["dst"], r["rank"], r["dist"]) for r in G.masked_knn(p.filter(f"name = '{n}'"), 4).collect())
    assert [(s * 300, d * 300, r, x) for s, d, r, x in one("s1")] == one("s2")


def test_grid_broadcasts_no_table_of_points(spark):
    from strandframe.operators import graph as G

    p = spark.createDataFrame([(f"s{i}", j, j * 1.5, (j * 5 % 13) * 1.0, (j * 3 % 7) * 2.0) for i in range(2) for j in range(30)], "name string, id long, x double, y double, z double")
    found = G.knn_graph(p, 4, small=0)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 240


def test_pairs_and_targets_of_small_structures_meet_in_a_row(spark):
    """No join for structures of one block; those apart go by joins, with the same rows."""
    from strandframe.operators import graph as G

    far = lambda i, j: j * (1 if i % 2 else 300)
    p = spark.createDataFrame([(f"s{i}", far(i, j), (j * 7 % 11) * 1.5 - 4, (j * 5 % 13) * 1.0, (j * 3 % 7) * 2.0) for i in range(4) for j in range(20)], "name string, id long, x double, y double, z double")
    assert "Join" not in G.pair_distances(p.filter("name IN ('s1', 's3')"), 5.0)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, G.pair_distances(p, 5.0).collect())) == sorted(map(tuple, G._pairs_met(p, 5.0).collect()))
    q = spark.createDataFrame([(f"s{i}", far(i, j), int(j % 3 > 0), (j * 7 % 11) / 11, f"c{j}") for i in range(4) for j in range(20)], "name string, pos long, design int, noise double, chain string")
    for first in (False, True):
        assert "Join" not in G.conditional_order(q.filter("name = 's1'"), first)._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r["name"], r["target"] // far(int(r["name"][1]), 1), r["pos"] // far(int(r["name"][1]), 1), r["decode_rank"], r["chain"]) for r in G.conditional_order(q, first).collect())
        assert [r[1:] for r in got if r[0] == "s0"] == [r[1:] for r in got if r[0] == "s1"] and len(got) == 4 * 13 * 20
