"""Neighbours within a row: cells and all pairs in numpy equal brute force, Spark's rounding of distances, and no pair is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import graph as G
from strandframe.operators import nearby

SCHEMA = "name string, id long, x double, y double, z double, tag string"


def _shapes():
    rng = np.random.default_rng(11)
    return {
        "even": rng.uniform(0, 60, (250, 3)),
        "clusters": np.concatenate([rng.normal(0, 0.01, (90, 3)), rng.normal(50, 5, (60, 3)), rng.uniform(-500, 500, (30, 3))]),
        "copies": np.concatenate([np.zeros((80, 3)), rng.integers(0, 3, (120, 3))]),
        "line": np.stack([np.arange(200) * 0.5, np.zeros(200), np.zeros(200)], axis=1),
        "far": np.concatenate([rng.normal(0, 3, (200, 3)), [[9999.999, -9999.999, 9999.999]]]),
        "one": np.zeros((1, 3)),
        "same": np.ones((40, 3)),
        "few": rng.uniform(0, 9, (5, 3)),
    }


def _brute(p, k):
    d = p[:, None, :] - p[None, :, :]
    d = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] + 1e-6)
    return {(i, int(j), r, d[i, j]) for i in range(len(p)) for r, j in enumerate(np.lexsort((np.arange(len(p)), np.round(d[i], 6)))[:k], 1)}


@pytest.fixture(scope="module")
def shapes():
    return {n: np.round(p, 3) for n, p in _shapes().items()}


@pytest.fixture(scope="module")
def points(spark, shapes):
    rows = [(n, i, *map(float, xyz), f"{n}{i}" if i % 3 else None) for n, p in shapes.items() for i, xyz in enumerate(p)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(("k", "small"), [(1, 0), (8, 0), (8, 256), (60, 0), (300, 256)])
def test_rows_equal_all_pairs(points, shapes, k, small):
    found = G.knn_graph(points, k, small, carried=("tag",))
    got = {}
    for r in found.collect():
        got.setdefault(r["name"], set()).add((r["src"], r["dst"], r["rank"], r["dist"]))
        assert (r["s_tag"], r["d_tag"]) == tuple(f"{r['name']}{r[c]}" if r[c] % 3 else None for c in ("src", "dst"))
    for name, p in shapes.items():
        assert got[name] == _brute(p, k), name


def test_cells_of_a_row_shuffle_no_pair(points):
    """Each structure is a row at once: cells were joins, whose points, cells and pairs were shuffled and written anew for each ring."""
    found = G.knn_graph(points, 8, 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan and found.count() == sum(min(8, n) * n for n in (250, 180, 200, 200, 201, 1, 40, 5))


def test_pairs_of_large_structures_stay_in_their_cells(spark):
    """The window over a point's pairs takes the partitions that the join of cells made."""
    p = spark.range(700).select(F.lit("s").alias("name"), "id", *[(F.rand(i) * 50).alias(c) for i, c in enumerate("xyz")])
    written, own = [], G.cut
    G.cut = lambda df, name: (written.append((name, df._jdf.queryExecution().executedPlan().toString())), own(df, name))[1]
    try:
        assert G.knn_graph(p, 6, 0).count() == 4200
    finally:
        G.cut = own
    rings = [plan for name, plan in written if name == "neighbours"]
    assert rings and all("Exchange" not in plan.split("SortMergeJoin")[0] for plan in rings)


def test_chunks_of_pairs(points, shapes, monkeypatch):
    """However few pairs are held at once, each point has all of its own."""
    monkeypatch.setattr(nearby, "_PAIRS", 500)
    at = np.concatenate(list(shapes.values()))
    sizes = np.array([len(p) for p in shapes.values()] + [0])
    starts = np.cumsum(sizes) - sizes
    for cells in (True, False):
        got = {e for found in nearby._found(at, np.zeros(len(at), bool), sizes, starts, 8, cells) for e in zip(*(a.tolist() for a in found), strict=True)}
        assert got == {(int(s) + i, int(s) + j, r, d) for s, p in zip(starts, shapes.values(), strict=False) for i, j, r, d in _brute(p, 8)}


def test_odd_coordinates(spark):
    """Null distances come first, as in Spark's order, NaN last; cells leave such structures to all pairs."""
    rows = [("n", i, None if i == 3 else float("nan") if i == 1 else float(i), 0.0, 0.0) for i in range(5)] + [("i", i, float("inf") if i == 2 else float(i), 0.0, 0.0) for i in range(4)]
    p = spark.createDataFrame(rows, "name string, id long, x double, y double, z double")
    pairs = G._nearest(G._pairs_met(p), 3).select("name", "src", "dst", "rank", F.col("dist").cast("string"))
    for small in (0, 256):
        assert sorted(map(str, G.knn_graph(p, 3, small).withColumn("dist", F.col("dist").cast("string")).collect())) == sorted(map(str, pairs.collect()))
    assert G.knn_graph(p.limit(0), 3, 0).count() == 0


def test_distances_are_rounded_as_spark_does(spark):
    d = [0.0000005, 1.0000005, 2.5000015, 0.1234565, 3.0, 1.00000049999, 123.4567895, 7.0000025, 0.001, 99.9999995, 1.2345645, 5e8 + 0.5]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in d], "d double").select(F.round("d", 6)).collect()]
    assert (nearby._rounded(np.array(d)) / 1e6).tolist() == pytest.approx(want, abs=1e-10)
