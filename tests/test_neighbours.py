"""Neighbours by rings of cells, pairs by tiles, and order by rank shift, against brute force on uneven structures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import graph as G
from strandframe.operators import ranks

SCHEMA = "name string, id long, x double, y double, z double, mask int"


def _shapes():
    """Structures by name: even, clustered, copies, flat, a point far out, one point, a sphere around its centre."""
    rng = np.random.default_rng(7)
    ball = rng.normal(size=(60, 3))
    return {
        "even": rng.uniform(0, 60, (700, 3)),
        "clusters": np.concatenate([rng.normal(0, 0.01, (300, 3)), rng.normal(50, 5, (200, 3)), rng.uniform(-500, 500, (60, 3))]),
        "copies": np.concatenate([np.zeros((120, 3)), np.ones((90, 3)), rng.integers(0, 3, (120, 3))]),
        "flat": np.stack([np.arange(300) % 20, np.arange(300) // 20, np.zeros(300)], axis=1),
        "far": np.concatenate([rng.normal(0, 3, (280, 3)), [[9999.999, -9999.999, 9999.999]]]),
        "one": np.zeros((1, 3)),
        "sphere": np.concatenate([[[0.0, 0, 0]], 10 * np.round(ball / np.linalg.norm(ball, axis=1)[:, None], 3)]),
        "few": rng.uniform(0, 9, (5, 3)),
    }


def _masks(shapes):
    rng = np.random.default_rng(3)
    return {n: (rng.random(len(p)) < {"few": 0.5, "sphere": 0.9, "copies": 0.5}.get(n, 0.8)).astype(int) for n, p in shapes.items()}


def _distances(p):
    d = p[:, None, :] - p[None, :, :]
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] + 1e-6)


def _brute(distances, k, ids):
    out = set()
    for i in range(len(ids)):
        order = np.lexsort((ids, np.round(distances[i], 6)))[:k]
        out |= {(int(ids[i]), int(ids[j]), r) for r, j in enumerate(order, 1)}
    return out


@pytest.fixture(scope="module")
def shapes():
    return {n: np.round(p, 3) for n, p in _shapes().items()}


@pytest.fixture(scope="module")
def points(spark, shapes):
    masks = _masks(shapes)
    rows = [(n, 3 * i + 1, *map(float, xyz), int(masks[n][i])) for n, p in shapes.items() for i, xyz in enumerate(p)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _got(graph):
    out = {}
    for r in graph.collect():
        out.setdefault(r["name"], set()).add((r["src"], r["dst"], r["rank"]))
    return out


@pytest.mark.parametrize(("k", "small"), [(6, 0), (6, 256), (40, 1)])
def test_rings_equal_all_pairs(points, shapes, k, small):
    got = _got(G.knn_graph(points, k, small))
    for name, p in shapes.items():
        assert got[name] == _brute(_distances(p), k, 3 * np.arange(len(p)) + 1), name


@pytest.mark.parametrize("k", [4, 60])
def test_masked_rule(points, shapes, k):
    got, masks = _got(G.masked_knn(points, k, 100)), _masks(shapes)
    for name, p in shapes.items():
        m = masks[name][:, None] * masks[name][None, :]
        d = m * _distances(p)
        d = d + (1 - m) * d.max(axis=1, keepdims=True)
        assert got[name] == _brute(d, k, 3 * np.arange(len(p)) + 1), name


def test_tiles_and_cells_give_all_pairs(points, shapes):
    counts = {r["name"]: (r["n"], r["s"], r["a"]) for r in G.pair_distances(points, tile=50).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("src").alias("s"), F.sum("dist").alias("a")).collect()}
    near = {r["name"]: r["n"] for r in G.pair_distances(points, within=4.0).groupBy("name").agg(F.count_distinct("src", "dst").alias("n")).collect()}
    for name, p in shapes.items():
        d = _distances(p)
        assert counts[name][:2] == (len(p) ** 2, len(p)) and counts[name][2] == pytest.approx(d.sum())
        assert near[name] == (d < 4.0).sum()


def test_one_structure_goes_over_all_tasks(spark):
    """Pairs of one structure are dealt by tiles; neighbours of 60,000 points make rows in proportion to the points."""
    one = spark.range(3000).select(F.lit("big").alias("name"), "id", F.rand(1).alias("x"), F.rand(2).alias("y"), F.rand(3).alias("z"))
    dealt = G.pair_distances(one, tile=256).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in dealt) == 9_000_000 and max(r["count"] for r in dealt) < 6_000_000
    big = spark.range(60_000).select(F.lit("big").alias("name"), "id", (F.rand(4) * 100).alias("x"), (F.rand(5) * 100).alias("y"), (F.rand(6) * 100).alias("z"))
    graph = G.knn_graph(big, 8)
    assert graph.count() == 480_000 and graph.filter("rank = 1 AND src <> dst").count() == 0


def test_order_of_each_target(spark):
    rows = [("s", i, int(i % 3 > 0), ((i * 37) % 41) / 41) for i in range(90)] + [("t", 0, 0, 0.1), ("u", 5, 1, 0.2)]
    positions = spark.createDataFrame(rows, "name string, pos long, design int, noise double")
    for first in (False, True):
        got = {}
        for r in G.conditional_order(positions, first, tile=16).collect():
            got.setdefault((r["name"], r["target"]), []).append((r["decode_rank"], r["pos"]))
        assert set(got) == {(r[0], r[1]) for r in rows if r[2]}
        for (name, target), order in got.items():
            own = sorted((r for r in rows if r[0] == name), key=lambda r: ((r[1] == target) != first, (r[2] + 1e-4) * abs(r[3]), r[1]))
            assert sorted(order) == [(i, r[1]) for i, r in enumerate(own, 1)]


def test_numbered(spark):
    """Places of rows of one key that holds most rows, of keys with nulls, and over all rows."""
    rows = [("hot" if i % 10 else None if i % 20 else f"k{i % 7}", (i * 7919) % 1009, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(6)
    got = {(r["k"], r["i"]): r["rank"] for r in ranks.numbered(df, ["v", "i"], keys=["k"], parts=13).collect()}
    for key in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])
        assert [got[key, r[2]] for r in order] == list(range(1, len(order) + 1))
    every = ranks.numbered(df, ["v", "i"], "n", parts=9).orderBy("n").collect()
    assert [r["n"] for r in every] == list(range(1, 5001)) and [r["i"] for r in every] == [r[2] for r in sorted(rows, key=lambda r: r[1:])]
    assert ranks.numbered(df.limit(0), ["v"]).count() == 0
    assert {(r["v"], r["d"]) for r in ranks.dense_numbered(df, "v", "d").select("v", "d").distinct().collect()} == {(v, i) for i, v in enumerate(sorted({r[1] for r in rows}), 1)}
