"""Features of edges are averaged as columns: an edge stays one row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions.geometry import rbf
from strandframe.operators import graph as G


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gaussians_are_compiled(spark):
    d = [0.0, 2.0, 3.7, 21.9, 400.0, None]
    found = spark.createDataFrame([(x,) for x in d], "d double").select("d", rbf(F.col("d")).alias("r"))
    assert "lambda" not in _plan(found)
    for x, r in found.collect():
        want = [None] * 16 if x is None else np.exp(-(((x - np.linspace(2, 22, 16)) / 1.25) ** 2)).tolist()
        assert r == want or r == pytest.approx(want)


def test_mean_atom_pairs_equal_pairs_of_each_edge(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 3}", i // 3, int(i % 5 > 0), *[None if i % 5 == 0 and a == 2 else rng.normal(size=3).round(3).tolist() for a in range(4)]) for i in range(45)]
    table = spark.createDataFrame(rows, "name string, global_pos long, mask int, n array<double>, ca array<double>, c array<double>, o array<double>")
    edges = G.knn_graph(G.points(table, *G.five_numbers()), 4, carried=G.FIVE)
    found = G.mean_atom_pairs(edges)
    assert _plan(found).count("Generate") == 1
    want = G.atom_pair_distances(edges.select("name", "src", "dst"), table).groupBy("name", "a", "b").agg(F.count("*").alias("n"), F.avg("dist").alias("mean_dist"))
    key = lambda t: {(r["name"], r["a"], r["b"]): (r["n"], pytest.approx(r["mean_dist"])) for r in t.collect()}
    assert len(key(found)) == 75 and key(found) == {k: (n, m.expected) for k, (n, m) in key(want).items()}
