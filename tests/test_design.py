"""Constraints, graphs, sampling and scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import arrays
from strandframe.functions.letters import MODEL_ORDER
from strandframe.operators import constraints as C
from strandframe.operators import graph as G
from strandframe.operators import scoring as S


def _points(spark, n=60, names=("a", "b")):
    rng = random.Random(3)
    return spark.createDataFrame(
        [(m, i, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(-20, 20)) for m in names for i in range(n)],
        "name string, id long, x double, y double, z double",
    )


def test_grid_neighbours_equal_all_pairs(spark):
    p = _points(spark)
    key = lambda df: sorted((r["name"], r["src"], r["dst"], r["rank"], round(r["dist"], 6)) for r in df.collect())
    full = key(G.knn_graph(p, 5))
    assert full == key(G.knn_graph(p, 5, small=0)) == key(G.knn_graph(p, 5, small=59)) and len(full) == 2 * 60 * 5
    assert all(r[1] == r[2] for r in full if r[3] == 1)


def test_brute_force_neighbours(spark):
    p = _points(spark, 25, ("a",))
    rows = p.collect()
    for src in rows[:5]:
        best = sorted(rows, key=lambda r: (round(math.sqrt(sum((src[c] - r[c]) ** 2 for c in "xyz") + 1e-6), 6), r["id"]))[:4]
        mine = [r["dst"] for r in G.knn_graph(p, 4).filter(F.col("src") == src["id"]).orderBy("rank").collect()]
        assert mine == [r["id"] for r in best]


def test_masked_pairs_are_far(spark):
    p = spark.createDataFrame(
        [("a", 0, 0.0, 0.0, 0.0, 1), ("a", 1, 1.0, 0.0, 0.0, 0), ("a", 2, 5.0, 0.0, 0.0, 1)],
        "name string, id long, x double, y double, z double, mask int",
    )
    assert [r["dst"] for r in G.masked_knn(p, 2).filter("src = 0").orderBy("rank").collect()] == [0, 1]
    assert [r["dst"] for r in G.masked_knn(p, 3).filter("src = 2").orderBy("rank").collect()][0] == 2


def test_probabilities(spark):
    df = spark.createDataFrame([([float(i % 5) for i in range(21)],)], "logits array<double>")
    row = df.select(
        arrays.softmax(F.col("logits")).alias("p"),
        arrays.log_softmax(F.col("logits")).alias("l"),
        arrays.temperature_probs(
            F.col("logits"),
            F.lit(0.5),
            F.array_repeat(F.lit(0.0), 21),
            F.array_repeat(F.lit(0.0), 21),
            arrays.letter_mask("X"),
        ).alias("t"),
    ).first()
    assert abs(sum(row["p"]) - 1) < 1e-12 and all(abs(math.log(p) - x) < 1e-12 for p, x in zip(row["p"], row["l"], strict=True))
    assert row["t"][20] == 0.0 and abs(sum(row["t"]) - 1) < 1e-12


def test_draw_is_the_inverse_of_the_running_sum(spark):
    df = spark.createDataFrame([([0.25, 0.5, 0.25], u) for u in (0.0, 0.25, 0.26, 0.75, 0.76, 1.0)], "p array<double>, u double")
    assert [r[0] for r in df.select(arrays.draw(F.col("p"), F.col("u"))).collect()] == [0, 0, 1, 1, 2, 2]


def test_draws_from_running_sums(spark):
    rows = [([0.1, 0.2, 0.3, 0.4], i / 40) for i in range(41)] + [([0.0, 1.0], 0.0), ([0.5, 0.5], 1.5)]
    df = spark.createDataFrame(rows, "p array<double>, u double")
    assert df.filter(arrays.draw(F.col("p"), F.col("u")) != arrays.draw_from(arrays.running(F.col("p")), F.col("u"))).count() == 0


def test_tied_samples_agree(spark):
    rows = [
        (
            "a",
            g,
            k,
            2 * g + k,
            1.0 - 1.5 * k,
            [float((i * (g + 2)) % 7) for i in range(21)],
            [0.0] * 21,
            3,
            int(g != 1),
        ) for g in range(4) for k in range(2)
    ]
    members = spark.createDataFrame(
        rows,
        "name string, group_id int, member int, pos int, beta double, logits array<double>, bias array<double>, native_idx int, design int",
    )
    drawn = S.tied_sample(members, 0.5, lambda g: (g % 10) / F.lit(10.0))
    assert drawn.count() == 8
    assert all(r["consistent"] for r in S.tied_consistency(drawn.withColumnRenamed("idx", "aa"), ["name", "group_id"]).collect())
    assert {r["idx"] for r in drawn.filter("group_id = 1").collect()} == {3}


def test_tied_groups_follow_their_list(spark):
    """The first kept member in the list gives the letter; the last member's omitted letters count."""
    flat, none = [0.0] * 21, [0.0] * 21
    only = lambda i: [0.0 if j == i else 1.0 for j in range(21)]
    rows = [
        ("a", 0, 1, 10, 1.0, flat, none, 4, 0, only(1)),
        ("a", 0, 0, 20, 1.0, flat, none, 9, 0, only(1)),
        ("a", 1, 1, 5, 1.0, flat, none, 3, 1, only(7)),
        ("a", 1, 0, 6, 1.0, flat, none, 3, 1, only(8)),
    ]
    members = spark.createDataFrame(
        rows,
        "name string, group_id int, member int, pos int, beta double, logits array<double>, bias array<double>, native_idx int, design int, omit_mask array<double>",
    )
    got = S.tied_sample(members, 0.5, lambda g: F.lit(0.5)).collect()
    assert {r["idx"] for r in got if r["group_id"] == 0} == {9} and {r["idx"] for r in got if r["group_id"] == 1} == {7}
    ranked = spark.createDataFrame(
        [("a", 1, 0, 0, 5), ("a", 2, 7, 1, 1), ("a", 3, 7, 0, 9), ("a", 4, None, 0, 2)],
        "name string, pos int, group_id int, member int, decode_rank int",
    )
    assert [r["pos"] for r in G.tied_decoding_order(ranked).orderBy("tied_rank").collect()] == [3, 2, 4, 1]


def test_recovery_ignores_unknown(spark):
    df = spark.createDataFrame([(1, "ACXD", "ACAE"), (2, "XX", "AC"), (3, "AC", "A")], "id int, native string, sequence string")
    got = [r["recovery"] for r in S.seq_recovery(df, ["id"]).orderBy("id").collect()]
    assert got[0] == pytest.approx(2 / 3) and got[1] is None and got[2] == 0.5


def test_scores_without_positions_are_null(spark):
    df = spark.createDataFrame([("a", [-1.0] * 21, 0, 0), ("b", [-2.0] * 21, 1, 1)], "name string, log_probs array<double>, idx int, mask int")
    assert {r["name"]: r["score"] for r in S.nll_scores(df, ["name"]).collect()} == {"a": None, "b": 2.0}


def test_fixed_chains(spark):
    chains = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "A")], "name string, chain string")
    designed = spark.createDataFrame([("x", "B")], "name string, chain string")
    assert sorted(tuple(r) for r in C.fixed_chains(chains, designed).select("name", "chain", "role").collect()) == [("x", "A", "fixed"), ("x", "B", "designed"), ("y", "A", "designed")]


def test_modes_and_lists_are_checked(spark):
    with pytest.raises(ValueError):
        C.design_mask(spark.range(1), "other")
    with pytest.raises(ValueError):
        C.tied_lists(spark.range(1), ["A", "B"], [[1], [1, 2]])
    with pytest.raises(ValueError):
        C.tied_weighted(spark.range(1), {})


def test_batches_lose_nothing(spark):
    df = spark.createDataFrame([(f"s{i}", 10 + i * 7 % 90) for i in range(50)], "name string, length long")
    got = S.length_batches(df, 200).collect()
    assert len(got) == 50
    sizes = {}
    for r in got:
        sizes.setdefault((r["bucket"], r["batch"]), []).append(r["length"])
    assert all(len(v) == 1 or len(v) * max(v) <= 200 for v in sizes.values())


def test_pssm_order(spark):
    df = spark.createDataFrame([([float(i) for i in range(20)],)], "v array<double>")
    moved = df.select(C.permute_pssm(F.col("v"))).first()[0]
    assert [moved[MODEL_ORDER.index(c)] for c in "ARNDCQEGHILKMFPSTWYV"] == [float(i) for i in range(20)] and moved[20] == 0.0


def counting_scorer():
    """Tells, with each row, which load and which call of it gave the row."""
    import os
    import uuid

    import pandas as pd

    load, calls = f"{os.getpid()}-{uuid.uuid4().hex}", []

    def score(pdf):
        calls.append(len(pdf))
        assert len(set(pdf.groupby("name").size())) == 1  # padded to one length
        return pd.DataFrame({"name": pdf["name"], "global_pos": pdf["global_pos"], "load": load, "call": len(calls), "aa": pdf["aa"]})

    return score


def test_scorer_runs_on_packed_batches(spark):
    """Short structures share calls, a long one has its own, and each worker makes the scorer once."""
    sizes = {f"s{i:03d}": 3 + i % 6 for i in range(120)} | {"long": 900}
    rows = [(n, i, "ACDEF"[i % 5], i % 2) for n, size in sizes.items() for i in range(size)]
    df = spark.createDataFrame(rows, "name string, global_pos long, aa string, mask int")
    got = S.score_with_model(df, "name string, global_pos long, load string, call int, aa string", counting_scorer, 64).collect()
    assert sorted((r["name"], r["global_pos"], r["aa"]) for r in got) == sorted(r[:3] for r in rows)
    loads, calls = {r["load"] for r in got}, {}
    for r in got:
        calls.setdefault((r["load"], r["call"]), set()).add(r["name"])
    assert len(loads) == len({x.split("-")[0] for x in loads})
    assert {"long"} in calls.values() and 10 < len(calls) < 40 and sum(map(len, calls.values())) == 121
    assert S.score_with_model(df.limit(0), "name string, global_pos long, load string, call int, aa string", counting_scorer).count() == 0


def test_many_poses_are_numbered(spark):
    from strandframe.operators.ranks import dense_numbered

    poses = spark.range(150_000).select(F.concat(F.lit("p"), F.lpad(((F.col("id") * 7919) % 120_011).cast("string"), 6, "0")).alias("pose"), "id")
    got = dense_numbered(poses, "pose", "i").agg(F.max("i"), F.count("*"), F.count_if(F.col("i") != F.substr("pose", F.lit(2)).cast("int") + 1)).first()
    assert tuple(got) == (120_011, 150_000, 0)


def _results(spark, n=400):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.6 else f"p{rng.randint(0, 5)}", f"S{rng.randint(0, 300)}", None if rng.random() < 0.02 else round(rng.random(), 2), i) for i in range(n)]
    return spark.createDataFrame(rows, "pose string, sequence string, score double, sample_id long"), rows


def _tops(rows, k):
    out = {}
    for pose in {r[0] for r in rows}:
        own = sorted((r[2], r[1]) for r in rows if r[0] == pose and r[2] is not None)
        out[pose] = (own[0][0], sum(r[0] == pose for r in rows), own[:k])
    return out


def test_stream_equals_batch_after_a_failed_epoch(spark, tmp_path):
    from strandframe.streaming import leaderboard

    df, rows = _results(spark)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    schema, to, tried = "pose string, sequence string, score double, sample_id long", str(tmp_path / "out"), []

    def fails_once(changed, epoch, to):
        if epoch == 2 and not tried:
            tried.append(epoch)
            leaderboard.merge(changed.limit(1), epoch, to)  # half written
            raise RuntimeError("lost")
        leaderboard.merge(changed, epoch, to)

    with pytest.raises(Exception, match="lost"):
        leaderboard.run(spark, str(tmp_path / "in"), schema, to, 3, fails_once)
    as_map = lambda b: {r["pose"]: (r["best"], r["n"], [(t["score"], t["sequence"]) for t in r["top"]]) for r in b.collect()}
    board = leaderboard.run(spark, str(tmp_path / "in"), schema, to, 3, fails_once)
    assert tried and as_map(board) == _tops(rows, 3)
    assert {(r["pose"], r["best"], r["n"]) for r in leaderboard.board(df).collect()} == {(p, b, n) for p, (b, n, _) in _tops(rows, 3).items()}
    more, added = _results(spark, 50)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # later files go on from the state
    assert as_map(leaderboard.run(spark, str(tmp_path / "in"), schema, to, 3)) == _tops([*rows, *added], 3)
    leaderboard.compact(spark, to, str(tmp_path / "small"))
    assert as_map(leaderboard.read(spark, str(tmp_path / "small"), 3)) == _tops([*rows, *added], 3)
