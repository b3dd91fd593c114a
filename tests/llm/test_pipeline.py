"""The corpus pipeline against a brute-force version of its stages."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from strandframe.llm import compression

from .test_dedup import _brute_components, _brute_decon, _brute_fp, _brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(30)) for i in range(6)]
    docs = []
    for i in range(400):
        t = "\n".join(text(rng.randint(10, 60)) for _ in range(rng.randint(1, 4)))
        if i % 6 == 0:
            t = " ".join(x + "%%%" for x in t.split(" "))
        elif i % 9 == 0:
            t += "\nAll rights reserved by nobody"
        elif i % 11 == 0:
            t += "\n" + items[i % 6][1]
        elif i % 13 == 0 and i > 13:
            t = docs[i - 13][1] + " " + words[i % 900]
        docs.append((i, t, "en", "big" if i % 3 else f"s{i % 5}", len(t)))
    docs.append(docs[7])
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(
        docs,
        "doc_id long, text string, lang string, source string, n_chars long",
    ).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(
        [(i, int("%%%" not in docs[i][1]), 0) for i in range(300)],
        "doc_id long, quality int, toxic int",
    ).write.parquet(f"{path}/labels.parquet")
    return path, docs, items


def test_stages_match_brute_force(spark, tables):
    path, docs, items = tables
    frame = spark.read.parquet(f"{path}/documents.parquet")
    model = compression.learn_quality(frame, spark.read.parquet(f"{path}/labels.parquet"))
    chance = model.calibration(model.features([d[1].encode() for d in docs]))
    rows = [d for d, p in zip(docs, chance, strict=True) if p >= 0.3]
    assert not any("%%%" in d[1] for d in rows) and len(rows) > 300

    stage = dict(corpus_pipeline.STAGES)
    got = stage["quality_classifier"](spark, frame, path)
    assert got.columns == COLUMNS and sorted(tuple(r) for r in got.collect()) == sorted(rows)

    got = stage["line_dedup"](spark, got, path)
    kept = _brute_lines(rows, 10)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter({(k[0], k[3]): n for k, n in kept.items()}) and got.columns == COLUMNS
    rows = [(k[0], k[3]) for k, n in sorted(kept.items()) for _ in range(n)]

    got = stage["near_dedup"](spark, got, path)
    least = {}
    for r, c in zip(rows, _brute_components([_brute_fp(r[1]) for r in rows]), strict=True):
        least[c] = min(least.get(c, r), r)
    rows = sorted(least.values())
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == rows and got.columns == COLUMNS

    got = stage["benchmark_decontamination"](spark, got, path)
    rows = [r for r, x in zip(rows, _brute_decon([r[1] for r in rows], items), strict=True) if not x[1]]
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == rows

    mixed = stage["mixing"](spark, got, path).collect()
    assert {(r["doc_id"], r["text"]) for r in mixed} == set(rows)
    final = corpus_pipeline.run(spark, path).collect()
    assert Counter((r["doc_id"], r["epoch"]) for r in final) == Counter((r["doc_id"], r["epoch"]) for r in mixed)


def test_odd_rows_and_columns_pass(spark, tables, tmp_path):
    """Null and empty texts, null ids and repeated rows crash no stage; columns of any name come through as they are; clean documents stay."""
    _, docs, items = tables
    clean = [d for d in docs[:60] if d[0] % 6 and "%%%" not in d[1] and d[0] % 9 and d[0] % 11 and d[0] % 13]
    odd = [(None, None, None, None, None), (500, None, "en", "s1", None), (501, "", "en", None, 0), (502, "   \n\n", "en", "s1", 5), (None, "a few words of a text without an id", "en", "s2", 35), (503, "w" * 50_000, "en", "s2", 50_000)]
    rows = [(*d, "mine", f"own {d[0]}", 1.5) for d in [*docs, *odd, odd[1], clean[0]]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_dropped string, fp double"
    path = str(tmp_path)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int("%%%" not in docs[i][1]), 0) for i in range(300)]
    spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, path)
        assert frame.columns == [c.split()[0] for c in schema.split(", ")]
    got = corpus_pipeline.run(spark, path).collect()
    assert {r["n_lines"] for r in got} == {"mine"} and {r["fp"] for r in got} == {1.5} and all(r["n_dropped"] == f"own {r['doc_id']}" for r in got)
    assert {d[0] for d in clean} <= {r["doc_id"] for r in got}
    assert sum(r["doc_id"] == clean[0][0] and r["epoch"] == 1 for r in got) == 1  # of repeated rows one stays


def test_empty_tables_give_no_rows(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and set(COLUMNS) < set(got.columns)
