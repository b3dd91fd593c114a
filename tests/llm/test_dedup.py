"""Line dedup, SimHash and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandframe.llm import compression, decontaminate, linededup, mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, _k1 string, _lost string, _n string, n_lines string"
OWN = ["own"] * 5
ASCII_LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = []
    for i in range(120):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        if i % 7 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["  Accept ALL cookies\t", "accept all cookies", "ACCEPT all Cookies\x0b"]))
        if i % 5 == 0:
            lines.append("Share this: ÀÉ")
        texts.append("\n".join(lines))
    base = " ".join(rng.choice(words) for _ in range(200))
    for i in range(60):  # near copies with one word changed
        w = base.split(" ")
        w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [base] * 12 + ["x y", "x  Y", "x\ty", "", "", None, None, "   ", "\n\n", " ".join(rng.choice(words) for _ in range(30000)), "a" * 50000]
    return texts


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", f"s{i % 3}", 1, *OWN) for i, t in enumerate(_texts())]
    return out + [out[3], out[3], (None, "no id at all", None, None, None, *OWN)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _brute_lines(rows, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOW)
    held = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    out = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (key(x) and held[key(x)] >= min_docs)]
        out[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize(("shard_lines", "min_docs"), [(500_000, 10), (7, 10), (7, 2), (1, 3)])
def test_line_dedup(docs, rows, shard_lines, min_docs):
    """With few lines to a shard, common lines have their shards copied; arrays of few keys go to every task, with the same rows."""
    for keys in (0, 1_000_000):
        got = linededup.drop_common_lines(docs, min_docs, shard_lines=shard_lines, broadcast_keys=keys).collect()
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == _brute_lines(rows, min_docs)
        assert {r["fp"] for r in got} == {"own"}
        kept = linededup.drop_common_lines(docs, min_docs, n_lines="total", n_dropped="gone", broadcast_keys=keys)
        assert kept.columns == [*docs.columns, "total", "gone"] and {r["n_lines"] for r in kept.collect()} == {"own"}


def test_reserved_names_are_rejected(docs):
    for stage in (linededup.drop_common_lines, simhash.keep_one_of_each, lambda d: decontaminate.keep_clean(d, d), mixing.mixture, lambda d: compression.keep_good(d, d)):
        with pytest.raises(ValueError, match="_strand_x"):
            stage(docs.withColumn("_strand_x", F.lit(1)))


def test_blank_and_repeated_lines_do_not_travel(spark):
    """A corpus of blank lines, or of one document's repeated line, gives one probe for each document and key."""
    docs = spark.createDataFrame([(i, "\n \n\t\n" * 50 + f"same\nSAME \nown {i % 6}\n" * 40) for i in range(12)], "doc_id long, text string")
    keyed = docs.withColumns({"_strand_k1": F.col("doc_id"), "_strand_k2": F.col("doc_id")})
    assert linededup._probes(keyed, 8, 1).count() == 12 * 2
    got = linededup.drop_common_lines(docs, 10).collect()
    assert {(r["n_lines"], r["n_dropped"]) for r in got} == {(271, 80)} and all("ame" not in r["text"] for r in got)


def test_line_dedup_of_nothing(docs):
    assert linededup.drop_common_lines(docs.filter(F.lit(False))).collect() == []


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(5)
    h1, h2 = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    n = rng.integers(1, 99, 5000)
    made = linededup.PerfectHash.of(*linededup.PerfectHash.build(h1, h2, n).parts())
    assert sorted(made.index(h1, h2)) == list(range(5000))
    assert (made.count(h1, h2) == n).all() and not made.count(h1, h2 + np.uint64(1)).any()


def _brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOW))
    s = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute_components(fps, distance=3):
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return [find(f) for f in fps]


def test_crowded_buckets_meet_on_longer_keys(spark):
    """Thousands of fingerprints with half their bits in common: components equal brute force, and few rows are made of each."""
    rng = random.Random(2)
    fps = {0x1234_5678 << 32 | rng.getrandbits(32) for _ in range(2500)}
    for fp in list(fps)[:600]:
        fps.add(fp ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    values = np.array(fps, dtype=np.uint64)
    for blocks in ((6, 8), (6,)):
        edges = simhash.links(frame, 3, blocks, 512)
        roots = {r["fp"]: r["root"] for r in simhash.components(edges).collect()}
        parent = {simhash._signed(x): simhash._signed(x) for x in fps}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x in fps:
            near = np.bitwise_count(values ^ np.uint64(x)) <= 3
            for y in values[near].tolist():
                a, b = sorted((find(simhash._signed(x)), find(simhash._signed(y))))
                parent[b] = a
        assert all(roots.get(x, x) == find(x) for x in parent)
    assert edges.count() >= simhash.links(frame, 3, (6, 8), 512).count() > 300


@pytest.mark.parametrize("small_bucket", [512, 2])
def test_simhash(docs, rows, small_bucket):
    got = simhash.near_duplicates(docs, small_bucket=small_bucket, hot_docs=3 if small_bucket == 2 else 10_000).collect()
    fps = [_brute_fp(r[1]) for r in rows]
    roots = _brute_components(fps)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = Counter((r[0], f, least.get(c)) for r, f, c in zip(rows, fps, roots, strict=True))
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want
    assert len({r["component_id"] for r in got}) < len(rows) - 60


def test_simhash_keeps_one_row_of_each_group(docs, rows):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    groups = len(set(_brute_components([_brute_fp(r[1]) for r in rows])))
    assert kept.count() == groups
    assert simhash.near_duplicates(docs.filter(F.lit(False))).collect() == []


def test_masks_cover_all_close_pairs():
    masks = simhash.block_masks(6, 3)
    rng = random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(flips & m == 0 for m in masks)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _brute_decon(texts, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(ASCII_LOW))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    lengths = {len(w) for w in windows}
    for t in texts:
        w = WORD.findall((t or "").translate(ASCII_LOW))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        yield len(w), len(hit), sorted(map(str, found))


def test_decontamination(spark, docs, rows):
    long = next(r[1] for r in rows if r[1] and len(r[1]) > 100_000)
    words = WORD.findall(long)
    texts = [r[1] for r in rows if r[1]]
    items = [(1, " ".join(words[100:130])), (2, " ".join(words[5000:5300]).upper()), (3, texts[40]), (4, texts[125]), (5, "x y"), (6, "Share this"), (7, None), (8, "..."), (9, words[7]), (10, " ".join(words[100:104])), (11, texts[40]), (12, "never said here at all by anyone in any text of it"), (20, "é " * 14)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, piece=32, most=3).collect()
    want = Counter((r[0], *x[:2], ",".join(x[2])) for r, x in zip(rows, _brute_decon([r[1] for r in rows], items), strict=True))
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in got) == want
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.count() == sum(n for k, n in want.items() if k[2] == 0) and clean.columns == docs.columns


def test_decontamination_of_and_with_nothing(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.contamination(docs, none).collect()} == {0}
    assert decontaminate.contamination(docs.filter(F.lit(False)), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_query_digest(spark, tmp_path, docs, rows):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "accept all cookies")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = decontaminate.op7_decontaminate(spark, str(tmp_path)).filter("contaminated").collect()
    assert got and {r["items_sha256"] for r in got} == {hashlib.sha256(b"1").hexdigest()}
