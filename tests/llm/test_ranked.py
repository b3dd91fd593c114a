"""Ranked search against brute force: ties, copies, nulls, blocks of queries, and that subtrees are left out."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandframe.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _terms(text):
    return TERM.findall((text or "").translate(LOW))


def _brute(docs, items, k):
    vectors = [(i, Counter(_terms(t))) for i, t in docs]
    sizes = [c.total() for _, c in vectors]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in vectors for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for (doc, c), n in zip(vectors, sizes, strict=True):
            score = 0
            for t, r in Counter(_terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += r * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéß9") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    make = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, make(rng.choice([1, 5, 40, 200]))) for i in range(900)]
    copy = make(60)
    docs += [(i, copy) for i in range(900, 1400)] + [(1400, None), (1401, ""), (1402, " .,\x00-"), (1403, "É é Ab-aB\x7fcd_e"), (None, make(30)), (1404, make(60000)), docs[7], docs[7]]
    items = [(i, make(rng.choice([1, 3, 30]))) for i in range(40)] + [(40, copy), (41, None), (42, ""), (43, "zzzz none of these"), (44, "ab AB éß cd"), (44, make(9)), (None, make(5))]
    return docs, [*items, items[3]]


def _rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def _tables(spark, docs, items):
    wide = spark.createDataFrame([(*d, "m", "t", 1) for d in docs], "doc_id long, text string, m string, terms string, n int").repartition(9)
    return wide, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")


@pytest.mark.parametrize(("k", "block_terms"), [(20, 500_000), (3, 60)])
def test_search(spark, texts, k, block_terms):
    docs, items = texts
    assert _rows(ranked.search(*_tables(spark, docs, items), k, block_terms)) == _brute(docs, items, k)


def test_empty_tables(spark, texts):
    docs, items = _tables(spark, *texts)
    assert ranked.search(docs.limit(0), items).count() == ranked.search(docs, items.limit(0)).count() == 0
    assert ranked.search(docs.filter("doc_id IN (1400, 1401)"), items).count() == 0


def test_tree_prunes_and_keeps_all():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 30, 6000)
    vectors = sorted(tuple(sorted(set((rng.pareto(0.6, n) * 3).astype(int) % 400))) for n in size.tolist())
    sizes = np.array([len(v) for v in vectors])
    term = np.concatenate([np.array(v) for v in vectors])
    tf, m = rng.integers(1, 5, len(term)), rng.integers(76, 140, len(vectors))
    ids = rng.permutation(len(vectors))
    tree = ranked.Tree(ids, m, term, tf, sizes)
    dense = np.zeros(400, dtype=np.int64)
    for _ in range(60):
        item = np.unique(rng.integers(0, 400, rng.integers(1, 20)))
        weight = 1 + item * 7
        best = tree.search(item, weight, dense, 20, (np.zeros(0, dtype=np.int64),) * 2)
        full = np.zeros(400, dtype=np.int64)
        full[item] = weight
        score = np.add.reduceat(full[term] * ranked.part_score(tf, np.repeat(m, sizes)), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        order = np.lexsort((ids, -score))[:20]
        order = order[score[order] > 0]
        assert np.array_equal(best[0], score[order]) and np.array_equal(best[1], ids[order]) and not dense.any()
    assert tree.scored < 60 * len(vectors) / 2
