"""Ranked lexical search: a document FP-tree of restricted term vectors, searched by depth-first branch and bound.

A document's vector holds only the terms of the queries, with their counts, the most frequent term first, so documents that share frequent terms share a path of
the tree. Documents are range-partitioned by the head of their vector and by doc_id, and sorted by it, so a subtree is a run of documents and copies go over as many tasks as they need. In a task,
trees of bounded size are built one after the other. A node knows, of each term below it, the largest tf, and the least m of its documents: with these an item's
score in the subtree has an upper bound. A search goes down the children with the best bounds first and leaves out every subtree whose bound is below
the item's k-th best score so far, which passes from tree to tree; a leaf's documents are scored exactly. Each task gives its k best of every item, and windows over (item,
part), then over the item, leave the k best of all.

The queries are worked on in blocks of about ``block_terms`` terms, which bounds the vocabulary that goes to every task; a block is one pass over
the documents. Counts (N, L, n, df) are of all documents, exact, and all arithmetic after the weights is in 64-bit integers.

Terms are runs of digits, letters A-Z in lower case, and any character beyond ASCII; null and empty texts have none, and don't count for N. Each different pair of
item_id and text is an item; an item without terms, or whose terms no document holds, has no rows. Repeated documents are documents of their own, in any order among rows of equal id;
a null doc_id comes before all others. Other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Documents and postings of a tree at most; documents of a leaf; a child of over this part of its parent's documents is no node of its own.
TREE_DOCS, TREE_POSTINGS, LEAF_DOCS, NODE_PART = 8192, 1 << 21, 24, 0.75
#: Leading terms in the key that documents are dealt by, parts that tasks' results are first merged in.
KEY_TERMS, PARTS = 24, 64
NO_ID = -(2**63)

_SPACED = bytes(b if b >= 0x80 or 0x30 <= b < 0x3A or 0x61 <= b < 0x7B else b + 32 if 0x41 <= b < 0x5B else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


def _id(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and tfs (those of the vocabulary, by rising number) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, width = shared.value.get, len(shared.value) + 1
        for batch in batches:
            for part in common.text_slices(batch):
                flat, sizes = [], []
                for text in part.column(1).to_pylist():
                    words = terms(text)
                    sizes.append(len(words))
                    flat.extend(map(number, words, repeat(-1)))
                found = np.array(flat, dtype=np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                keys, tf = np.unique((row * width + found)[found >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1) * width).astype(np.int32))
                lists = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % width, tf))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, type=pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(_id("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy()).astype(np.int64)


def by_frequency(found: DataFrame, place: np.ndarray) -> DataFrame:
    """The same vectors with the terms' places in the order of frequency, sorted by them; those without a term go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _lists(batch.column(2))
            tf, _ = _lists(batch.column(3))
            at = place[flat]
            order = np.lexsort((at, np.repeat(np.arange(len(sizes)), sizes)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(np.int32))) for x in (at, tf))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "m", "terms", "tfs"])

    return found.filter(F.size("terms") > 0).mapInArrow(run, "doc_id long, m long, terms array<int>, tfs array<int>")


def part_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Tree:
    """The FP-tree of documents in the order of their vectors (terms, tfs of all, sizes of each)."""

    def __init__(self, doc_id: np.ndarray, m: np.ndarray, term: np.ndarray, tf: np.ndarray, sizes: np.ndarray):
        self.doc_id, self.m, self.term, self.tf = doc_id, m, term, tf
        self.at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.exact = part_score(tf, np.repeat(m, sizes))
        self.lo, self.hi, self.children, self.bounds, self.scored = [], [], [], [], 0
        self.root = self._node(0, len(doc_id))
        of = np.repeat(np.arange(len(self.bounds)), [len(t) for t, _ in self.bounds])
        every = np.concatenate([t for t, _ in self.bounds])
        least = np.array([self.m[lo:hi].min() for lo, hi in zip(self.lo, self.hi, strict=True)], dtype=np.int64)
        best = part_score(np.concatenate([x for _, x in self.bounds]), least[of])
        order = np.argsort(every, kind="stable")
        self.by_term, self.node, self.best = every[order], of[order], best[order]
        self.bounds = []

    def _common(self, lo: int, hi: int) -> int:
        """Terms that all documents of a run begin with: as it is sorted, those its first and last have in common."""
        a, b = self.term[self.at[lo] : self.at[lo + 1]], self.term[self.at[hi - 1] : self.at[hi]]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _parts(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The runs below the path that a run shares: one for each next term, and one of the documents that end there."""
        depth = self._common(lo, hi)
        ends = self.at[lo + 1 : hi + 1] - self.at[lo:hi] == depth
        following = np.where(ends, -1, self.term[np.minimum(self.at[lo:hi] + depth, len(self.term) - 1)])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(following)) + 1, [hi - lo]]) + lo
        return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def _node(self, lo: int, hi: int) -> int:
        me = len(self.lo)
        self.lo.append(lo)
        self.hi.append(hi)
        self.children.append(())
        self.bounds.append(None)
        if hi - lo > LEAF_DOCS:
            children, small, todo = [], None, [(lo, hi)]
            while todo:
                a, b = todo.pop()
                if b - a > (hi - lo) * NODE_PART and len(parts := self._parts(a, b)) > 1:
                    todo += parts[::-1]
                elif small and small[1] == a and b - small[0] <= LEAF_DOCS:  # small neighbours share a leaf
                    small = (small[0], b)
                else:
                    children += [small] if small else []
                    small = (a, b)
            children.append(small)
            if len(children) > 1:
                self.children[me] = tuple(self._node(a, b) for a, b in children)
        if self.children[me]:
            term, tf = (np.concatenate([self.bounds[c][i] for c in self.children[me]]) for i in (0, 1))
        else:
            term, tf = self.term[self.at[lo] : self.at[hi]], self.tf[self.at[lo] : self.at[hi]]
        order = np.argsort(term, kind="stable")
        term, tf = term[order], tf[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        self.bounds[me] = (term[first], np.maximum.reduceat(tf, first))
        return me

    def search(self, item: np.ndarray, weight: np.ndarray, dense: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, doc_ids) among those of best and this tree's, for an item's terms and weights. dense has a weight of 0 for every term, and again so at the end."""
        lo, hi = np.searchsorted(self.by_term, item, side="left"), np.searchsorted(self.by_term, item, side="right")
        sizes = hi - lo
        if not sizes.any():
            return best
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        bound = np.zeros(len(self.lo), dtype=np.int64)
        np.add.at(bound, self.node[at], self.best[at] * np.repeat(weight, sizes))
        dense[item] = weight
        stack = [self.root]
        while stack:
            node = stack.pop()
            if bound[node] <= 0 or (len(best[0]) == k and bound[node] < best[0][-1]):
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bound.__getitem__)
                continue
            a, b = self.lo[node], self.hi[node]
            p, q = self.at[a], self.at[b]
            self.scored += b - a
            score = np.add.reduceat(dense[self.term[p:q]] * self.exact[p:q], self.at[a:b] - p)
            found = np.flatnonzero(score > 0) if len(best[0]) < k else np.flatnonzero((score > 0) & (score >= best[0][-1]))
            if len(found):
                scores, ids = np.concatenate([best[0], score[found]]), np.concatenate([best[1], self.doc_id[a + found]])
                order = np.lexsort((ids, -scores))[:k]
                best = scores[order], ids[order]
        dense[item] = 0
        return best


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    """Trees of neighbouring rows (doc_id, m, terms, tfs), of TREE_DOCS rows and TREE_POSTINGS postings at most, or of one row."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            n = len(part.column(2).flatten())
            if held and (docs + part.num_rows > TREE_DOCS or postings + n > TREE_POSTINGS):
                yield _tree(held)
                held, docs, postings = [], 0, 0
            held.append(part)
            docs, postings = docs + part.num_rows, postings + n
    if held:
        yield _tree(held)


def _tree(parts: list[pa.RecordBatch]) -> Tree:
    lists = [(_lists(p.column(2)), _lists(p.column(3))[0]) for p in parts]
    ids, m = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts]) for i in (0, 1))
    return Tree(ids, m, np.concatenate([x[0][0] for x in lists]), np.concatenate([x[1] for x in lists]), np.concatenate([x[0][1] for x in lists]))


def item_blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """The different items (item_id, text) with their terms' counts, in blocks of about block_terms terms."""
    pairs = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_terms)))  # a term and its separator take some six bytes
    for i in range(blocks):
        rows = pairs.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()
        yield sorted(((r["item_id"], Counter(terms(r["text"].encode()))) for r in rows), key=lambda x: (x[0] is not None, x[0], sorted(x[1].items())))


def _search_block(docs: DataFrame, items: list[tuple[int | None, Counter]], k: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in items for t in c}))}
    found = common.cut(vectors(docs, vocabulary), "ranked-vectors")
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs or not vocabulary:
        return None
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for term, n in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each of the block's terms
        df[term] = n
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df]
    place = np.empty(len(df), dtype=np.int64)
    place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    queries = []
    for _, counts in items:
        own = sorted((int(place[vocabulary[t]]), weight[vocabulary[t]] * c) for t, c in counts.items() if df[vocabulary[t]])
        queries.append((np.array([x[0] for x in own], dtype=np.int64), np.array([x[1] for x in own], dtype=np.int64)))
    shared = spark.sparkContext.broadcast((queries, len(df)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, width = shared.value
        dense, none = np.zeros(width, dtype=np.int64), np.zeros(0, dtype=np.int64)
        best = [(none, none)] * len(queries)
        for tree in _trees(batches):
            best = [tree.search(*q, dense, k, b) if len(q[0]) else b for q, b in zip(queries, best, strict=True)]
        of = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        scores, ids = (np.concatenate([none, *(b[i] for b in best)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int64)), pa.array(ids), pa.array(scores)], names=["item", "doc_id", "score"])

    m = F.expr(f"75L + (25L * n * {n_docs}L) div {n_terms}L").alias("m")
    dealt = by_frequency(found.select("doc_id", m, "terms", "tfs"), place).repartitionByRange(F.slice("terms", 1, KEY_TERMS), "doc_id").sortWithinPartitions("terms", "doc_id")
    tops = dealt.mapInArrow(run, "item long, doc_id long, score long").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    order = (F.desc("score"), F.asc("doc_id"))
    first = tops.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k).drop("rank", "part")
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(x[0] for x in items)), "item long, item_id long")
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", doc_id, "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 500_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of docs (doc_id, text) for each row of items (item_id, text)."""
    found = [x for block in item_blocks(items, block_terms) if (x := _search_block(docs, block, k)) is not None]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.docs_of(spark, sf_dir), common.docs_of(spark, sf_dir, "benchmark"))


_SQL_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLE = {
    "op11_ranked_search": f"""
WITH q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark) AS a GROUP BY item_id, term),
d AS (SELECT doc_id, {_SQL_TERMS} AS ts FROM documents),
s AS (SELECT doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
z AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM s),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) AS b WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, z GROUP BY term, n_docs),
g AS (SELECT q.item_id, t.doc_id, CAST(sum(q.r * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * s.n * z.n_docs) // z.n_terms)))) AS BIGINT) AS score
  FROM q JOIN t ON t.term = q.term JOIN w ON w.term = q.term JOIN s ON s.doc_id = t.doc_id, z GROUP BY q.item_id, t.doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""
}
