"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distance.

A document's fingerprint is made of its 3-word shingles. Two fingerprints that differ in at most ``distance`` bits
agree on at least ``blocks - distance`` of ``blocks`` blocks, so a join on each choice of that many blocks finds them all.
Equal fingerprints meet in one aggregation before any join. A bucket of up to ``small_bucket`` fingerprints is joined
with itself; members of larger ones meet again on the longer keys of more blocks (56 rows a fingerprint). Only what is crowded even there, hundreds of different fingerprints
that agree in 40 bits, is linked through its members' neighbours (all masks of up to two bits), which takes rows in proportion
to the bucket and not to its square. Components come from label propagation over distinct fingerprints, and go back to the documents by fingerprint; those of a
thousandth of all documents or more are broadcast, as there are a thousand at most.

Null texts and texts without words have fingerprint zero and link like any other; repeated rows share a component;
a null doc_id is kept and never is a component's id unless all are null; other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_PART = 1 << 16


def _fingerprint(text: bytes) -> int:
    w = text.lower().split()  # bytes: ASCII only
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < 3 else map(b" ".join, zip(w, w[1:], w[2:], strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8")
    set_ = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), _PART):
        set_ += np.unpackbits(h[i : i + _PART].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _strand_k2 (hash of the text) and fingerprint (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch):
                made = pa.array([_fingerprint(t.as_py()) for t in part.column(2)], type=pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made], names=["doc_id", "_strand_k2", "fp"])

    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        common.row_key(F.col("doc_id"), F.col("text"))[1],
        F.col("text").cast("string").alias("text"),
    )
    return keyed.mapInArrow(run, "doc_id long, _strand_k2 long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    spans = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(spans, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, distance: int = 3, blocks: tuple[int, ...] = (6, 8), small_bucket: int = 512) -> DataFrame:
    """(a, b) of fingerprints (column fp, distinct) that keep every pair within distance in one component.

    blocks: how many a fingerprint is split into, at first, and for those in buckets of over small_bucket, which then meet on longer keys (six: 20 keys of some 32 bits; eight: 56 of 40).
    Those still crowded after the last go through neighbour values.
    """
    return common.cut(_links(distinct, distance, blocks, small_bucket).distinct(), "simhash-links")


def _links(distinct: DataFrame, distance: int, blocks: tuple[int, ...], small_bucket: int) -> DataFrame:
    masks = [_signed(m) for m in block_masks(blocks[0], distance)]
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("_b"),
    ).select("fp", "_b.t", "_b.key")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= distance
    full = common.cut(
        keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"),
        "simhash-buckets",
    )
    twos = full.filter("n = 2").filter(near(F.col("a"), F.col("b"))).select("a", "b")
    members = common.cut(keyed.join(full.filter("n > 2").select("t", "key", "n"), ["t", "key"]), "simhash-members")
    few = members.filter(F.col("n") <= small_bucket)
    pairs = (
        few.select("t", "key", F.col("fp").alias("a"))
        .join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
        .filter((F.col("a") < F.col("b")) & near(F.col("a"), F.col("b")))
        .select("a", "b")
    )
    crowd = members.filter(F.col("n") > small_bucket).select("fp").distinct()
    found = twos.unionByName(pairs)
    if crowd.isEmpty():
        return found
    crowd = common.cut(crowd, "simhash-crowd")
    return found.unionByName(_links(crowd, distance, blocks[1:], small_bucket) if blocks[1:] else _through_neighbours(crowd, distance))


def _through_neighbours(crowd: DataFrame, distance: int) -> DataFrame:
    """Links among crowded fingerprints: a value within ``distance // 2`` bits of one member (its anchor) and within the rest of the distance of
    another joins the two. All near members of a value are within the distance of its anchor, so a star keeps the component."""
    close, wide = distance // 2, distance - distance // 2
    flips = [_signed(sum(1 << i for i in c)) for k in range(wide + 1) for c in combinations(range(64), k)]
    values = crowd.select("fp", F.explode(F.lit(flips).cast("array<long>")).alias("m")).select(
        "fp",
        F.col("fp").bitwiseXOR(F.col("m")).alias("v"),
        F.bit_count("m").alias("d"),
    )
    anchors = values.filter(F.col("d") <= close).groupBy("v").agg(F.min("fp").alias("a"))
    return values.join(anchors, "v").filter("fp <> a").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for each end of an edge: root is its component's least value. Each round takes the least label of the neighbours, then
    the label's own label, so labels double their reach; it ends when no label changes."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    labels = common.cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("root")), "simhash-labels")
    while True:
        heard = both.join(labels.select(F.col("u").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("heard"))
        near = labels.join(heard, "u").select("u", "root", F.least("root", "heard").alias("new"))
        up = labels.select(F.col("u").alias("new"), F.col("root").alias("far"))
        nxt = common.cut(
            near.join(up, "new").select("u", F.least("new", "far").alias("root"), (F.least("new", "far") < F.col("root")).alias("moved")),
            "simhash-labels",
        )
        if not nxt.filter("moved").head(1):
            return nxt.select(F.col("u").alias("fp"), "root")
        labels = nxt.select("u", "root")


#: Fingerprints of over a thousandth of the documents, and of at least so many, are a thousand at most: these go to every task.
_HOT_DOCS = 10_000


def near_duplicates(docs: DataFrame, distance: int = 3, blocks: tuple[int, ...] = (6, 8), small_bucket: int = 512, hot_docs: int = _HOT_DOCS) -> DataFrame:
    """doc_id, _strand_k2, fp, component_id (least doc_id that links reach) for every row of docs."""
    made = common.cut(fingerprints(docs), "simhash-prints")
    distinct = common.cut(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), distance, blocks, small_bucket))
    linked = distinct.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    heads = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.cut(linked.join(heads, "root").select("fp", "component_id", "n"), "simhash-named")
    columns = ["doc_id", "_strand_k2", "fp", "component_id"]
    hot = max(hot_docs, (named.agg(F.sum("n")).first()[0] or 0) // 1000)
    few = F.broadcast(named.filter(F.col("n") > hot))
    return made.join(few, "fp").select(*columns).unionByName(made.join(few, "fp", "left_anti").join(named.filter(F.col("n") <= hot), "fp").select(*columns))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.docs_of(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with the least (doc_id, text hash) of each component; of wholly equal ones, one.

    What goes is joined to docs, as it is less than what stays: ids and hashes only, which Spark may broadcast where they are few.
    """
    common.unreserved(docs)
    # A component is known by its least doc_id; the least text hash decides where that id repeats.
    key = ["_strand_k1", "_strand_k2"]
    found = common.cut(
        near_duplicates(docs).select(
            F.coalesce("doc_id", F.lit(-(2**63))).alias("_strand_k1"),
            "_strand_k2",
            F.coalesce("component_id", F.lit(-(2**63))).alias("_strand_c"),
        ),
        "simhash-found",
    )
    heads = found.filter("_strand_k1 = _strand_c")
    repeated = heads.groupBy("_strand_c").agg(F.min("_strand_k2").alias("_strand_least"), F.count("*").alias("_strand_n")).filter("_strand_n > 1")
    repeated = common.cut(
        heads.join(repeated, "_strand_c").select(*key, (F.col("_strand_k2") == F.col("_strand_least")).alias("_strand_head")).distinct(),
        "simhash-repeated",
    )
    gone = common.cut(found.filter("_strand_k1 <> _strand_c").select(*key).unionByName(repeated.select(*key)).distinct(), "simhash-gone")
    k1, k2 = common.row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumns({"_strand_k1": k1, "_strand_k2": k2})
    kept = keyed.join(gone, key, "left_anti")
    if repeated.head(1):
        kept = kept.unionByName(keyed.join(repeated.filter("_strand_head"), key, "left_semi").dropDuplicates(key))
    return kept.select(*docs.columns)
