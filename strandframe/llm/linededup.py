"""Line dedup: a sharded minimal perfect hash over line hashes indexes fingerprint and count arrays that documents probe.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points
found in at least ``min_docs`` documents lose all their lines in every document.

1. Each document gives the 128-bit hash of each of its keys once; one aggregation, with partial sums, counts documents.
2. Keys of ``min_docs`` or more documents go to shards by hash; each shard is built into one minimal perfect hash, levelled bit arrays with ranks, over a 64-bit
   fingerprint array and a count array.
3. Where all arrays together hold ``broadcast_keys`` keys at most (counted first; 14 bytes each), they go to every task, and documents probe them where they are, in the pass that
   drops their lines: no text and no hash is shuffled.
4. Beyond that, each document's keys travel as hashes, once each, to their shard and stream past its arrays. A shard that expects more than ``shard_lines``
   probes, or twice its fair share, as it holds a line of very many documents, is copied to as many parts as it needs, and documents are dealt among them.
   What is found goes back to its document by the document's key, which is its id and a 64-bit hash of its text (documents equal in both are equal rows).

The number of shards follows the number of lines; both ways give the same rows. Null or empty text is one empty line; repeated rows each count as a document
and get equal results; null doc_ids are kept; other columns pass through, but those named as the two counts are replaced; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textkernel import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _keys(text: bytes) -> list[bytes]:
    return [line.strip() for line in text.lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _pair(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


class PerfectHash:
    """A minimal perfect hash: level after level, keys alone in their slot of a bit array take it; a slot's rank is the key's index."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts = sizes, bits, prints, counts
        taken = np.unpackbits(bits, bitorder="little")
        self.taken = taken.astype(bool)
        self.ranks = np.cumsum(taken, dtype=np.int64) - taken
        self.bases = np.concatenate([[0], np.cumsum(sizes)])

    @staticmethod
    def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(h1 + h2 * np.uint64(2 * level + 1) + _STEP * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> PerfectHash:
        sizes, planes, level = [], [], 0
        left1, left2 = h1, h2
        while len(left1):
            size = 2 * len(left1) + 7 & ~7
            slot = cls._slot(left1, left2, level, size)
            alone = np.bincount(slot, minlength=size) == 1
            planes.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            rest = ~alone[slot]
            left1, left2, level = left1[rest], left2[rest], level + 1
        made = cls(
            np.array(sizes, dtype=np.int64),
            np.concatenate(planes) if planes else np.zeros(0, np.uint8),
            np.zeros(len(h1), np.uint64),
            np.zeros(len(h1), np.uint32),
        )
        at = made.index(h1, h2)
        made.prints[at], made.counts[at] = h2, np.minimum(counts, 2**32 - 1)
        return made

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The index of each key, or of some key or -1 where it is none of those indexed."""
        out, left = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            slot = self._slot(h1[left], h2[left], level, int(size)) + self.bases[level]
            hit = self.taken[slot]
            out[left[hit]] = self.ranks[slot[hit]]
            left = left[~hit]
        return out

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents that hold each key; 0 where the fingerprint differs."""
        at = self.index(h1, h2)
        if not len(self.prints):
            return np.zeros(len(h1), dtype=np.int64)
        return np.where((at >= 0) & (self.prints[at] == h2), self.counts[at].astype(np.int64), 0)

    def parts(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.sizes.tobytes(), self.bits.tobytes(), self.prints.tobytes(), self.counts.tobytes()

    @classmethod
    def of(cls, sizes: bytes, bits: bytes, prints: bytes, counts: bytes) -> PerfectHash:
        return cls(np.frombuffer(sizes, np.int64), np.frombuffer(bits, np.uint8), np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32))


def _first_lines(keys: list[bytes], min_chars: int) -> dict[bytes, int]:
    """Each key that is long enough, with its first place. Empty lines, the most common of all, thus never travel."""
    first: dict[bytes, int] = {}
    for i, k in enumerate(keys):
        if k not in first and _long_enough(k, min_chars):
            first[k] = i
    return first


def _uint(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """h1, h2, n: documents that hold each line key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch):
                held: list[tuple[int, int]] = []
                for t in part.column(0):
                    held += {_pair(k) for k in set(_keys(t.as_py())) if _long_enough(k, min_chars)}
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], type=pa.int64()) for i in (0, 1)], names=["h1", "h2"])

    return (
        docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h1 long, h2 long").groupBy("h1", "h2").agg(F.count("*").alias("n"))
    )


def _shard(shards: int) -> Column:
    return F.pmod("h1", F.lit(shards)).cast("int")


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row for each shard: the arrays of its perfect hash, and the probes it expects of its keys."""

    def run(table: pa.Table) -> pa.Table:
        h1, h2, n = (_uint(table.column(c).combine_chunks()) for c in ("h1", "h2", "n"))
        made = PerfectHash.build(h1, h2, n)
        return pa.table(
            [
                pa.array([table.column("shard")[0].as_py()], type=pa.int32()),
                pa.array([int(n.sum())], type=pa.int64()),
                *(pa.array([x], type=pa.binary()) for x in made.parts()),
            ],
            names=["shard", "load", "sizes", "bits", "prints", "counts"],
        )

    return (
        counts.select(_shard(shards).alias("shard"), "h1", "h2", "n")
        .groupBy("shard")
        .applyInArrow(run, "shard int, load long, sizes binary, bits binary, prints binary, counts binary")
    )


def _probes(keyed: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """The hashes of each document's keys, once, with the place of the first line that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch):
                k1, k2, at, pairs = [], [], [], []
                for a, b, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    own = _first_lines(_keys(t.as_py()), min_chars)
                    pairs += map(_pair, own)
                    at += own.values()
                    k1 += [a] * len(own)
                    k2 += [b] * len(own)
                both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=kind) for x, kind in ((k1, pa.int64()), (k2, pa.int64()), (at, pa.int32()), (both[:, 0], pa.int64()), (both[:, 1], pa.int64()))], names=["_strand_k1", "_strand_k2", "line", "h1", "h2"])

    return (
        keyed.select("_strand_k1", "_strand_k2", "text")
        .mapInArrow(run, "_strand_k1 long, _strand_k2 long, line int, h1 long, h2 long")
        .withColumn("shard", _shard(shards))
    )


def _probe(index: DataFrame, probes: DataFrame, min_docs: int, most: int) -> DataFrame:
    """Documents and places of the lines that a shard's arrays count at min_docs or more. Each shard's arrays come before its probes, which stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, arrays = None, None
        for batch in batches:
            b = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            place = b["shard"].to_numpy(zero_copy_only=False).astype(np.int64) << 32 | b["part"].to_numpy(zero_copy_only=False).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1), len(place)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if b["sizes"][lo].is_valid:
                    held, arrays = place[lo], PerfectHash.of(*(b[c][lo].as_py() for c in ("sizes", "bits", "prints", "counts")))
                    lo += 1
                if lo < hi and held == place[lo]:
                    part = {c: b[c].slice(lo, hi - lo) for c in ("_strand_k1", "_strand_k2", "line", "h1", "h2")}
                    found = pa.array(arrays.count(_uint(part["h1"]), _uint(part["h2"])) >= min_docs)
                    yield pa.RecordBatch.from_arrays([part[c].filter(found) for c in ("_strand_k1", "_strand_k2", "line")], names=["_strand_k1", "_strand_k2", "line"])

    parts = (F.floor(F.col("load") / most) + 1).cast("int")
    crowded = index.select("shard", parts.alias("parts")).filter("parts > 1")
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("load")
    dealt = (
        probes.join(F.broadcast(crowded) if crowded.count() <= 100_000 else crowded, "shard", "left")
        .withColumn("part", F.pmod(F.xxhash64("_strand_k1", "_strand_k2"), F.coalesce("parts", F.lit(1))).cast("int"))
        .drop("parts")
    )
    both = (
        copies.unionByName(dealt, allowMissingColumns=True)
        .repartition("shard", "part")
        .sortWithinPartitions("shard", "part", F.col("sizes").isNull())
    )
    return both.select(
        "shard",
        "part",
        "sizes",
        "bits",
        "prints",
        "counts",
        "_strand_k1",
        "_strand_k2",
        "line",
        "h1",
        "h2",
    ).mapInArrow(run, "_strand_k1 long, _strand_k2 long, line int")


def _common(arrays: dict[int, PerfectHash], shards: int, keys: list[bytes], min_docs: int) -> set[bytes]:
    """Those of different keys that the arrays of their shards count at min_docs or more."""
    both = np.array([_pair(k) for k in keys], dtype=np.int64).reshape(-1, 2)
    shard, found = both[:, 0] % shards, []
    order = np.argsort(shard, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(shard[order])) + 1).tolist(), len(keys)]
    for own in (order[lo:hi] for lo, hi in zip(edges, edges[1:], strict=False) if lo < hi and int(shard[order[lo]]) in arrays):
        h = both[own].view(np.uint64)
        found += own[arrays[int(shard[own[0]])].count(h[:, 0].copy(), h[:, 1].copy()) >= min_docs].tolist()
    return {keys[i] for i in found}


def _rewritten(docs: DataFrame, names: list[str], gone, n_lines: str, n_dropped: str) -> DataFrame:
    """docs' columns names, text without the lines whose keys gone(slice) gives for each document (a set, or None), and how many lines there were and went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch):
                raws, texts, lines, dropped = part.column(part.schema.get_field_index("text")).to_pylist(), [], [], []
                for raw, own in zip(raws, gone(part, raws), strict=True):
                    lines.append(raw.count(b"\n") + 1)
                    stays = [x for x, k in zip(raw.split(b"\n"), _keys(raw), strict=True) if k not in own] if own else None
                    dropped.append(0 if stays is None else lines[-1] - len(stays))
                    texts.append(raw if stays is None else b"\n".join(stays))
                kept = [pa.array(texts, type=pa.binary()).cast(pa.string()) if n == "text" else part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lines, type=pa.int64()), pa.array(dropped, type=pa.int64())], names=[*names, n_lines, n_dropped])

    return docs.mapInArrow(run, docs.select(*names).withColumns({n_lines: F.lit(0).cast("long"), n_dropped: F.lit(0).cast("long")}).schema)


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_lines: int = 500_000, n_lines: str = "n_lines", n_dropped: str = "n_dropped", broadcast_keys: int = 1_000_000
) -> DataFrame:
    """docs with text replaced by what stays, and the columns n_lines, n_dropped (long; names by parameters) added."""
    if min_docs < 2:
        raise ValueError("min_docs is 2 at least")
    common.unreserved(docs)
    spark = docs.sparkSession
    counts = common.cut(line_counts(docs, min_chars).filter(F.col("n") >= min_docs), "lines-counts")
    keys, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    names = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    if keys <= broadcast_keys:  # some 14 bytes a key
        shards = -(-keys // shard_lines) or 1
        made = [(r["shard"], *(r[c] for c in ("sizes", "bits", "prints", "counts"))) for r in build_index(counts, shards).collect()]
        shared, held = spark.sparkContext.broadcast(made), {}

        def local(part: pa.RecordBatch, raws: list[bytes]) -> list[set[bytes] | None]:
            if "arrays" not in held:
                held["arrays"] = {shard: PerfectHash.of(*parts) for shard, *parts in shared.value}
            own = [{k for k in _keys(t) if _long_enough(k, min_chars)} for t in raws]
            found = _common(held["arrays"], shards, list(set().union(*own)), min_docs)
            return [x & found for x in own]

        return _rewritten(docs.select(*names).withColumn("text", F.col("text").cast("string")), names, local, n_lines, n_dropped)
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_lines))
    index = common.cut(build_index(counts, shards), "lines-index")
    k1, k2 = common.row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumn("text", F.col("text").cast("string")).withColumns({"_strand_k1": k1, "_strand_k2": k2})
    # Twice a fair share is too much for a shard, whatever the table's size; so there are half as many parts more than shards at most.
    most = max(1, min(shard_lines, 2 * total // shards))
    found = _probe(index, _probes(keyed, shards, min_chars), min_docs, most)
    lost = common.cut(found.groupBy("_strand_k1", "_strand_k2").agg(F.array_sort(F.collect_set("line")).alias("_strand_lost")), "lines-lost")
    joined = keyed.join(lost, ["_strand_k1", "_strand_k2"], "left").select(*names, "_strand_lost")

    def sent(part: pa.RecordBatch, raws: list[bytes]) -> list[set[bytes] | None]:
        places = part.column(part.schema.get_field_index("_strand_lost")).to_pylist()
        return [set(map(_keys(t).__getitem__, own)) if own else None for t, own in zip(raws, places, strict=True)]

    return _rewritten(joined, names, sent, n_lines, n_dropped)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(common.docs_of(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op1_line_dedup": r"""
WITH l AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
k AS (SELECT r, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT k.r, i, line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
a AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY r)
SELECT l.doc_id, a.n_lines, a.n_dropped, sha256(a.kept) AS kept_sha256 FROM a JOIN l ON a.r = l.r""",
}
