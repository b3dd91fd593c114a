"""Benchmark decontamination: a prefix-filtered set join of document shingles with item windows.

A window is ``window`` consecutive words of an item (a shorter item is one window); its tokens are its shingles of
``shingle`` words (of all its words, if fewer). Containment is exact, so the prefix that a match must share is one token: the rarest one.

1. All tokens of all windows set bits in a bitmap whose size follows their number (2**28 bits at most), which goes to all tasks.
2. One pass over whole documents cuts out the runs of words whose shingles are all in the bitmap: only they can hold a window.
   Long runs are cut into pieces that overlap by a window, so that none is larger than ``piece`` words.
3. Equal pieces meet in one aggregation. Their shingles give the rarity order; windows with a token found nowhere go.
4. Pieces join windows on the prefix token only. The token's place in window and piece gives where the window would lie
   (positional bound) and if it fits (length bound); then its words are compared one by one.
5. What a piece holds goes back to all its documents.

Nothing that grows with benchmark or corpus is broadcast by hand. Null has no words; null item texts give no window; repeated rows
get equal results; other columns are ignored; an empty benchmark leaves all documents clean; empty documents give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textkernel import ALNUM, LOWER, buffers, grams, words

#: Bits of the bitmap for each distinct token, and its largest size: 2**_MOST_LOG2 bits (32 MB), beyond which more pieces pass than hold a window.
_BITS_EACH, _MOST_LOG2 = 16, 28


def _windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, size (shingle's words), words, hashes of the shingles: a row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch):
                ids = part.column(0).to_pylist()
                data, offsets = buffers(part.column(1))
                data = LOWER[data]
                h, starts, ends, rows = words(data, offsets, ALNUM)
                raw = data.tobytes()
                bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
                out: list[list] = [[], [], [], []]
                for k, item in enumerate(ids):
                    lo, hi = int(bounds[k]), int(bounds[k + 1])
                    if lo == hi:
                        continue
                    own = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in range(lo, hi)]
                    size = min(shingle, hi - lo, window)
                    g, _ = grams(h[lo:hi], rows[lo:hi], size)
                    for w in range(max(1, hi - lo - window + 1)):
                        ws = own[w : w + window]
                        for x, y in zip(out, (item, size, ws, g[w : w + len(ws) - size + 1].view(np.int64).tolist()), strict=True):
                            x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], names=["item_id", "size", "words", "hashes"])

    return items.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "item_id long, size int, words array<string>, hashes array<long>")


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """Two bits of each token's hash; _BITS_EACH bits a token, so about one stranger in sixty passes."""
    distinct = tokens.distinct()
    log2 = min(_MOST_LOG2, max(16, int(np.ceil(np.log2(max(1, distinct.count()) * _BITS_EACH)))))
    low = F.col("h").bitwiseAND((1 << log2) - 1)
    high = F.shiftrightunsigned("h", 32).bitwiseAND((1 << log2) - 1)
    slots = distinct.select(F.explode(F.array(low, high)).alias("b")).select(
        F.shiftright("b", 6).cast("int").alias("w"),
        F.expr("shiftleft(1L, cast(b & 63 AS int))").alias("m"),
    )
    found = slots.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    bits = np.zeros(1 << (log2 - 6), dtype=np.int64)
    bits[found["w"].to_numpy(dtype=np.int64)] = found["m"].to_numpy(dtype=np.int64)
    return bits.view(np.uint64)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), dtype=bool)
    mask, one = np.uint64(64 * len(bits) - 1), np.uint64(1)
    for x in (h & mask, (h >> np.uint64(32)) & mask):
        hit &= (bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & one == one
    return hit


def _pieces(docs: DataFrame, bits: np.ndarray, least: dict[int, int], window: int, piece: int) -> DataFrame:
    """doc_id, _strand_k2, n_words and the pieces of every document. least: shingle size to the words of its shortest window."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        common.row_key(F.col("doc_id"), F.col("text"))[1],
        F.col("text").cast("string").alias("text"),
    )
    kind = pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64()))]))
    compact = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(compact.value, dtype=np.uint64)
        for batch in batches:
            for part in common.text_slices(batch):
                data, offsets = buffers(part.column(2))
                data = LOWER[data]
                h, starts, ends, rows = words(data, offsets, ALNUM)
                bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                found: list[list] = [[] for _ in range(part.num_rows)]
                for size, shortest in least.items():
                    g, first = grams(h, rows, size)
                    hit = _in(held, g)
                    g, first = g[hit], first[hit]
                    if not len(first):
                        continue
                    breaks = np.flatnonzero((np.diff(first) != 1) | (np.diff(rows[first]) != 0)) + 1
                    for lo, hi in zip([0, *breaks], [*breaks, len(first)], strict=True):
                        if hi - lo + size - 1 < shortest:
                            continue
                        row = int(rows[first[lo]])
                        for a in range(lo, hi, piece - window + 1):
                            b = min(hi, a + piece - size + 1)
                            own = range(int(first[a]), int(first[b - 1]) + size)
                            if len(own) < shortest:
                                break
                            found[row].append(
                                {
                                    "size": size,
                                    "start": own[0] - int(bounds[row]),
                                    "words": [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in own],
                                    "hashes": g[a:b].view(np.int64).tolist(),
                                }
                            )
                            if b == hi:
                                break
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(found, type=kind)], names=["doc_id", "_strand_k2", "n_words", "pieces"])

    return keyed.mapInArrow(
        run,
        "doc_id long, _strand_k2 long, n_words long, pieces array<struct<size int, start long, words array<string>, hashes array<long>>>",
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, piece: int = 64, most: int = 100_000) -> DataFrame:
    """doc_id, _strand_k2 (hash of the text), n_words, n_hit, item_ids (array, sorted as strings) of every row of docs."""
    w = common.cut(
        _windows(items, window, shingle)
        .groupBy("size", "words", "hashes")
        .agg(F.collect_set("item_id").alias("items"))
        .withColumn("w", F.md5(F.concat_ws(" ", "words"))),
        "decon-windows",
    )
    least = {r["size"]: r["n"] for r in w.groupBy("size").agg(F.min(F.size("words")).alias("n")).collect()}  # shingle rows at most
    bits = _bitmap(w.select(F.explode("hashes").alias("h")))
    seen = common.cut(_pieces(docs, bits, least, window, piece), "decon-pieces")
    each = (
        seen.select("doc_id", "_strand_k2", F.explode("pieces").alias("p"))
        .select("doc_id", "_strand_k2", "p.*")
        .withColumn("piece", F.md5(F.concat_ws(" ", F.col("size").cast("string"), "words")))
    )
    unique = common.cut(
        each.groupBy("piece").agg(
            F.first("size").alias("size"),
            F.first("words").alias("words"),
            F.first("hashes").alias("hashes"),
            F.count("*").alias("n"),
        ),
        "decon-unique",
    )
    tokens = unique.select("piece", "size", "words", "n", F.posexplode("hashes").alias("at", "h"))
    rarity = tokens.groupBy("size", "h").agg(F.sum("n").alias("freq"))
    # A match needs all its window's tokens, so the rarest one is the prefix; windows with a token that no document has are out.
    ordered = (
        w.select("w", "size", F.size("hashes").alias("need"), F.posexplode("hashes").alias("at", "h"))
        .join(rarity, ["size", "h"])
        .groupBy("w")
        .agg(F.count("*").alias("have"), F.first("need").alias("need"), F.min(F.struct("freq", "h", "at")).alias("prefix"))
        .filter("have = need")
    )
    prefix = common.cut(
        ordered.join(w.select("w", "size", "words", "items"), "w").select(
            "size",
            F.col("prefix.h").alias("h"),
            F.col("prefix.at").alias("offset"),
            F.col("words").alias("wanted"),
            "items",
        ),
        "decon-prefix",
    )
    placed = (
        tokens.join(prefix, ["size", "h"])
        .withColumn("begin", F.col("at") - F.col("offset"))
        .filter((F.col("begin") >= 0) & (F.col("begin") + F.size("wanted") <= F.size("words")))
    )
    same = placed.filter(F.slice("words", F.col("begin") + 1, F.size("wanted")) == F.col("wanted"))
    held = common.cut(
        same.groupBy("piece").agg(
            F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(begin, begin + size(wanted) - 1)")))).alias("covered"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
            F.max("n").alias("n"),
        ),
        "decon-held",
    )
    # A one-word item's piece is in every document that has the word: verdicts on such pieces go back in parts.
    parts = (F.floor(F.col("n") / most) + 1).cast("int")
    salted = held.withColumn("_strand_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    crowded = held.filter(F.col("n") >= most).select("piece", parts.alias("_strand_parts"))
    places = (
        each.select("doc_id", "_strand_k2", "piece", "start")
        .distinct()
        .join(crowded, "piece", "left")
        .withColumn("_strand_salt", F.pmod(F.xxhash64("doc_id", "_strand_k2"), F.coalesce("_strand_parts", F.lit(1))).cast("int"))
    )
    hits = (
        places.join(salted, ["piece", "_strand_salt"])
        .groupBy("doc_id", "_strand_k2")
        .agg(
            F.flatten(F.collect_list(F.expr("transform(covered, x -> x + start)"))).alias("covered"),
            F.flatten(F.collect_set("items")).alias("items"),
        )
    )
    done = hits.select(
        "doc_id",
        "_strand_k2",
        F.size(F.array_distinct("covered")).cast("long").alias("n_hit"),
        F.array_sort(F.transform(F.array_distinct("items"), lambda x: x.cast("string"))).alias("item_ids"),
    )
    left = seen.select("doc_id", "_strand_k2", "n_words").withColumn("_strand_k1", F.coalesce("doc_id", F.lit(-(2**63))))
    right = done.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_strand_k1"), "_strand_k2", "n_hit", "item_ids")
    return left.join(right, ["_strand_k1", "_strand_k2"], "left").select(
        "doc_id",
        "_strand_k2",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(common.docs_of(spark, sf_dir), common.docs_of(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of an item."""
    common.unreserved(docs)
    bad = common.cut(
        contamination(docs, items).filter("n_hit > 0").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_strand_k1"), "_strand_k2").distinct(),
        "decon-bad",
    )
    k1, k2 = common.row_key(F.col("doc_id"), F.col("text"))
    return docs.withColumns({"_strand_k1": k1, "_strand_k2": k2}).join(bad, ["_strand_k1", "_strand_k2"], "left_anti").select(*docs.columns)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op7_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark),
bi AS (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, len(ws[i:i + 9]) AS k, array_to_string(ws[i:i + 9], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
e AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
l AS (SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS xs FROM e),
dw AS (SELECT r, i, k, array_to_string(xs[1:k], ' ') AS g FROM l CROSS JOIN ks WHERE len(xs) >= k),
m AS (SELECT r, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + k - 1)) AS p FROM m) AS q GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) AS q GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN n ON d.r = n.r""",
}
