"""Language ID: a bit-sliced Bloom filter whose slots hold a bit for each language.

Learning counts character trigrams by language over all training rows. A trigram goes into a language's filter if its share of that
language's trigrams is at least ``share`` (so a language has 1 / share of them at most, which bounds the filter whatever the corpus' size)
and at least ``ratio`` of its largest share in any language; each language's most telling trigram goes in always, so every language of the
training rows can be predicted, however few rows it has. All languages' filters lie in one array of bit masks: one look-up at
``hashes`` slots, and-ed, returns every language that holds a trigram. A document's popcounts by language, less the false positives that
the filters' fill predicts, decide; the score is the chosen language's part of all corrected counts.

Spark builds the masks, by slot and word of 64 languages; what comes to the driver and goes to the tasks is the array, of at most 2**``most_log2`` slots
of a word for each 64 languages (32 MB a word at 22; 256 MB in all, beyond which there are fewer slots), and the languages' names and totals.

Letters are lower-cased, everything else is one space. ``und`` and score 0 if the text is null or has no letter, or nothing could be learned;
rows with null lang teach nothing; ties go to the first language in string order; repeated rows teach as often as they occur; a null doc_id counts as an empty
one for the fold; other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textkernel import mix

_tables: dict[str, np.ndarray] = {}


def _folded() -> np.ndarray:
    """By code point: the lower-case letter, or a space."""
    if "folded" not in _tables:
        letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)
        table = np.where(letter, np.arange(0x110000), 0x20).astype(np.int64)
        for c in range(0x20000):
            if letter[c] and len(low := chr(c).lower()) == 1:
                table[c] = ord(low)
        _tables["folded"] = table
    return _tables["folded"]


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code of each trigram (its middle is a letter), and the row it belongs to."""
    joined = "\n".join(["", *(t.decode("utf-8", "replace") for t in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    sizes = (
        np.array(
            [len(t.decode("utf-8", "replace")) for t in texts],
            dtype=np.int64,
        ) if len(texts) > 1 else np.array([len(points) - 2], dtype=np.int64)
    )
    ends = 1 + np.cumsum(sizes + 1)
    c = _folded()[points]
    keep = np.flatnonzero((c != 0x20) | np.concatenate([[True], c[:-1] != 0x20]))
    c = c[keep]
    middle = np.flatnonzero(c[1:-1] != 0x20) + 1
    return c[middle - 1] << 42 | c[middle] << 21 | c[middle + 1], np.searchsorted(ends, keep[middle], side="right")


def _slots(codes: np.ndarray, log2: int, hashes: int) -> Iterator[np.ndarray]:
    h = mix(codes.view(np.uint64))
    low, step = h, (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(hashes):
            yield ((low + np.uint64(i) * step) & np.uint64((1 << log2) - 1)).astype(np.int64)


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, code, n over all rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch):
                langs = part.column(0).to_pylist()
                codes, at = trigrams(part.column(1).to_pylist())
                names, number = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
                of = number[at]
                for i, name in enumerate(names.tolist()):
                    own, n = np.unique(codes[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), type=pa.string()), pa.array(own), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Filter:
    """The bit-sliced Bloom filter."""

    def __init__(self, langs: list[str], log2: int, hashes: int, masks: np.ndarray, default: int):
        self.langs, self.log2, self.hashes, self.masks, self.default = langs, log2, hashes, masks, default
        bit = lambda i: (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        #: How often a trigram that a language lacks seems to be in its filter.
        self.false = np.array([float(bit(i).mean()) ** hashes for i in range(len(langs))])

    @classmethod
    def build(cls, langs: list[str], held: DataFrame, default: int, hashes: int = 3, bits_each: int = 12, most_log2: int = 22, most_bytes: int = 1 << 28) -> Filter:
        """held: number (of the language), code. The array takes most_bytes at most: with many languages it has fewer slots, whose false positives are higher, and corrected for."""
        distinct = held.agg(F.count_distinct("code")).first()[0]
        room = int(np.log2(max(2, most_bytes // (8 * -(-len(langs) // 64)))))
        log2 = min(most_log2, room, max(10, int(np.ceil(np.log2(max(1, distinct) * bits_each)))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number, codes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                word, mask = (number // 64).astype(np.int32), (np.uint64(1) << (number % 64).astype(np.uint64)).view(np.int64)
                for slot in _slots(codes, log2, hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(word), pa.array(mask)], names=["slot", "word", "mask"])

        found = (
            held.select(F.col("number").cast("int"), "code")
            .mapInArrow(run, "slot long, word int, mask long")
            .groupBy("slot", "word")
            .agg(F.bit_or("mask").alias("mask"))
            .toPandas()
        )
        masks = np.zeros((1 << log2, -(-len(langs) // 64)), dtype=np.uint64)
        masks[found["slot"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy(dtype=np.int64).view(np.uint64)
        return cls(langs, log2, hashes, masks, default)

    def decide(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        codes, rows = trigrams(texts)
        n = np.bincount(rows, minlength=len(texts))[: len(texts)]
        held = None
        for slot in _slots(codes, self.log2, self.hashes):
            held = self.masks[slot] if held is None else held & self.masks[slot]
        counts = np.stack(
            [
                np.bincount(
                    rows,
                    weights=((held[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.float64),
                    minlength=len(texts),
                )[: len(texts)] for i in range(len(self.langs))
            ],
            axis=1,
        )
        right = np.maximum(0, counts - n[:, None] * self.false) / (1 - np.minimum(self.false, 0.999))
        total = right.sum(axis=1)
        best = np.where(total > 0, right.argmax(axis=1), self.default)
        share = np.where(total > 0, right[np.arange(len(texts)), best] / np.where(total > 0, total, 1), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, n, strict=True)], np.where(n > 0, share, 0.0).tolist()


def learn(rows: DataFrame, share: float = 5e-6, ratio: float = 0.2) -> Filter | None:
    """A filter of the rows' languages (lang not null, text); None if no row has a letter."""
    counts = common.cut(gram_counts(rows.filter("lang IS NOT NULL")), "langid-counts")
    sums = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # a row for each language
    if not sums:
        return None
    langs = sorted(sums)
    names = counts.sparkSession.createDataFrame([(x, i, sums[x]) for i, x in enumerate(langs)], "lang string, number int, total long")
    shares = counts.join(F.broadcast(names), "lang").select("number", "code", (F.col("n") / F.col("total")).alias("p"))
    best = shares.groupBy("code").agg(F.max("p").alias("best"), F.count("*").alias("langs"))
    told = shares.join(best, "code").withColumn("part", F.col("p") / F.col("best"))
    top = told.groupBy("number").agg(F.max_by("code", F.struct("part", -F.col("langs"), "p", "code")).alias("code"))
    held = told.filter((F.col("p") >= share) & (F.col("part") >= ratio)).select("number", "code").unionByName(top).distinct()
    return Filter.build(langs, common.cut(held, "langid-held"), langs.index(max(langs, key=lambda x: (sums[x], x))))


def fold(doc_id, mod: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def identify(docs: DataFrame, model: Filter | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    blob = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch):
                texts = part.column(1).to_pylist()
                langs, scores = blob.value.decide(texts) if blob.value else (["und"] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.docs_of(spark, sf_dir)
    model = learn(
        docs.filter(fold(F.col("doc_id"), 4) != 2).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    )
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
