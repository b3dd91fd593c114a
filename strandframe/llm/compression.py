"""Compression classifiers: zstandard dictionaries of two classes; text that one of them compresses better is more like that class.

Toxicity (label 1: toxic). zstandard's trainer makes a dictionary of toxic and one of ordinary text, each from its class's sampled texts less
what the other's hold (parted), and one of the ordinary texts and what toxic ones share with them, which stands behind both. Each window of
a document is compressed with both; how many windows the toxic one shortens, by how much, is calibrated.

Quality (label 1: good). A dictionary of good and one of bad text; all windows of a document are compressed with both, and the difference of the
two compressed sizes, over the size of the text itself, becomes a calibrated score. (Over the text, not over the compressed sizes: text that
repeats itself shrinks under any dictionary, so its difference stays small against its length.)

Dictionaries and calibration come from a bounded sample of labelled rows (labelled.sample: per_class, max_chars). It is cut into folds; what models of
the other folds say of each fold is calibrated, then one model of all folds is made. All windows of all documents are scored. Null and empty
texts get the score that the calibration gives to no difference; without rows of both labels in every fold there is nothing to learn and every score
is 0.5; the same holds, with a warning, for toxicity where zstandard's trainer refuses a class's texts as too few (no other dictionary takes its place). A label given twice counts as its larger value. Repeated rows get equal scores; null doc_ids are kept; other columns are
ignored; empty in, empty out.
"""

from __future__ import annotations

import math
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled
from .langid import fold


def windows(text: bytes, size: int) -> list[bytes]:
    """The whole text in windows of about size bytes that end at a space where there is one."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        to = text.rfind(b" ", at + size // 2, at + size) + 1 or at + size
        out.append(text[at:to])
        at = to
    out.append(text[at:])
    return out


class Sizer:
    """Compressed sizes under one dictionary."""

    def __init__(self, content: bytes, level: int):
        self.content, self.level = content, level
        self._made = None

    def __getstate__(self):
        return self.content, self.level

    def __setstate__(self, state):
        self.content, self.level = state
        self._made = None

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        if self._made is None:
            d = zstandard.ZstdCompressionDict(self.content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            self._made = zstandard.ZstdCompressor(
                level=self.level,
                dict_data=d,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            ).compress
        return np.fromiter(map(len, map(self._made, parts)), dtype=np.int64, count=len(parts))


def _per_document(texts: list[bytes], size: int) -> tuple[list[bytes], np.ndarray]:
    """All windows, and where each document's begin; every document has one at least."""
    parts: list[bytes] = []
    first = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        first[i] = len(parts)
        parts += windows(t, size)
    return parts, first


class Toxicity:
    def __init__(self, toxic: Sizer, ordinary: Sizer, window: int):
        self.toxic, self.ordinary, self.window, self.calibration = toxic, ordinary, window, None

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Of each document: its windows; those that save 1, 2, 3, 4, 5, 6 and 8 bytes or more, in all and as a share; the mean and the best saving."""
        parts, first = _per_document([t.lower() for t in texts], self.window)
        saved = self.ordinary(parts) - self.toxic(parts)
        n = np.diff(np.append(first, len(parts)))
        held = [np.add.reduceat((saved >= k).astype(float), first) for k in (1, 2, 3, 4, 5, 6, 8)]
        mean, most = np.add.reduceat(saved, first) / n, np.clip(np.maximum.reduceat(saved, first), 0, 16)
        return np.column_stack([np.log1p(n), *(x / n for x in held), *map(np.log1p, held), mean, most]).astype(float)


class Quality:
    def __init__(self, good: Sizer, bad: Sizer, window: int):
        self.good, self.bad, self.window, self.calibration = good, bad, window, None

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Of each document: (bad - good) / raw, of the sizes compressed with either dictionary and of the text, over all windows."""
        parts, first = _per_document(texts, self.window)
        difference, raw = self.bad(parts) - self.good(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        return (np.add.reduceat(difference, first) / (np.add.reduceat(raw, first) + 1))[:, None]


def parted(texts: list[bytes], others: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Of each text, what others don't hold and what they do: a word is shared in as many of the texts as, at equal numbers of texts, others hold it in."""
    held = Counter(w for t in others for w in set(t.split()))
    left = {w: math.ceil(n * len(texts) / len(others)) for w, n in held.items()}
    own, shared = [], []
    for t in texts:
        words = t.split()
        gone = {w for w in set(words) if left.get(w, 0) > 0}
        for w in gone:
            left[w] -= 1
        own.append(b" ".join(w for w in words if w not in gone))
        shared.append(b" ".join(w for w in words if w in gone))
    return [t for t in own if t], [t for t in shared if t]


class Untrainable(ValueError):
    """zstandard's trainer refuses a class's texts, as they are too few or too short."""


def trained(texts: list[bytes], size: int) -> bytes:
    """A dictionary of size bytes that zstandard's trainer makes of the texts."""
    try:
        return zstandard.train_dictionary(size, texts, k=16, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError) as e:
        raise Untrainable(f"no dictionary of {size} bytes comes from {len(texts)} texts of {sum(map(len, texts))} bytes") from e


def without_shared_lines(classes: list[list[bytes]]) -> list[list[bytes]]:
    """The texts without lines that two or more of them hold: boilerplate says nothing about a class."""
    held = Counter(line for texts in classes for t in texts for line in set(t.split(b"\n")))
    return [[k for t in texts if len(k := b"\n".join(x for x in t.split(b"\n") if held[x] < 2)) > 40] for texts in classes]


def _passages(texts: list[bytes], size: int) -> bytes:
    """A passage of every text, all of one length, size bytes at most."""
    each = max(1, size // max(1, len(texts)) - 1)
    return b"\n".join(t[at : at + each] for i, t in enumerate(texts) for at in [(i * 7919) % max(1, len(t) - each)])[:size]


def _cross_fitted(rows: list, build, folds: int):
    """build(all rows), calibrated on what models of the other folds say of each fold; None unless every fold has rows of both labels."""
    parts = [[r for i, r in enumerate(rows) if i % folds == f] for f in range(folds)]
    if any({r["y"] for r in part} != {0, 1} for part in parts):
        return None
    x = [build([r for i, r in enumerate(rows) if i % folds != f]).features([r["text"].encode() for r in part]) for f, part in enumerate(parts)]
    model = build(rows)
    model.calibration = labelled.Calibration(np.concatenate(x), np.array([r["y"] for part in parts for r in part], dtype=float), ridge=1e-2)
    return model


def _texts(rows: list) -> list[list[bytes]]:
    """Of label 1, of label 0."""
    return [[r["text"].encode() for r in rows if r["y"] == y] for y in (1, 0)]


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 1500,
    window: int = 64,
    level: int = 12,
    own_bytes: int = 4096,
    common_bytes: int = 131072,
    folds: int = 5,
) -> Toxicity | None:
    def build(rows: list) -> Toxicity:
        toxic, ordinary = ([t.lower() for t in x] for x in _texts(rows))
        (own, common_text), (other, _) = parted(toxic, ordinary), parted(ordinary, toxic)
        shared = trained(ordinary + common_text, common_bytes)
        return Toxicity(*(Sizer(trained(x, own_bytes) + shared, level) for x in (own, other)), window)

    rows = labelled.sample(docs, labels, "toxic", per_class).collect()  # 2 * per_class at most
    try:
        return _cross_fitted(rows, build, folds)
    except Untrainable as e:
        warnings.warn(f"toxicity isn't learned: {e}", stacklevel=2)
        return None


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 1500,
    window: int = 1024,
    level: int = 12,
    dictionary_bytes: int = 131072,
    folds: int = 2,
) -> Quality | None:
    def build(rows: list) -> Quality:
        return Quality(*(Sizer(_passages(x, dictionary_bytes) or b" ", level) for x in without_shared_lines(_texts(rows))), window)

    return _cross_fitted(labelled.sample(docs, labels, "quality", per_class).collect(), build, folds)  # 2 * per_class rows at most


def score(docs: DataFrame, model, column: str = "score") -> DataFrame:
    """docs with the calibrated score of the whole text added."""
    blob = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries of fixed size
    names = [c for c in docs.columns if c != column]
    docs = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at)
            scores = []
            for part in common.text_slices(batch):
                own = part.column(at).to_pylist()
                scores.append(blob.value.calibration(blob.value.features(own)) if blob.value else np.full(len(own), 0.5))
            yield pa.RecordBatch.from_arrays([*(texts if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*names, column])

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0.0)).schema)


def _scored(spark, sf_dir: str, learn, threshold: float) -> DataFrame:
    docs, labels = common.docs_of(spark, sf_dir), common.docs_of(spark, sf_dir, "labels")
    model = learn(docs, labels)
    found = score(docs.select("doc_id", "text"), model).select("doc_id", "score")
    return found.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, learn_toxicity, 0.5)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, learn_quality, 0.3)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the quality classifier, learnt from these rows, doesn't reject."""
    return score(common.unreserved(docs), learn_quality(docs, labels), "_strand_score").filter(F.col("_strand_score") >= threshold).select(*docs.columns)
