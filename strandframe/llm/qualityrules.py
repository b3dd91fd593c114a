"""Quality rules: counts of words, symbols and repeats, and a hashed n-gram logistic regression against a fixed threshold.

The model is a Spark ML logistic regression over hashed words, word pairs and character trigrams (``2 ** log2`` slots each, as shares of the
document's words, pairs and trigrams), trained on one half of a bounded sample of labelled rows (labelled.sample) and calibrated on the other. All
documents are scored in Arrow batches by looking their n-grams up in the weights.

``kept`` is false if the base rules fail, else true if the calibrated chance of good quality is at least ``threshold``. Without rows of both labels the
base rules decide alone. Null text has no words and fails the base rules; repeated rows get equal results; null doc_ids are kept;
other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common, labelled
from .textkernel import NONSPACE, buffers, exact_ids, grams, mix, repeated, words

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False
#: Shares are small; features are shares times this.
_SCALE = 30.0


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray, found: tuple, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    h, starts, ends, rows = found
    n = len(offsets) - 1
    at = np.searchsorted(rows, np.arange(n + 1))
    inside = NONSPACE[data]
    out = {"n_words": np.diff(at), "word_chars": _sum_by(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _sum_by(_SYMBOLS[data], offsets)}
    lh, ls, le, lrow = words(data, offsets, _LINE)
    marks = np.concatenate([[0], np.cumsum(inside)])
    full = marks[le] > marks[ls]
    line, lrow = exact_ids(data, ls[full], le[full], lh[full]), lrow[full]
    order = np.lexsort((line, lrow))
    again = (np.diff(line[order]) == 0) & (np.diff(lrow[order]) == 0) if len(order) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(lrow[order][1:][again], minlength=n) if len(order) else np.zeros(n, np.int64)
    first, twice = repeated(exact_ids(data, starts, ends, h), rows, window)
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + window, -1)
    out["n_repeat_words"] = _sum_by(np.cumsum(cover)[:-1] > 0, at)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _trigrams(data: np.ndarray, offsets: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each trigram of characters within a text, and where each text's begin."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if len(starts) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    sizes = np.diff(np.append(starts, len(data)))
    c = data[starts].astype(np.uint64)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        c[more] = c[more] << np.uint64(8) | data[starts[more] + k]
    with np.errstate(over="ignore"):
        slot = (
            mix(c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ mix(c[1:-1] * np.uint64(0xD6E8FEB86659FD93) ^ c[2:])) >> np.uint64(64 - log2)
        ).astype(np.int64)
    bounds = np.searchsorted(starts, offsets)
    whole = np.ones(len(slot), dtype=bool)
    for k in (1, 2):
        cut = bounds[1:-1] - k
        whole[cut[(cut >= 0) & (cut < len(slot))]] = False
    firsts = np.concatenate([[0], np.cumsum(whole)])[np.minimum(bounds, len(slot))]
    return slot[whole], firsts


def _features(data: np.ndarray, offsets: np.ndarray, found: tuple, log2: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots of the words, of the pairs of neighbouring words and of the character trigrams, each with where each text's begin."""
    h, _, _, rows = found
    pairs, first = grams(h, rows, 2)
    texts, high = np.arange(len(offsets)), np.uint64(64 - log2)
    return [
        ((h >> high).astype(np.int64), np.searchsorted(rows, texts)),
        ((pairs >> high).astype(np.int64), np.searchsorted(rows[first], texts)),
        _trigrams(data, offsets, log2),
    ]


def _sparse(batches: Iterator[pa.RecordBatch], log2: int) -> Iterator[pa.RecordBatch]:
    """y, half, and the features of each text as a sparse vector: its kind (0), size, slots and values."""
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    for batch in batches:
        for part in common.text_slices(batch):
            data, offsets = buffers(part.column(part.schema.get_field_index("text")))
            groups = _features(data, offsets, words(data, offsets, NONSPACE), log2)
            made = []
            for i in range(part.num_rows):
                s, v = [], []
                for g, (slots, first) in enumerate(groups):
                    own = slots[first[i] : first[i + 1]]
                    k, n = np.unique(own, return_counts=True)
                    s.append(k + (g << log2))
                    v.append(_SCALE * n / max(1, len(own)))
                made.append({"type": 0, "size": len(groups) << log2, "indices": np.concatenate(s).tolist(), "values": np.concatenate(v).tolist()})
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("y")), part.column(part.schema.get_field_index("half")), pa.array(made, type=kind)], names=["y", "half", "features"])


class Model:
    def __init__(self, weights: np.ndarray, log2: int):
        self.weights, self.log2, self.calibration = weights.astype(np.float32), log2, None

    def margins(self, data: np.ndarray, offsets: np.ndarray, found: tuple) -> np.ndarray:
        total = np.zeros(len(offsets) - 1)
        for g, (slots, first) in enumerate(_features(data, offsets, found, self.log2)):
            total += _sum_by(self.weights[(g << self.log2) + slots].astype(np.float64), first) / np.maximum(1, np.diff(first))
        return _SCALE * total


def _train(features: DataFrame, n: dict[int, int]) -> np.ndarray:
    """Coefficients of the logistic regression; both labels weigh alike. The vectors' struct, once written, is read as Spark ML's own type."""
    weight = F.when(F.col("y") == 1, 0.5 / n[1]).otherwise(0.5 / n[0]) * sum(n.values())
    path = common.table(features.select(F.col("y").cast("double").alias("label"), "features", weight.alias("weight")), "rules-train")
    ready = (
        features.sparkSession.read
        .schema(StructType([StructField("label", DoubleType()), StructField("features", VectorUDT()), StructField("weight", DoubleType())]))
        .parquet(path)
    )
    return np.asarray(LogisticRegression(maxIter=40, regParam=1e-3, standardization=False, weightCol="weight").fit(ready).coefficients.toArray())


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1500, log2: int = 14) -> Model | None:
    rows = common.cut(labelled.sample(docs, labels, "quality", per_class), "rules-sample")
    vector = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
    train = rows.filter("half = 0").select("y", "half", "text").mapInArrow(lambda b: _sparse(b, log2), f"y int, half int, features {vector}")
    n = {r["y"]: r["count"] for r in rows.filter("half = 0").groupBy("y").count().collect()}
    if len(n) < 2:
        return None
    model = Model(_train(train, n), log2)
    rest = rows.filter("half = 1").select("y", F.col("text").cast("binary").alias("text")).collect()  # 2 * per_class rows at most
    y = np.array([r["y"] for r in rest], dtype=float)
    if not 0 < y.sum() < len(y):
        return None
    data, offsets = buffers(pa.array([bytes(r["text"]) for r in rest], type=pa.binary()))
    model.calibration = labelled.Calibration(model.margins(data, offsets, words(data, offsets, NONSPACE))[:, None], y)
    return model


def judge(docs: DataFrame, model: Model | None, threshold: float = 0.3, least_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """doc_id, the base counts, base_failed, p_good (null without a model), kept of every row."""
    blob = docs.sparkSession.sparkContext.broadcast(model)  # weights of fixed size
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch):
                data, offsets = buffers(part.column(1))
                found = words(data, offsets, NONSPACE)
                base = base_counts(data, offsets, found)
                p = (
                    pa.array(
                        blob.value.calibration(blob.value.margins(data, offsets, found)[:, None])
                    ) if blob.value else pa.nulls(part.num_rows, pa.float64())
                )
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(base[c]) for c in counts), p], names=["doc_id", *counts, "p_good"])

    made = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in counts)}, p_good double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return made.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(1.0)) >= threshold))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.docs_of(spark, sf_dir)
    found = judge(docs, learn(docs, common.docs_of(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
