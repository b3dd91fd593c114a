"""Helpers that the operators of this subpackage share. Columns whose names begin with _strand_ are theirs; tables that have any are rejected. doc_id, page_id and item_id are
integers, or text that holds nothing else: other ids fail, under ANSI, at the cast."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir
from ..session import ship

#: Bytes of text that a task works on at once; one longer text is worked on alone.
SLICE_BYTES = 1 << 22


#: Tables written since ``clearing`` began; None outside of it.
_written: list[str] | None = None


def table(df: DataFrame, name: str) -> str:
    """Write df as a table in the shared folder; its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written is not None:
        _written.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table and read it again, which ends its lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(table(df, name))


@contextmanager
def clearing(spark: SparkSession) -> Iterator[list[str]]:
    """Gives the list of tables that are cut inside; those still in it are deleted at the end, when the caller has written its result."""
    global _written
    outer, _written = _written, []
    try:
        yield _written
    finally:
        for path in _written:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written = outer


def unreserved(df: DataFrame) -> DataFrame:
    """df, unless it has a column whose name is reserved."""
    taken = [c for c in df.columns if c.startswith("_strand_")]
    if taken:
        raise ValueError(f"column names that begin with _strand_ are reserved: {taken}")
    return df


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs, never null, that tell documents apart: its id, and a hash of its text as ids may repeat."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("_strand_k1"), F.xxhash64(text, F.length(text)).alias("_strand_k2")]


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about limit bytes of text each, with nulls made empty and the text as binary."""
    at = batch.schema.get_field_index(column)
    text = pc.fill_null(batch.column(at), "").cast(pa.binary() if batch.column(at).type == pa.string() else pa.large_binary())
    batch = batch.set_column(at, pa.field(column, text.type), text)
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def docs_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
