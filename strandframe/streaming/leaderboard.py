"""The best designs and sample count of each pose, kept up as result files arrive.

The stream keeps a state for each (pose, part), which holds the k best designs and the count; a pose that most results belong to goes over all its parts. A trigger gives
the parts that changed, which are written under its epoch's number: an epoch that is run again after a failure overwrites its own and nothing else. The board is
the last state of each part, merged by pose; older epochs of a part are superseded, and ``compact`` drops them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "scores array<double>, sequences array<string>, n long"
_CHANGED = f"pose string, part int, {_STATE}"


def board(results: DataFrame) -> DataFrame:
    """Best score and count of each pose of a batch."""
    return results.groupBy("pose").agg(F.min("score").alias("best"), F.count("*").alias("n"))


def _keep(k: int):
    """Takes in a (pose, part)'s new results: the k best by score, then sequence, and the count. Results without score count, but are never among the best."""

    def take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scores, sequences, n = state.get if state.exists else ([], [], 0)
        best = list(zip(scores, sequences, strict=True))
        for frame in frames:
            n += len(frame)
            known = frame[frame["score"].notna()].sort_values(["score", "sequence"]).head(k)
            best = sorted([*best, *zip(known["score"].tolist(), known["sequence"].tolist(), strict=True)])[:k]
        scores, sequences = [float(b[0]) for b in best], [b[1] for b in best]
        state.update((scores, sequences, int(n)))
        yield pd.DataFrame({"pose": [key[0]], "part": [key[1]], "scores": [scores], "sequences": [sequences], "n": [int(n)]})

    return take


def changes(results: DataFrame, k: int = 5, parts: int = 8) -> DataFrame:
    """The states (pose, part) that a streamed table's triggers change, in update mode."""
    dealt = results.select("pose", F.pmod(F.xxhash64("sequence"), F.lit(parts)).cast("int").alias("part"), F.col("score").cast("double").alias("score"), F.coalesce("sequence", F.lit("")).alias("sequence"))
    return dealt.groupBy("pose", "part").applyInPandasWithState(_keep(k), _CHANGED, _STATE, "update", GroupStateTimeout.NoTimeout)


def merge(changed: DataFrame, epoch: int, to: str) -> None:
    """What an epoch changed, under its number; the same epoch again replaces itself."""
    changed.write.mode("overwrite").parquet(f"{to}/changes/epoch={epoch:09d}")


def read(spark: SparkSession, to: str, k: int = 5) -> DataFrame:
    """pose, best, n and top (the k best: score, sequence) from the last state of each part."""
    states = spark.read.schema(f"{_CHANGED}, epoch int").parquet(f"{to}/changes")
    last = states.groupBy("pose", "part").agg(F.max_by(F.struct("scores", "sequences", "n"), "epoch").alias("s"))
    top = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("s.scores").alias("score"), F.col("s.sequences").alias("sequence"))))), 1, k)
    merged = last.groupBy("pose").agg(top.alias("top"), F.sum("s.n").alias("n"))  # parts times k designs at most
    return merged.select("pose", F.get("top", F.lit(0))["score"].alias("best"), "n", "top")


def compact(spark: SparkSession, to: str, into: str) -> None:
    """The last state of each part, as the only epoch of a new folder."""
    states = spark.read.schema(f"{_CHANGED}, epoch int").parquet(f"{to}/changes")
    last = states.groupBy("pose", "part").agg(F.max_by(F.struct("scores", "sequences", "n"), "epoch").alias("s"), F.max("epoch").alias("epoch"))
    newest = states.agg(F.max("epoch")).first()[0]
    merge(last.select("pose", "part", "s.*"), newest, into)


def run(spark: SparkSession, arriving: str, schema: str, to: str, k: int = 5, save=merge) -> DataFrame:
    """Take in all files that have arrived, one per trigger, and return the board; to: folder for state and changes. Run again with the same folder, it goes on where it stopped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    query = (
        changes(stream, k).writeStream
        .outputMode("update")
        .option("checkpointLocation", f"{to}/state")
        .trigger(availableNow=True)
        .foreachBatch(lambda df, epoch: save(df, epoch, to))
        .start()
    )
    query.awaitTermination()
    return read(spark, to, k)
