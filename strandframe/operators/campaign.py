"""A whole design request as one plan: structures x poses x temperatures x samples, scored, ranked and threaded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import arrays
from ..functions.letters import MODEL_ORDER, to_index
from . import constraints as C
from . import residues as R
from . import scoring as S

SAMPLE = ["name", "pose", "temperature", "sample_id"]


def design_positions(
    atoms: DataFrame,
    requests: DataFrame,
    fixed: DataFrame,
    logits: Callable[[DataFrame], DataFrame],
    mirrored: bool = True,
) -> DataFrame:
    """The design chain's residues of each request (name, chain, and what else it asks): pos, native_idx, mask, design, logits.

    The structure is mirrored first; fixed positions keep their letters. logits adds the column of 21 numbers, by a model or an expression.
    """
    table = R.residue_table(R.mirror(atoms) if mirrored else atoms)
    own = C.apply_fixed(table, fixed).join(requests, ["name", "chain"])
    ready = own.withColumn("native_idx", to_index(F.col("aa"))).withColumn("chain_m", F.lit(1))
    return logits(C.design_mask(ready, "designed")).select("name", "chain", "pos", "native_idx", "mask", "design", "logits")


def campaign(
    positions: DataFrame,
    poses: int,
    temperatures: list[float],
    samples: int,
    noise: Callable[[Column, Column, Column, Column], Column],
) -> DataFrame:
    """name, chain, pose, temperature, sample_id, sequence, score, recovery, and rank in the pose by score.

    noise(pos, pose, temperature number, sample) gives the uniform that draws a letter. All letters of a position are drawn in its row, where probabilities are worked out once for
    each temperature; what is exploded is letters and their losses.
    """
    grid = F.array(*[F.struct(F.lit(p).alias("pose"), F.lit(s).alias("sample_id")) for p in range(1, poses + 1) for s in range(samples)])
    pos, logits = F.col("pos"), F.col("logits")
    best = F.array_position(logits, F.array_max(logits)).cast("int") - 1

    def drawn_at(number: int, temperature: float) -> Column:
        def letters(sums: Column | None) -> Column:
            def one(g: Column) -> Column:
                own = best if sums is None else arrays.draw_from(sums, noise(pos, g["pose"], F.lit(number), g["sample_id"]))
                idx = F.when(F.col("design") == 0, F.col("native_idx")).otherwise(own).cast("int")
                return F.struct(g["pose"].alias("pose"), F.lit(float(temperature)).alias("temperature"), g["sample_id"].alias("sample_id"), idx.alias("idx"))

            return F.transform(grid, one)

        return arrays.let(arrays.running(arrays.softmax(F.transform(logits, lambda v: v / temperature))), letters) if temperature > 0 else letters(None)

    every = F.flatten(F.array(*[drawn_at(i, t) for i, t in enumerate(temperatures)]))
    with_loss = lambda lp: F.transform(every, lambda g: F.struct(*[g[c].alias(c) for c in ("pose", "temperature", "sample_id", "idx")], S.nll(lp, g["idx"]).alias("lost")))
    drawn = positions.select("name", "chain", "pos", "native_idx", "design", F.inline(arrays.let(arrays.log_softmax(logits), with_loss)))
    lost = F.col("lost")
    same = (F.col("idx") == F.col("native_idx")).cast("int")
    letter = F.substr(F.lit(MODEL_ORDER), F.col("idx") + 1, F.lit(1))
    per = drawn.groupBy(*SAMPLE, "chain").agg(
        F.array_sort(F.collect_list(F.struct("pos", letter.alias("c")))).alias("s"),
        S.masked_mean(lost, F.col("design")).alias("score"),
        S.masked_mean(same, F.col("design")).alias("recovery"),
    )
    named = per.select(
        "name",
        "chain",
        "pose",
        "temperature",
        "sample_id",
        F.array_join(F.transform("s", lambda x: x["c"]), "").alias("sequence"),
        "score",
        "recovery",
    )
    rank = F.row_number().over(W.partitionBy("name", "pose").orderBy(F.round("score", 9), "sequence", "temperature", "sample_id"))
    return named.withColumn("rank", rank)


def results(designs: DataFrame) -> DataFrame:
    """The result table: the designs and their threaded structure's file, best scores first."""
    file = F.concat(F.lit("Binders/"), "name", F.lit("/Pose"), F.col("pose").cast("string"), F.lit("_"), "sequence", F.lit(".pdb"))
    return designs.withColumn("filename", file).orderBy("score", "name", "pose", "sequence")


def threaded(atoms: DataFrame, designs: DataFrame, best: int = 1) -> DataFrame:
    """Atoms of the structures that carry the best designs of each pose, with pose and rank."""
    wanted = designs.filter(F.col("rank") <= best).select("name", "chain", "sequence", "pose", "rank")
    return R.thread_sequence(atoms, wanted)
