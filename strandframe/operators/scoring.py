"""Scores of samples, sampling from logits, ranked results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import arrays
from ..functions.letters import MODEL_ORDER
from ..scratch import cut
from ..session import ship
from .ranks import numbered


def nll(log_probs: Column, index: Column) -> Column:
    return -F.element_at(log_probs, index.cast("int") + 1)


def masked_mean(value: Column, mask: Column) -> Column:
    """Null where no position counts."""
    return F.sum(value * mask) / F.nullif(F.sum(mask), F.lit(0))


def nll_scores(positions: DataFrame, by: list[str]) -> DataFrame:
    """Mean negative log-probability of the chosen letters over masked positions; positions: by, log_probs, idx, mask."""
    return positions.groupBy(*by).agg(masked_mean(nll(F.col("log_probs"), F.col("idx")), F.col("mask")).alias("score"))


def nll_pooled(positions: DataFrame) -> DataFrame:
    """name, loss for each structure, and for all at once where name is null."""
    ready = positions.select("name", nll(F.col("log_probs"), F.col("idx")).alias("l"), "mask")
    return ready.rollup("name").agg(masked_mean(F.col("l"), F.col("mask")).alias("loss"))


def nll_smoothed(positions: DataFrame, by: list[str], weight: float = 0.1) -> DataFrame:
    """Loss against one-hot letters plus weight / 21, renormalised."""
    n = len(MODEL_ORDER)
    chosen = F.element_at("log_probs", F.col("idx").cast("int") + 1)
    loss = -(chosen + weight / n * arrays.total(F.col("log_probs"))) / (1 + weight)
    return positions.groupBy(*by).agg(masked_mean(loss, F.col("mask")).alias("loss"))


def score_stats(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("score").alias("n"))


def seq_recovery(pairs: DataFrame, by: list[str], mask: str | None = None) -> DataFrame:
    """by, recovery: share of positions where native and sequence agree; positions whose native letter is X, or whose mask (an array) is 0, don't count.

    by tells the pairs apart. Letters are counted in Arrow batches, each pair's as two arrays; only the counts reach the shuffle.
    """
    ship(pairs.sparkSession)
    ready = pairs.filter("native IS NOT NULL").select(*by, "native", "sequence", *([F.col(mask).cast("array<double>").alias("_m")] if mask else []))
    schema = T.StructType([ready.schema[c] for c in by] + [T.StructField("_same", T.LongType()), T.StructField("_all", T.LongType())])

    def run(batches):
        from strandframe.operators import scoring

        for batch in batches:
            yield scoring._agreement(batch)

    counts = ready.mapInArrow(run, schema).groupBy(*by).agg(F.sum("_same").alias("_same"), F.sum("_all").alias("_all"))
    return counts.select(*by, (F.col("_same") / F.nullif("_all", F.lit(0))).alias("recovery"))


def _agreement(batch):
    """A batch's columns before native, and _same and _all: letters that agree and that count."""
    import numpy as np
    import pyarrow as pa

    def letters(column, i):
        data = column[i].as_buffer() if column[i].is_valid else b""
        at = np.frombuffer(data, np.uint8)
        return at if not len(at) or at.max() < 128 else np.frombuffer(bytes(data).decode().encode("utf-32-le"), np.uint32)

    native, sequence = batch.column("native"), batch.column("sequence")
    masks = batch.column("_m") if "_m" in batch.schema.names else None
    same, every = np.zeros(len(native), np.int64), np.zeros(len(native), np.int64)
    for i in range(len(native)):
        a, b = letters(native, i), letters(sequence, i)
        counts = a != ord("X")
        if masks is not None:
            own = np.array(masks[i].as_py() or [], float)[: len(a)]
            counts[: len(own)] &= np.nan_to_num(own) != 0
            counts[len(own) :] = False
        n = min(len(a), len(b))
        same[i], every[i] = np.count_nonzero((a[:n] == b[:n]) & counts[:n]), np.count_nonzero(counts)
    kept = [c for c in batch.schema.names if c not in ("native", "sequence", "_m")]
    return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(same), pa.array(every)], names=[*kept, "_same", "_all"])


def mean_probs(probs: DataFrame, by: list[str]) -> DataFrame:
    """Average probability of each letter but X over samples: by, aa, p."""
    each = probs.select(*by, F.posexplode("probs").alias("idx", "p")).filter(F.col("idx") < len(MODEL_ORDER) - 1)
    return each.groupBy(*by, F.substr(F.lit(MODEL_ORDER), F.col("idx") + 1, F.lit(1)).alias("aa")).agg(F.avg("p").alias("p"))


def probs_matrix(means: DataFrame, positions: list[int]) -> DataFrame:
    """Letters by positions: one column p<position> each."""
    wide = means.groupBy("aa").pivot("pos", positions).agg(F.first("p"))
    return wide.select("aa", *[F.col(f"`{p}`").alias(f"p{p}") for p in positions])


def discard_reason(seq: Column, max_length: int) -> Column:
    """bad_chars (tested first), too_long, or kept."""
    return F.when(seq.rlike(f"[^{MODEL_ORDER}-]"), "bad_chars").when(F.length(seq) > max_length, "too_long").otherwise("kept")


def tied_logits(members: DataFrame, temperature: float = 1.0) -> DataFrame:
    """name, group_id, logits: sum of beta * logits / T over a group's members, over their number."""
    each = members.select("name", "group_id", "beta", F.posexplode("logits").alias("idx", "l"))
    summed = each.groupBy("name", "group_id", "idx").agg((F.sum(F.col("beta") * F.col("l") / temperature) / F.count("*")).alias("v"))
    return (
        summed.groupBy("name", "group_id")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("s"))
        .select("name", "group_id", F.transform("s", lambda x: x["v"]).alias("logits"))
    )


def sample_letters(
    positions: DataFrame,
    temperatures: list[float],
    samples: int,
    noise: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """One draw for each position, temperature and sample; positions: name, pos, logits, native_idx, design.

    noise(pos, temperature number, sample) gives the uniform; rand() if None. Positions that aren't designed keep their native letter, and
    their probabilities are zero. At temperature 0 the most likely letter is taken.
    """
    grid = F.array(*[F.struct(F.lit(i).alias("t_no"), F.lit(float(t)).alias("temperature")) for i, t in enumerate(temperatures)])
    rows = (
        positions.withColumn("g", F.explode(grid))
        .select(*positions.columns, "g.t_no", "g.temperature")
        .withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    )
    probs = F.when(
        F.col("temperature") > 0,
        arrays.softmax(F.transform("logits", lambda v: v / F.when(F.col("temperature") > 0, F.col("temperature")).otherwise(1.0))),
    )
    u = F.rand() if noise is None else noise(F.col("pos"), F.col("t_no"), F.col("sample_id"))
    drawn = rows.withColumn("_p", probs).withColumn("_u", u)
    best = F.array_position("logits", F.array_max("logits")).cast("int") - 1
    idx = F.when(F.col("design") == 0, F.col("native_idx")).when(F.col("temperature") == 0, best).otherwise(arrays.draw(F.col("_p"), F.col("_u")))
    return drawn.withColumn("idx", idx.cast("int")).withColumn("probs", F.transform("_p", lambda p: p * F.col("design"))).drop("_p", "_u")


def tied_sample(
    members: DataFrame,
    temperature: float,
    noise: Callable[[Column], Column],
    omit: str = "",
    letter_bias: dict[str, float] | None = None,
    pssm_multi: float | None = None,
    log_odds_threshold: float | None = None,
) -> DataFrame:
    """name, group_id, member, pos, idx: one draw for each group, shared by its members. members: name, group_id, member (the place in the group's list),
    pos, beta, logits, native_idx, design, and bias (21 numbers); coef and pssm_bias with pssm_multi, log_odds with log_odds_threshold; omit_mask if there.

    A group with a member that isn't designed takes the native letter of the first such one in its list. Bias, PSSM, log-odds and omitted letters
    are those of the last member in the list. omit: letters left out everywhere.
    """
    shared = tied_logits(members, temperature)
    optional = [c for c, wanted in (("coef", pssm_multi), ("pssm_bias", pssm_multi), ("log_odds", log_odds_threshold)) if wanted is not None] + (["omit_mask"] if "omit_mask" in members.columns else [])
    kept = F.min_by("native_idx", F.when(F.col("design") == 0, F.col("member")))
    last = F.max_by(F.struct("bias", *optional), "member").alias("_last")
    marks = members.groupBy("name", "group_id").agg(kept.alias("kept"), last).select("name", "group_id", "kept", "_last.*")
    everywhere = F.array(*[F.lit(float((letter_bias or {}).get(c, 0.0))) for c in MODEL_ORDER])
    scaled = F.transform("logits", lambda v: v * temperature)
    probs = arrays.temperature_probs(scaled, F.lit(temperature), everywhere, F.col("bias"), arrays.letter_mask(omit))
    if pssm_multi is not None:
        probs = arrays.blend(probs, F.col("coef"), F.col("pssm_bias"), pssm_multi)
    if log_odds_threshold is not None:
        probs = arrays.log_odds_gate(probs, F.col("log_odds"), log_odds_threshold)
    if "omit_mask" in optional:
        probs = arrays.without(probs, F.col("omit_mask"))
    picked = shared.join(marks, ["name", "group_id"]).select(
        "name",
        "group_id",
        F.coalesce("kept", arrays.draw(probs, noise(F.col("group_id")))).cast("int").alias("idx"),
    )
    return members.select("name", "group_id", "member", "pos").join(picked, ["name", "group_id"])


def tied_consistency(samples: DataFrame, by: list[str]) -> DataFrame:
    """consistent: all members of a group carry one letter."""
    return samples.groupBy(*by).agg((F.count_distinct("aa") == 1).alias("consistent"))


def best_per_pose(results: DataFrame, k: int = 1) -> DataFrame:
    return results.withColumn("rank", F.row_number().over(W.partitionBy("pose").orderBy("score", "sequence"))).filter(F.col("rank") <= k)


def rank_results(results: DataFrame) -> DataFrame:
    """By numeric score, ascending."""
    return results.orderBy(F.col("score").cast("double"), "pose", "sequence")


def global_rank(results: DataFrame) -> DataFrame:
    """rank: each result's place among all, by numeric score, pose and sequence; rows are dealt by ranges, none meets all others."""
    return numbered(results.withColumn("_score", F.col("score").cast("double")), ["_score", "pose", "sequence"], "rank").drop("_score")


def length_batches(lengths: DataFrame, budget: int) -> DataFrame:
    """batch: structures of a length bucket (a power of two) packed, by length, so that a batch's padded size stays under the budget; none is lost.

    Places in a bucket come from ranges of (bucket, length, name), so a bucket, or one length, may hold any part of the structures.
    """
    bucket = F.ceil(F.log2(F.greatest("length", F.lit(1)))).cast("int")
    per = F.greatest(F.floor(F.lit(budget) / F.pow(F.lit(2), F.col("bucket"))), F.lit(1)).cast("long")
    placed = numbered(lengths.withColumn("bucket", bucket), ["length", "name"], "_place", ["bucket"])
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / per)).drop("_place")


def run_summary(samples: DataFrame, temperatures: int, copies: int) -> DataFrame:
    """name, n_samples, longest, asked (temperatures * copies)."""
    return (
        samples.groupBy("name")
        .agg(F.count("*").alias("n_samples"), F.max(F.length("sequence")).cast("long").alias("longest"))
        .withColumn("asked", F.lit(temperatures * copies).cast("long"))
    )


def sort_chains(parts: DataFrame, by: list[str]) -> DataFrame:
    """sequence: chains in letter order, joined by /; parts: by, chain, seq."""
    return (
        parts.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("chain", "seq"))).alias("c"))
        .select(*by, F.array_join(F.transform("c", lambda c: c["seq"]), "/").alias("sequence"))
    )


def split_chains(sequences: DataFrame) -> DataFrame:
    """chain_no, chain_seq, chain_len of /-joined sequences."""
    parts = sequences.select("*", F.posexplode(F.split("sequence", "/")).alias("_n", "chain_seq"))
    return parts.withColumn("chain_no", F.col("_n") + 1).withColumn("chain_len", F.length("chain_seq").cast("long")).drop("_n", "sequence")


#: Scorers by the function that makes them: a Python worker keeps its module, so each is made once in it.
_scorers: dict[Callable, Callable] = {}

#: Positions that are scored in a task, about.
_SCORED = 500_000


def score_with_model(features: DataFrame, schema: str, model: Callable, budget: int = 16_384) -> DataFrame:
    """A user's scorer on padded batches of structures; model, an importable function, makes the scorer once in each worker.

    features: name, global_pos (0, 1, ... in each structure), aa, mask. Structures of about the same length are packed to ``budget`` positions a batch, padding counted (length_batches,
    pad_batch); one longer than that is a batch of its own, behind no other. The scorer gets a pandas frame of a batch, by name and global_pos, every structure as many rows as the longest,
    X and mask 0 where padded; it returns a row for each row, in the same order, of which those of padding are left out.

    A structure is one row until its batch is scored: features are worked out once and written so, and padding is made where the scorer runs.
    """
    ship(features.sparkSession)
    at = F.col("global_pos").cast("int")
    residue = F.struct(at.alias("at"), F.coalesce("aa", F.lit("X")).alias("aa"), F.coalesce("mask", F.lit(0)).alias("mask"))
    gathered = features.groupBy("name").agg(F.count("*").alias("length"), F.collect_list(F.when(at.isNotNull(), residue)).alias("_r"))
    structures = cut(gathered.select("name", "length", *[F.col("_r")[c].alias(c) for c in ("at", "aa", "mask")]), "structures")
    batches = length_batches(structures.select("name", "length"), budget)

    def run(pdf):
        from strandframe.operators import scoring

        if model not in scoring._scorers:
            scoring._scorers[model] = model()
        frame, padded = scoring._padded(pdf)
        out = scoring._scorers[model](frame)
        if len(out) != len(frame):
            raise ValueError("a scorer gives a row for each row")
        return out[~padded]

    # Structures are never broadcast, and tasks are made by positions, however small the files and rows are that hold them.
    tasks = -(-(structures.agg(F.sum("length")).first()[0] or 1) // _SCORED)
    return structures.drop("length").join(batches.hint("merge"), "name").repartition(tasks, "bucket", "batch").groupBy("bucket", "batch").applyInPandas(run, schema)


def _padded(pdf):
    """A batch's residues by name and global_pos, every structure as many as the longest, and which of them are padding; pdf: name, length, and at, aa and mask as arrays."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("name", ignore_index=True)
    n, lengths = len(pdf), pdf["length"].to_numpy()
    longest = int(lengths.max())
    at = np.concatenate(pdf["at"].to_list()).astype(np.int64)
    place, own = np.repeat(np.arange(n) * longest, pdf["at"].map(len)) + at, (at >= 0) & (at < longest)
    masks = np.concatenate(pdf["mask"].to_list())
    aa, mask = np.full(n * longest, "X", object), np.zeros(n * longest, masks.dtype)
    aa[place[own]], mask[place[own]] = np.concatenate(pdf["aa"].to_list())[own], masks[own]
    global_pos = np.tile(np.arange(longest, dtype=np.int32), n)
    frame = pd.DataFrame({"name": np.repeat(pdf["name"].to_numpy(), longest), "global_pos": global_pos, "aa": aa, "mask": mask})
    return frame, global_pos >= np.repeat(lengths, longest)
