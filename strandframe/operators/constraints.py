"""Per-position design constraints: joined to residues, and built from rules.

Residues and constraints meet in hash joins on (name, chain, pos); letters come from literals. Spark broadcasts a side where it is small. What follows from a constraint is
worked out in its own rows, before residues meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import softmax
from ..functions.letters import MODEL_ORDER, letters

KEY = ["name", "chain", "pos"]


def apply_fixed(residues: DataFrame, fixed: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """chain_m_pos: 0 at fixed positions of designed chains (all chains, without roles), else 1."""
    marks = fixed.select(*KEY).distinct().withColumn("_fixed", F.lit(True))
    out = residues.join(marks, KEY, "left")
    designed = F.lit(True)
    if roles is not None:
        out = out.join(
            roles.filter("role = 'designed'").select("name", "chain", F.lit(True).alias("_designed")).distinct(),
            ["name", "chain"],
            "left",
        )
        designed = F.coalesce("_designed", F.lit(False))
    return out.withColumn("chain_m_pos", F.when(F.col("_fixed").isNotNull() & designed, 0).otherwise(1)).drop("_fixed", "_designed")


def missing_keys(residues: DataFrame, constraint: DataFrame) -> DataFrame:
    """Structures and chains that a constraint table doesn't name; see require_keys."""
    return residues.select("name", "chain").distinct().join(constraint.select("name", "chain").distinct(), ["name", "chain"], "left_anti")


def require_keys(residues: DataFrame, constraint: DataFrame) -> DataFrame:
    """residues, if the constraint table names all their structures and chains; else an error with some that it doesn't: for callers that take no defaults."""
    missing = missing_keys(residues, constraint).sort("name", "chain").take(5)
    if missing:
        raise ValueError(f"no constraint is given for {[(r['name'], r['chain']) for r in missing]}")
    return residues


def apply_omit(residues: DataFrame, omit: DataFrame) -> DataFrame:
    """omit_mask: 1 for each letter of the model's order that is omitted at the position."""
    marks = [F.coalesce(F.max(F.when(F.col("aa") == c, 1.0)), F.lit(0.0)) for c in MODEL_ORDER]
    own = omit.groupBy(*KEY).agg(F.array(*marks).alias("_own"))
    none = F.array(*[F.lit(0.0)] * len(MODEL_ORDER))
    return residues.join(own, KEY, "left").withColumn("omit_mask", F.coalesce("_own", none)).drop("_own")


def apply_pssm(residues: DataFrame, pssm: DataFrame) -> DataFrame:
    """coef, bias, log_odds of the position; 0, zeros and 10000s where there are none. Of several rows for a position the greatest counts, by coef, then bias, then log_odds."""
    n = len(MODEL_ORDER)
    one = pssm.groupBy(*KEY).agg(F.max(F.struct("coef", "bias", "log_odds")).alias("_row"))
    joined = residues.join(one.select(*KEY, "_row.*"), KEY, "left")
    return joined.withColumns(
        {
            "coef": F.coalesce("coef", F.lit(0.0)),
            "bias": F.coalesce("bias", F.array_repeat(F.lit(0.0), n)),
            "log_odds": F.coalesce("log_odds", F.array_repeat(F.lit(10000.0), n)),
        }
    )


def apply_bias(residues: DataFrame, bias_pos: DataFrame, bias_aa: dict[str, float]) -> DataFrame:
    """bias: for every letter of the model's order the position's bias (rows name, chain, pos, aa, bias; rows of a letter add up) plus the letter's."""
    letter = [F.lit(float(bias_aa.get(c, 0.0))) for c in MODEL_ORDER]
    sums = [F.coalesce(F.sum(F.when(F.col("aa") == c, F.col("bias"))), F.lit(0.0)) + v for c, v in zip(MODEL_ORDER, letter, strict=True)]
    own = bias_pos.groupBy(*KEY).agg(F.array(*sums).alias("_own"))
    return residues.join(own, KEY, "left").withColumn("bias", F.coalesce("_own", F.array(*[F.lit(0.0) + v for v in letter]))).drop("_own")


def expand_tied(tied: DataFrame, offsets: DataFrame) -> DataFrame:
    """global_pos of each member of a tied group, by its chain's start; beta is 1 where not given."""
    joined = tied.join(offsets.select("name", "chain", "start"), ["name", "chain"])
    return joined.select(
        "name",
        "group_id",
        "member",
        "chain",
        "pos",
        F.coalesce("beta", F.lit(1.0)).alias("beta"),
        (F.col("start") + F.col("pos") - 1).alias("global_pos"),
    )


def fixed_chains(chains: DataFrame, designed: DataFrame) -> DataFrame:
    """name, chain, role: fixed are the chains that aren't listed as designed; a structure without list has all designed."""
    listed = designed.select("name").distinct()
    semi = chains.join(designed, ["name", "chain"], "left_semi").withColumn("role", F.lit("designed"))
    rest = chains.join(designed, ["name", "chain"], "left_anti")
    return semi.unionByName(rest.join(listed, "name", "left_semi").withColumn("role", F.lit("fixed"))).unionByName(
        rest.join(listed, "name", "left_anti").withColumn("role", F.lit("designed"))
    )


def parse_requests(tasks: DataFrame) -> DataFrame:
    """Tasks' text lists: chains split at blanks or at anything but letters, positions ('1 2, 3 4') as lists of int."""
    chains = F.filter(F.split("chain_text", "[^A-Za-z]+"), lambda c: c != "")
    positions = F.transform(F.split(F.trim("position_text"), "\\s*,\\s*"), lambda p: F.transform(F.split(p, "\\s+"), lambda x: x.try_cast("int")))
    return tasks.withColumn("chains", chains).withColumn("positions", positions)


def broadcast_assignment(structures: DataFrame, settings: list[dict[str, object]]) -> DataFrame:
    """A user's settings (dictionaries with the same keys) for every structure: a row for each structure and setting."""
    if not settings:
        raise ValueError("no setting is given")
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in one.items()]) for one in settings])
    return structures.withColumn("_setting", F.explode(rows)).select(*structures.columns, "_setting.*")


def fixed_from_assignment(structures: DataFrame, chains: list[str], positions: list[list[int]]) -> DataFrame:
    """name, chain, pos: the same fixed positions for every structure that has the chain."""
    rules = F.array(
        *[F.struct(F.lit(c).alias("chain"), F.array(*[F.lit(p) for p in ps]).alias("positions")) for c, ps in zip(chains, positions, strict=True)]
    )
    each = structures.select("name", "chain", F.explode(rules).alias("r")).filter(F.col("chain") == F.col("r.chain"))
    return each.select("name", "chain", F.explode("r.positions").alias("pos"))


def tied_homooligomer(chains: DataFrame) -> DataFrame:
    """group_id i ties position i of every chain, up to the length of the first chain in order."""
    first = chains.groupBy("name").agg(F.min_by("len", "chain").alias("n"))
    groups = first.select("name", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("group_id"))
    return groups.join(chains.select("name", "chain"), "name").select(
        "name",
        "group_id",
        "chain",
        F.col("group_id").alias("pos"),
        F.lit(1.0).alias("beta"),
    )


def tied_lists(structures: DataFrame, chains: list[str], positions: list[list[int]]) -> DataFrame:
    """group_id i ties the i-th position of each listed chain."""
    if len({len(p) for p in positions}) > 1:
        raise ValueError("position lists differ in length")
    rows = F.array(*[F.struct(F.lit(c).alias("chain"), F.lit(i + 1).alias("group_id"), F.lit(p).alias("pos")) for c, ps in zip(chains, positions, strict=True) for i, p in enumerate(ps)])
    return (
        structures.select("name")
        .distinct()
        .select("name", F.explode(rows).alias("r"))
        .select("name", "r.group_id", "r.chain", "r.pos", F.lit(1.0).alias("beta"))
    )


def tied_weighted(chains: DataFrame, betas: dict[str, float]) -> DataFrame:
    """As tied_homooligomer over the weighted chains; positive and negative design by beta."""
    if not betas:
        raise ValueError("a weighted tie needs chains with weights")
    weight = F.create_map(*[x for c, b in betas.items() for x in (F.lit(c), F.lit(float(b)))])
    own = chains.filter(F.col("chain").isin(*betas))
    return tied_homooligomer(own).withColumn("beta", weight[F.col("chain")])


def position_bias(residues: DataFrame, rules: DataFrame) -> DataFrame:
    """bias: 21 numbers for each residue, from rules (chain, pos, aa, bias); rules for a letter add up."""
    summed = rules.groupBy("chain", "pos").pivot("aa", list(MODEL_ORDER)).agg(F.sum("bias"))
    return (
        residues.select(*KEY)
        .join(summed, ["chain", "pos"], "left")
        .select("name", "chain", "pos", F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in MODEL_ORDER]).alias("bias"))
    )


def omit_rules(chains: DataFrame, rules: DataFrame) -> DataFrame:
    """rules of each chain as a list of (positions, letters); empty where there are none. rules: name, chain, positions, letters."""
    lists = rules.groupBy("name", "chain").agg(F.array_sort(F.collect_list(F.struct("positions", "letters"))).alias("rules"))
    empty = F.array().cast("array<struct<positions:array<int>,letters:string>>")
    return chains.select("name", "chain").join(lists, ["name", "chain"], "left").withColumn("rules", F.coalesce("rules", empty))


def permute_pssm(values: Column, order: str = "ARNDCQEGHILKMFPSTWYV") -> Column:
    """20 numbers of the given letter order in the model's order; letters without number get 0."""
    return F.array(*[values[order.index(c)] if c in order else F.lit(0.0) for c in MODEL_ORDER])


def build_pssm(rows: DataFrame) -> DataFrame:
    """coef 1, bias softmax(log-odds - 1e8 at X), log_odds, from (name, chain, pos, log_odds of 20)."""
    moved = permute_pssm(F.col("log_odds"))
    no_x = F.array(*[moved[i] - (1e8 if c == "X" else 0.0) for i, c in enumerate(MODEL_ORDER)])
    return rows.select(*KEY, F.lit(1.0).alias("coef"), softmax(no_x).alias("bias"), moved.alias("log_odds"))


def design_mask(positions: DataFrame, mode: str) -> DataFrame:
    """design: mask * chain_m * chain_m_pos ('designed'), or mask ('whole')."""
    if mode not in ("designed", "whole"):
        raise ValueError(f"unknown mode {mode!r}")
    value = F.col("mask") * F.col("chain_m") * F.col("chain_m_pos") if mode == "designed" else F.col("mask")
    return positions.withColumn("design", value)


def union_chain_sets(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def bad_letters(sequences: DataFrame, allowed: str = MODEL_ORDER + "-") -> DataFrame:
    """Each sequence's letters that aren't allowed."""
    return sequences.withColumn("bad", F.array_sort(F.array_except(F.array_distinct(letters(F.col("seq"))), F.array(*[F.lit(c) for c in allowed]))))


def pad_batch(residues: DataFrame, batches: DataFrame) -> DataFrame:
    """For export and scorers: each structure's residues (name, global_pos, aa, mask) up to its batch's longest, X, mask 0 and padded where there are none."""
    sizes = batches.join(batches.groupBy("batch").agg(F.max("length").alias("longest")), "batch")
    grid = sizes.select("batch", "name", F.explode(F.sequence(F.lit(0), (F.col("longest") - 1).cast("int"))).alias("global_pos"), "length")
    return (
        grid.join(residues.select("name", F.col("global_pos").cast("int"), "aa", "mask"), ["name", "global_pos"], "left")
        .withColumn("aa", F.coalesce("aa", F.lit("X")))
        .withColumn("mask", F.coalesce("mask", F.lit(0)))
        .withColumn("padded", F.col("global_pos") >= F.col("length"))
        .drop("length")
    )
