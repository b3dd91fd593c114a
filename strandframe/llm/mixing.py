"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they are), normalised. The exponent is
found by bisection: the largest whose weights have an entropy of ``entropy`` times the largest possible, or, where that would
repeat a source more than ``max_repeat`` times, the least one that doesn't. Each round asks Spark for one aggregate over the sources' totals
at the points of a finer bracket; sources never come to the driver.

The budget is the least one that holds every source once, or is given. It is realised in blocks: a source's documents fall into
``blocks`` blocks by hash; every epoch permutes a source's blocks anew; whole epochs take all blocks, the last one as many blocks of
its permutation as fit into what is left of the source's budget. So weights are met within one block of each source.

Tokens are words between ASCII white space. A source without tokens keeps its documents once; null is a source of its own; repeated
rows share a block and are each kept, as do all null doc_ids of a source; null texts have no tokens; columns named like those added are replaced;
empty in, empty out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

ADDED = ["n_tokens", "epoch", "block", "place"]
#: Places in the blocks' table up to which it is broadcast; beyond, it is joined by shuffle, each block in _SALTS parts.
_BROADCAST_PLACES, _SALTS = 1_000_000, 64


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def _drawn(seed: int, *of: Column) -> Column:
    """A number below 2**60 drawn by the columns and the seed: MD5, which other engines have too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in of])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def exponent(totals: DataFrame, entropy: float, max_repeat: float, budget: int | None, points: int = 16, rounds: int = 5) -> float:
    """The exponent for sources with t tokens each (t > 0); see above."""
    top = totals.agg(F.max("t").alias("top"), F.count("*").alias("n"), F.sum("t").alias("all")).first()
    if not top["n"]:
        return 1.0

    def measured(low: float, high: float) -> list[tuple[float, float, float]]:
        grid = [low + (high - low) * i / points for i in range(points + 1)]
        x = F.log(F.col("t") / F.lit(float(top["top"])))
        rows = totals.select(
            "t",
            F.explode(F.array(*[F.lit(a) for a in grid])).alias("a"),
        ).select("a", x.alias("x"), F.exp(F.col("a") * x).alias("e"))
        # Times that a source is repeated: budget * weight / t; without a budget, the largest source once.
        got = (
            rows.groupBy("a")
            .agg(F.sum("e").alias("z"), F.sum(F.col("e") * F.col("a") * F.col("x")).alias("s"), F.max(F.col("e") / F.exp("x")).alias("r"))
            .select(
                "a",
                (F.log("z") - F.col("s") / F.col("z")).alias("h"),
                (F.col("r") if budget is None else F.col("r") * budget / F.col("z") / float(top["top"])).alias("r"),
            )
        )
        return sorted((r["a"], r["h"], r["r"]) for r in got.collect())

    def bisect(holds, first_that_holds: bool) -> float:
        """Where a condition that changes once between 0 and 1 does so, on the side where it holds."""
        low, high = 0.0, 1.0
        for _ in range(rounds):
            seen = [(a, holds(h, r)) for a, h, r in measured(low, high)]
            good = [a for a, ok in seen if ok]
            if not good:
                return 1.0
            edge = min(good) if first_that_holds else max(good)
            if edge == (low if first_that_holds else high):
                return edge
            step = (high - low) / points
            low, high = (edge - step, edge) if first_that_holds else (edge, edge + step)
        return edge

    by_entropy = bisect(lambda h, r: h >= entropy * math.log(top["n"]) - 1e-9, False)
    by_repeat = bisect(lambda h, r: r <= max_repeat + 1e-9, True)
    return round(max(by_entropy, by_repeat), 6)


def plan(counted: DataFrame, entropy: float, max_repeat: float, budget: int | None, blocks: int, seed: int) -> tuple[DataFrame, int]:
    """source, block and the block's places, one for each epoch that takes it; and the number of places."""
    each = common.cut(counted.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")), "mix-blocks")
    totals = common.cut(each.groupBy("source").agg(F.sum("t").alias("t")), "mix-totals")
    full = totals.filter("t > 0")
    a = exponent(full, entropy, max_repeat, budget)
    top = full.agg(F.max("t").alias("top"), F.sum(F.pow(F.col("t").cast("double"), F.lit(a))).alias("z")).first()
    if budget is None:
        times = F.pow(F.lit(float(top["top"] or 1)) / F.col("t"), F.lit(1 - a))
    else:
        times = F.pow(F.col("t").cast("double"), F.lit(a)) / F.lit(top["z"] or 1.0) * budget / F.col("t")
    goal = totals.select(
        F.col("source").alias("_strand_s"),
        F.when(F.col("t") > 0, F.round(times, 9)).otherwise(1.0).alias("times"),
        F.col("t").alias("total"),
    )
    ranked = each.join(goal, F.col("source").eqNullSafe(F.col("_strand_s"))).withColumn("whole", F.floor("times").cast("int"))
    order = W.partitionBy("source").orderBy(_drawn(seed, F.col("source"), F.col("block"), F.col("whole") + 1), "block")  # the last epoch's permutation; a source has `blocks` rows here
    ranked = ranked.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("t").over(order.rowsBetween(W.unboundedPreceding, 0)))
    extra = (F.col("upto") <= (F.col("times") - F.col("whole")) * F.col("total") + 1e-6) & (F.col("times") > F.col("whole"))
    copies = F.col("whole") + extra.cast("int")
    places = F.transform(F.sequence(F.lit(1), "copies"), lambda epoch: _drawn(seed, F.col("source"), F.col("block"), epoch))
    made = common.cut(
        ranked.withColumn("copies", copies)
        .filter("copies > 0")
        .select(F.col("source").alias("_strand_s"), F.col("block").alias("_strand_b"), places.alias("_strand_places")),
        "mix-plan",
    )
    return made, made.agg(F.sum(F.size("_strand_places"))).first()[0] or 0


def mixture(
    docs: DataFrame,
    entropy: float = 0.97,
    max_repeat: float = 4.0,
    budget: int | None = None,
    blocks: int = 256,
    seed: int = 42,
    broadcast_places: int = _BROADCAST_PLACES,
) -> DataFrame:
    """The rows of docs as often as their source's weight asks, with n_tokens, epoch (1, 2, ...), block, and place: of the block in its epoch."""
    names = [c for c in common.unreserved(docs).columns if c not in ADDED]
    counted = (
        docs.select(*names)
        .withColumn("n_tokens", n_tokens(F.col("text").cast("string")))
        .withColumn("block", (_drawn(seed, F.col("doc_id")) % blocks).cast("int"))
    )
    made, held = plan(counted.select("source", "block", "n_tokens"), entropy, max_repeat, budget, blocks, seed)
    same = F.col("source").eqNullSafe(F.col("_strand_s")) & (F.col("block") == F.col("_strand_b"))
    if held <= broadcast_places:
        joined = counted.join(F.broadcast(made), same)
    else:  # a block of a source with a third of all rows would be too much for one task
        salted = made.withColumn("_strand_part", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = counted.withColumn(
            "_strand_salt",
            F.pmod(F.xxhash64("doc_id", F.col("text").cast("string")), F.lit(_SALTS)).cast("int"),
        ).join(salted, same & (F.col("_strand_salt") == F.col("_strand_part")))
    return (
        joined.select("*", F.posexplode("_strand_places").alias("_strand_e", "place"))
        .withColumn("epoch", F.col("_strand_e") + 1)
        .select(*names, *ADDED)
    )


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    found = mixture(common.docs_of(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "n_tokens", "epoch", "block", "place")


def _sql_drawn(*of: str, seed: int = 42) -> str:
    return (
        "CAST('0x' || substr(md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(
            f"coalesce(CAST({c} AS VARCHAR), '')" for c in of
        ) + ")), 1, 15) AS BIGINT)"
    )


#: The bisection ends on multiples of 2**-20; SQL looks at all of them.
ORACLE = {
    "op5_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens, CAST({_sql_drawn("doc_id")} % 256 AS INT) AS block FROM documents),
b AS (SELECT source, block, sum(n_tokens) AS t FROM d GROUP BY source, block),
s AS (SELECT source, CAST(sum(t) AS BIGINT) AS total FROM b GROUP BY source),
f AS (SELECT total, ln(CAST(total AS DOUBLE) / (SELECT max(total) FROM s)) AS x FROM s WHERE total > 0),
g AS (SELECT j / 1048576.0::DOUBLE AS a FROM generate_series(0, 1048576) AS q(j)),
z AS (SELECT a, sum(exp(a * x)) AS z, sum(exp(a * x) * a * x) AS s, max(exp(a * x) / exp(x)) AS r FROM f CROSS JOIN g GROUP BY a),
p AS (SELECT coalesce(round(greatest(max(a) FILTER (WHERE ln(z) - s / z >= 0.97 * ln((SELECT count(*) FROM f)::DOUBLE) - 1e-9), min(a) FILTER (WHERE r <= 4 + 1e-9)), 6), 1) AS a FROM z),
w AS (SELECT source, total, CASE WHEN total > 0 THEN round(pow((SELECT max(total) FROM s)::DOUBLE / total, 1 - (SELECT a FROM p)), 9) ELSE 1 END AS times FROM s),
k AS (SELECT b.source, b.block, b.t, total, times, CAST(floor(times) AS INT) AS whole FROM b JOIN w ON b.source IS NOT DISTINCT FROM w.source),
c AS (SELECT *, sum(t) OVER (PARTITION BY source ORDER BY {_sql_drawn("source", "block", "whole + 1")}, block ROWS UNBOUNDED PRECEDING) AS upto FROM k),
n AS (SELECT source, block, whole + CASE WHEN upto <= (times - whole) * total + 1e-6 AND times > whole THEN 1 ELSE 0 END AS copies FROM c),
e AS (SELECT d.*, unnest(generate_series(1, copies)) AS epoch FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source AND d.block = n.block)
SELECT doc_id, source, n_tokens, CAST(epoch AS INT) AS epoch, block, {_sql_drawn("source", "block", "epoch")} AS place FROM e""",
}
