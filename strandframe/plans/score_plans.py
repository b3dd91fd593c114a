"""Queries on probabilities, samples, scores and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.letters import MODEL_ORDER
from ..operators import campaign
from ..operators import constraints as C
from ..operators import residues as R
from ..operators import scoring as S
from ..scratch import cut, new_path
from ..streaming import leaderboard
from . import fixtures as fx
from . import residue_plans as plans
from .fixtures import sql
from .registry import query

_U = "CAST((pos * 7919 + {t} * 611953 + {s} * 104729) % 10007 AS DOUBLE) / 10007.0"


def noise(pos, t_no, sample):
    return ((pos * 7919 + t_no * 611953 + sample * 104729) % 10007).cast("double") / 10007.0


def positions(spark, sf_dir) -> DataFrame:
    """name, pos, logits, log_probs, idx (the chosen letter), mask."""
    p = fx.logits(spark, sf_dir)
    return (
        p.withColumn("log_probs", arrays.log_softmax(F.col("logits")))
        .withColumn("idx", (F.col("pos") * 7 % 21).cast("int"))
        .withColumn("mask", (F.col("pos") % 5 != 0).cast("int"))
    )


_POS = (
    "q AS (SELECT name, pos, max(lp) FILTER (WHERE idx = pos * 7 % 21) AS lp, sum(lp) AS all_lp, CASE "
    "WHEN pos % 5 <> 0 THEN 1 ELSE 0 END AS mask FROM fx_soft GROUP BY name, pos)"
)


def _long(df: DataFrame, column: str, to: str = "v", keys: tuple[str, ...] = ("name", "pos"), digits: int = 6) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("idx", to)).withColumn(to, F.round(to, digits))


@query("log_softmax", sql("SELECT name, pos, idx, round(lp, 6) AS v FROM fx_soft", "fx_soft"))
def log_softmax(spark, sf_dir):
    return _long(positions(spark, sf_dir), "log_probs")


_TEMP = (
    "SELECT name, pos, idx, round(e / sum(e) OVER p, 6) AS v FROM (SELECT *, exp(w - max(w) OVER p) AS e FROM (SELECT *, (l + CASE "
    "WHEN idx = 5 THEN 1.0 ELSE 0.0 END + CASE WHEN pos % 2 = 0 AND idx = 9 THEN 2.0 ELSE 0.0 END) / 0.5 - 1e8 * CASE "
    "WHEN idx = 20 THEN 1.0 ELSE 0.0 END AS w FROM fx_logp) WINDOW p AS (PARTITION BY name, pos)) WINDOW p AS (PARTITION BY name, pos)"
)


def _one(letter_index: int, value: float):
    return F.array(*[F.lit(value if i == letter_index else 0.0) for i in range(21)])


def _probs(spark, sf_dir) -> DataFrame:
    pos_bias = F.when(F.col("pos") % 2 == 0, _one(9, 2.0)).otherwise(_one(9, 0.0))
    return fx.logits(spark, sf_dir).withColumn("probs", arrays.temperature_probs(F.col("logits"), F.lit(0.5), _one(5, 1.0), pos_bias, _one(20, 1.0)))


@query("softmax_temperature", sql(_TEMP, "fx_logp"))
def softmax_temperature(spark, sf_dir):
    return _long(_probs(spark, sf_dir), "probs")


@query("global_omit", sql(
    f"SELECT name, pos, string_agg(CASE WHEN substr('{MODEL_ORDER}', CAST(idx + 1 AS INT), 1) IN ('X', 'C') THEN '1' ELSE '0' END, '' "
    f"ORDER BY idx) AS omit FROM fx_logp GROUP BY name, pos", "fx_logp"))
def global_omit(spark, sf_dir):
    return fx.logits(spark, sf_dir).select(
        "name",
        "pos",
        F.array_join(F.transform(arrays.letter_mask("XC"), lambda v: v.cast("int").cast("string")), "").alias("omit"),
    )


def _soft(spark, sf_dir) -> DataFrame:
    return fx.logits(spark, sf_dir).withColumn("probs", arrays.softmax(F.col("logits")))


@query("pssm_blend", sql("SELECT name, pos, idx, round((1 - 0.3 * 0.5) * p + 0.3 * 0.5 * CASE WHEN idx = 3 THEN 1.0 ELSE 0.0 END, 6) AS v FROM fx_soft", "fx_soft"))
def pssm_blend(spark, sf_dir):
    return _long(_soft(spark, sf_dir).withColumn("b", arrays.blend(F.col("probs"), F.lit(0.5), _one(3, 1.0), 0.3)), "b")


@query("log_odds_gate", sql(
    "SELECT name, pos, idx, round(g / sum(g) OVER (PARTITION BY name, pos), 6) AS v FROM (SELECT *, p * CASE "
    "WHEN l > 0 THEN 1.001 ELSE 0.001 END AS g FROM fx_soft)", "fx_soft"))
def log_odds_gate(spark, sf_dir):
    return _long(_soft(spark, sf_dir).withColumn("g", arrays.log_odds_gate(F.col("probs"), F.col("logits"), 0.0)), "g")


@query("position_omit", sql(
    "SELECT name, pos, idx, round(g / sum(g) OVER (PARTITION BY name, pos), 6) AS v FROM (SELECT *, p * CASE "
    "WHEN idx = pos % 21 THEN 0.0 ELSE 1.0 END AS g FROM fx_soft)", "fx_soft"))
def position_omit(spark, sf_dir):
    omit = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.when(i == F.col("pos") % 21, 1.0).otherwise(0.0))
    return _long(_soft(spark, sf_dir).withColumn("g", arrays.without(F.col("probs"), omit)), "g")


@query("one_hot_mask", sql(
    f"SELECT name, chain, pos, string_agg(CASE WHEN chain = 'A' OR substr('{MODEL_ORDER}', CAST(i + 1 AS INT), 1) = aa THEN '1' ELSE '0' END, "
    f"'' ORDER BY i) AS allowed FROM residues CROSS JOIN (SELECT unnest(range(0, 20)) AS i) GROUP BY name, chain, pos, aa", "residues"))
def one_hot_mask(spark, sf_dir):
    """Chain A is the binder: all letters; others keep their own."""
    own = F.array(*[F.when((F.col("chain") == "A") | (F.col("aa") == c), "1").otherwise("0") for c in MODEL_ORDER[:20]])
    return plans.residues(spark, sf_dir).select("name", "chain", "pos", F.array_join(own, "").alias("allowed"))


def _sample_sql(extra: str = "") -> str:
    return f"""WITH g AS (SELECT f.name, f.pos, f.idx, f.l / t.temperature AS w, t.t_no, t.temperature, s.sample_id FROM fx_logp f CROSS JOIN (VALUES (0, 0.5), (1, 1.0)) AS t(t_no, temperature) CROSS JOIN (SELECT unnest(range(0, 2)) AS sample_id) AS s),
e AS (SELECT *, exp(w - max(w) OVER p) AS e FROM g WINDOW p AS (PARTITION BY name, pos, t_no, sample_id)),
d AS (SELECT *, sum(e) OVER (PARTITION BY name, pos, t_no, sample_id ORDER BY idx ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY name, pos, t_no, sample_id) AS cdf FROM e),
drawn AS (SELECT name, pos, temperature, sample_id, CASE WHEN pos % 4 = 0 THEN pos * 7 % 21 ELSE least(count(*) FILTER (WHERE round(cdf, 9) < {_U.format(t="t_no", s="sample_id")}), 20) END AS idx FROM d GROUP BY name, pos, t_no, temperature, sample_id)"""


def sampled(spark, sf_dir) -> DataFrame:
    p = (
        positions(spark, sf_dir)
        .withColumn("native_idx", F.col("idx"))
        .withColumn("design", (F.col("pos") % 4 != 0).cast("int"))
        .drop("idx", "log_probs", "mask")
    )
    return S.sample_letters(p, [0.5, 1.0], 2, noise)


@query("sample_letters", sql(f"{_sample_sql()} SELECT name, pos, temperature, sample_id, idx FROM drawn", "fx_logp"))
def sample_letters(spark, sf_dir):
    return sampled(spark, sf_dir).select("name", "pos", "temperature", "sample_id", "idx")


_MEMBERS = (
    "m AS (SELECT name, pos, CAST(ceil(pos / 2.0) AS BIGINT) AS group_id, pos % 2 AS member, idx, l, CASE "
    "WHEN pos % 2 = 0 THEN -0.5 ELSE 1.0 END AS beta, pos * 7 % 21 AS native_idx, CASE WHEN pos % 9 = 0 THEN 0 ELSE 1 END AS design "
    "FROM fx_logp), t AS (SELECT name, group_id, idx, sum(beta * l / 0.5) / count(*) AS v FROM m GROUP BY name, group_id, idx)"
)


def members(spark, sf_dir) -> DataFrame:
    """Positions tied in pairs, each pair listing its even position first; bias, PSSM, log-odds and omitted letters for every position."""
    p, pos = fx.logits(spark, sf_dir), F.col("pos")
    omitted = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.when(i == pos % 21, 1.0).otherwise(0.0))
    return p.select(
        "name", "pos", F.ceil(pos / 2).alias("group_id"), (pos % 2).alias("member"), "logits", F.when(pos % 2 == 0, -0.5).otherwise(1.0).alias("beta"), (pos * 7 % 21).alias("native_idx"), (pos % 9 != 0).cast("int").alias("design"),
        F.when(pos % 4 == 1, _one(9, 2.0)).otherwise(_one(9, 0.0)).alias("bias"), F.lit(0.5).alias("coef"), _one(3, 1.0).alias("pssm_bias"), F.col("logits").alias("log_odds"), omitted.alias("omit_mask"),
    )


@query("tied_logits", sql(f"WITH {_MEMBERS} SELECT name, group_id, idx, round(v, 4) AS v FROM t", "fx_logp"))
def tied_logits(spark, sf_dir):
    return _long(S.tied_logits(members(spark, sf_dir), 0.5), "logits", keys=("name", "group_id"), digits=4)


_TIED = f"""WITH {_MEMBERS}, z AS (SELECT name, group_id, arg_max(pos, member) AS lp FROM m GROUP BY name, group_id),
w AS (SELECT t.name, t.group_id, t.idx, z.lp, f.l AS lo, t.v + CASE WHEN t.idx = 5 THEN 1.5 / 0.5 ELSE 0 END + CASE WHEN z.lp % 4 = 1 AND t.idx = 9 THEN 2.0 / 0.5 ELSE 0 END - CASE WHEN t.idx = 20 THEN 1e8 ELSE 0 END AS w FROM t JOIN z ON t.name = z.name AND t.group_id = z.group_id JOIN fx_logp f ON f.name = z.name AND f.pos = z.lp AND f.idx = t.idx),
e AS (SELECT *, exp(w - max(w) OVER (PARTITION BY name, group_id)) AS e FROM w),
b AS (SELECT *, (1 - 0.3 * 0.5) * e / sum(e) OVER (PARTITION BY name, group_id) + 0.3 * 0.5 * CASE WHEN idx = 3 THEN 1.0 ELSE 0.0 END AS b FROM e),
o AS (SELECT *, b * CASE WHEN lo > 0 THEN 1.001 ELSE 0.001 END * CASE WHEN idx = lp % 21 THEN 0 ELSE 1 END AS o FROM b),
d AS (SELECT *, sum(o) OVER (PARTITION BY name, group_id ORDER BY idx ROWS UNBOUNDED PRECEDING) / sum(o) OVER (PARTITION BY name, group_id) AS cdf FROM o),
g AS (SELECT name, group_id, least(count(*) FILTER (WHERE round(cdf, 9) < CAST(group_id * 7919 % 10007 AS DOUBLE) / 10007.0), 20) AS idx FROM d GROUP BY name, group_id),
k AS (SELECT name, group_id, arg_min(native_idx, member) FILTER (WHERE design = 0) AS kept FROM m GROUP BY name, group_id),
tied AS (SELECT DISTINCT m.name, m.group_id, m.member, m.pos, coalesce(k.kept, g.idx) AS idx FROM m JOIN g ON m.name = g.name AND m.group_id = g.group_id JOIN k ON m.name = k.name AND m.group_id = k.group_id)"""


def tied(spark, sf_dir) -> DataFrame:
    """X omitted everywhere, G favoured, PSSM blended, low log-odds and each position's omitted letter damped or left out."""
    return S.tied_sample(members(spark, sf_dir), 0.5, lambda g: (g * 7919 % 10007).cast("double") / 10007.0, "X", {"G": 1.5}, 0.3, 0.0)


@query("tied_sample", sql(f"{_TIED} SELECT name, group_id, member, pos, idx FROM tied", "fx_logp"))
def tied_sample(spark, sf_dir):
    return tied(spark, sf_dir)


@query("tied_consistency", sql(f"{_TIED} SELECT name, group_id, count(DISTINCT idx) = 1 AS consistent FROM tied GROUP BY name, group_id", "fx_logp"))
def tied_consistency(spark, sf_dir):
    return S.tied_consistency(tied(spark, sf_dir).withColumnRenamed("idx", "aa"), ["name", "group_id"])


@query("nll_score", sql(f"WITH {_POS} SELECT name, round(sum(-lp * mask) / nullif(sum(mask), 0), 4) AS score FROM q GROUP BY name", "fx_soft"))
def nll_score(spark, sf_dir):
    return S.nll_scores(positions(spark, sf_dir), ["name"]).withColumn("score", F.round("score", 4))


@query("nll_pooled", sql(f"WITH {_POS} SELECT name, round(sum(-lp * mask) / nullif(sum(mask), 0), 4) AS loss FROM q GROUP BY GROUPING SETS ((name), ())", "fx_soft"))
def nll_pooled(spark, sf_dir):
    return S.nll_pooled(positions(spark, sf_dir)).withColumn("loss", F.round("loss", 4))


@query("nll_smoothed", sql(f"WITH {_POS} SELECT name, round(sum(-(lp + 0.1 / 21 * all_lp) / 1.1 * mask) / nullif(sum(mask), 0), 4) AS loss FROM q GROUP BY name", "fx_soft"))
def nll_smoothed(spark, sf_dir):
    return S.nll_smoothed(positions(spark, sf_dir), ["name"]).withColumn("loss", F.round("loss", 4))


@query("score_stats", sql("SELECT pose, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std, count(*) AS n FROM fx_results GROUP BY pose", "fx_results"))
def score_stats(spark, sf_dir):
    s = S.score_stats(fx.results(spark, sf_dir), ["pose"])
    return s.select("pose", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query("score_complex", sql(
    f"WITH {_POS} SELECT mode, round(avg(score), 4) AS score FROM (SELECT 'designed' AS mode, name, "
    f"sum(-lp * mask * (pos % 2)) / nullif(sum(mask * (pos % 2)), 0) AS score FROM q GROUP BY name UNION ALL "
    f"SELECT 'whole', name, sum(-lp * mask) / nullif(sum(mask), 0) FROM q GROUP BY name) GROUP BY mode", "fx_soft"))
def score_complex(spark, sf_dir):
    """Mean native score over complexes, by mode; odd positions are designed."""
    p = positions(spark, sf_dir).withColumn("chain_m", (F.col("pos") % 2).cast("int")).withColumn("chain_m_pos", F.lit(1))
    one = lambda mode: S.nll_scores(C.design_mask(p, mode).withColumn("mask", F.col("design")), ["name"]).agg(F.round(F.avg("score"), 4).alias("score")).select(F.lit(mode).alias("mode"), "score")
    return one("designed").unionByName(one("whole"))


_MEAN = f"SELECT pos % 10 AS pos, substr('{MODEL_ORDER}', CAST(idx + 1 AS INT), 1) AS aa, avg(p) AS p FROM fx_soft WHERE idx < 20 GROUP BY 1, 2"


def _means(spark, sf_dir) -> DataFrame:
    """Ten positions; structures and blocks of ten count as samples."""
    return S.mean_probs(_soft(spark, sf_dir).withColumn("pos", F.col("pos") % 10), ["pos"])


@query("mean_probs", sql(f"SELECT pos, aa, round(p, 6) AS p FROM ({_MEAN})", "fx_soft"))
def mean_probs(spark, sf_dir):
    return _means(spark, sf_dir).withColumn("p", F.round("p", 6))


@query("probs_matrix", sql(f"SELECT aa, {', '.join(f'round(max(p) FILTER (WHERE pos = {i}), 6) AS p{i}' for i in range(10))} FROM ({_MEAN}) GROUP BY aa", "fx_soft"))
def probs_matrix(spark, sf_dir):
    wide = S.probs_matrix(_means(spark, sf_dir), list(range(10)))
    return wide.select("aa", *[F.round(f"p{i}", 6).alias(f"p{i}") for i in range(10)])


@query("run_summary", sql("SELECT pose AS name, count(*) AS n_samples, max(length(sequence)) AS longest, 6 AS asked FROM fx_results GROUP BY pose", "fx_results"))
def run_summary(spark, sf_dir):
    return S.run_summary(fx.results(spark, sf_dir).drop("name").withColumnRenamed("pose", "name"), 2, 3)


@query("best_per_pose", sql(
    "SELECT pose, sequence, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY pose ORDER BY score, sequence) AS rank "
    "FROM fx_results) WHERE rank <= 5", "fx_results"))
def best_per_pose(spark, sf_dir):
    return S.best_per_pose(fx.results(spark, sf_dir), 5).select("pose", "sequence", "score", "rank")


@query("rank_results", sql("SELECT pose, sequence, score FROM fx_results ORDER BY score, pose, sequence", "fx_results"))
def rank_results(spark, sf_dir):
    return S.rank_results(fx.results(spark, sf_dir)).select("pose", "sequence", "score")


@query("global_rank", sql("SELECT pose, sequence, score, row_number() OVER (ORDER BY score, pose, sequence) AS rank FROM fx_results", "fx_results"))
def global_rank(spark, sf_dir):
    return S.global_rank(fx.results(spark, sf_dir)).select("pose", "sequence", "score", "rank")


@query("append_results", sql("SELECT pose, count(*) AS n FROM (SELECT pose FROM fx_results UNION ALL SELECT 'new' FROM part) GROUP BY pose", "fx_results"))
def append_results(spark, sf_dir):
    new = (
        spark.read
        .parquet(f"{sf_dir}/part.parquet")
        .select(
            F.lit("new").alias("pose"),
            F.col("p_partkey").cast("string").alias("sequence"),
            F.lit(0.5).alias("score"),
            F.col("p_partkey").alias("sample_id"),
        )
    )
    return fx.results(spark, sf_dir).drop("name").unionByName(new).groupBy("pose").agg(F.count("*").alias("n"))


@query("shuffle_batches", sql(
    "WITH c AS (SELECT name, sum(len) AS length FROM chains GROUP BY name), b AS (SELECT name, length, CAST(ceil(log2(greatest(length, "
    "1))) AS INT) AS bucket FROM c) SELECT DISTINCT bucket, CAST(floor((row_number() OVER (PARTITION BY bucket "
    "ORDER BY length, name) - 1) / greatest(floor(1000 / power(2, bucket)), 1)) AS BIGINT) AS batch FROM b", "chains"))
def shuffle_batches(spark, sf_dir):
    """Batches in the order of a seeded hash."""
    b = S.length_batches(R.complexes(plans.chains(spark, sf_dir)).select("name", "length"), 1000).select("bucket", "batch").distinct()
    return b.orderBy(F.xxhash64("bucket", "batch", F.lit(7)), "bucket", "batch")


@query("sort_chains", sql("SELECT name, string_agg(seq, '/' ORDER BY chain) AS sequence FROM chains GROUP BY name", "chains"))
def sort_chains(spark, sf_dir):
    return S.sort_chains(plans.chains(spark, sf_dir), ["name"])


@query("chain_string_split", sql("SELECT name, row_number() OVER (PARTITION BY name ORDER BY chain) AS chain_no, seq AS chain_seq, len AS chain_len FROM chains", "chains"))
def chain_string_split(spark, sf_dir):
    return S.split_chains(S.sort_chains(plans.chains(spark, sf_dir), ["name"]))


@query("format_scores", sql("SELECT sample_id, printf('%.4f', CAST(CAST(score AS FLOAT) AS DOUBLE)) AS text FROM fx_results", "fx_results"))
def format_scores(spark, sf_dir):
    from ..sources.records import fixed4

    return fx.results(spark, sf_dir).select("sample_id", fixed4(F.col("score")).alias("text"))


def letter_scorer():
    """A deterministic scorer: logits follow the distance of letters in the model's order."""
    import pandas as pd

    # Lists of floats, not arrays: Spark makes a list of each row's value.
    logits = {c: [-abs(j - i) / 2.0 for j in range(21)] for i, c in enumerate(MODEL_ORDER)}

    def score(pdf):
        return pd.DataFrame({"name": pdf["name"], "global_pos": pdf["global_pos"], "logits": [logits.get(c, logits["X"]) for c in pdf["aa"]]})

    return score


_LETTER_IDX = f"coalesce(nullif(instr('{MODEL_ORDER}', aa), 0) - 1, 20)"


@query("score_with_model", sql(
    f"WITH {plans._INDEX} SELECT name, global_pos, 21 AS n, round(sum(-abs(i - {_LETTER_IDX}) / 2.0), 4) AS total, "
    f"any_value({_LETTER_IDX}) AS best FROM idx CROSS JOIN (SELECT unnest(range(0, 21)) AS i) GROUP BY name, global_pos", "residues", "offsets"))
def score_with_model(spark, sf_dir):
    features = plans.indexed(spark, sf_dir).select("name", "global_pos", "aa", "mask")
    scored = S.score_with_model(features, "name string, global_pos long, logits array<double>", letter_scorer)
    best = F.array_position("logits", F.array_max("logits")) - 1
    total = reduce(lambda s, i: s + F.get("logits", F.lit(i)), range(21), F.lit(0.0))
    return scored.select(
        "name",
        "global_pos",
        F.size("logits").alias("n"),
        F.round(total, 4).alias("total"),
        best.alias("best"),
    )


_CAMPAIGN = f"""WITH dpos AS (SELECT r.name, r.pos, r.mask * CASE WHEN f.pos IS NULL THEN 1 ELSE 0 END AS design, {_LETTER_IDX} AS native_idx FROM residues r LEFT JOIN (SELECT DISTINCT * FROM fx_fixed) f ON r.name = f.name AND r.chain = f.chain AND r.pos = f.pos WHERE r.chain = 'B'),
lg AS (SELECT d.*, i AS idx, -abs(i - native_idx) / 2.0 + ((d.pos * 31 + i * 17) % 7) / 3.5 AS l FROM dpos d CROSS JOIN (SELECT unnest(range(0, 21)) AS i)),
lm AS (SELECT *, max(l) OVER (PARTITION BY name, pos) AS m FROM lg),
lp AS (SELECT name, pos, idx, l - m - ln(sum(exp(l - m)) OVER (PARTITION BY name, pos)) AS lp FROM lm),
g AS (SELECT lg.*, pose, t_no, temperature, sample_id, l / temperature AS w FROM lg CROSS JOIN (SELECT unnest(range(1, 3)) AS pose) CROSS JOIN (VALUES (0, 0.5), (1, 1.0)) AS t(t_no, temperature) CROSS JOIN (SELECT unnest(range(0, 2)) AS sample_id)),
e AS (SELECT *, exp(w - max(w) OVER (PARTITION BY name, pos, pose, t_no, sample_id)) AS e FROM g),
c AS (SELECT *, sum(e) OVER (PARTITION BY name, pos, pose, t_no, sample_id ORDER BY idx ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY name, pos, pose, t_no, sample_id) AS cdf FROM e),
drawn AS (SELECT name, pos, pose, temperature, sample_id, design, native_idx, CASE WHEN design = 0 THEN native_idx ELSE least(count(*) FILTER (WHERE round(cdf, 9) < CAST((pos * 7919 + pose * 31337 + t_no * 611953 + sample_id * 104729) % 10007 AS DOUBLE) / 10007.0), 20) END AS idx FROM c GROUP BY name, pos, pose, t_no, temperature, sample_id, design, native_idx),
s AS (SELECT d.name, pose, temperature, sample_id, string_agg(substr('{MODEL_ORDER}', CAST(d.idx + 1 AS INT), 1), '' ORDER BY d.pos) AS sequence, sum(-p.lp * design) / nullif(sum(design), 0) AS score, CAST(sum(CASE WHEN d.idx = native_idx THEN design ELSE 0 END) AS DOUBLE) / nullif(sum(design), 0) AS recovery FROM drawn d JOIN lp p ON d.name = p.name AND d.pos = p.pos AND d.idx = p.idx GROUP BY 1, 2, 3, 4),
{plans._RUNS}, stops AS (SELECT r.name, min(line_no) AS stop FROM runs r JOIN (SELECT name, any_value(length(sequence)) AS n FROM s GROUP BY name) AS q ON r.name = q.name AND r.chain = 'B' AND r.run_id = q.n + 1 GROUP BY r.name),
k AS (SELECT a.name, count(*) AS n_atoms, round(sum(-a.x), 3) AS sum_x FROM fx_atoms a LEFT JOIN runs r ON a.name = r.name AND a.chain = r.chain AND a.line_no = r.line_no LEFT JOIN stops t ON a.name = t.name WHERE a.record = 'ATOM' AND (t.stop IS NULL OR a.line_no < t.stop) AND (a.chain <> 'B' OR r.run_id IS NOT NULL) GROUP BY a.name)
SELECT s.name, pose, temperature, sample_id, sequence, round(score, 4) AS score, round(recovery, 4) AS recovery, row_number() OVER (PARTITION BY s.name, pose ORDER BY round(score, 9) NULLS FIRST, sequence, temperature, sample_id) AS rank,
'Binders/' || s.name || '/Pose' || pose || '_' || sequence || '.pdb' AS filename, coalesce(n_atoms, 0) AS n_atoms, coalesce(sum_x, 0) AS sum_x FROM s LEFT JOIN k ON s.name = k.name"""


@query("design_campaign", sql(_CAMPAIGN, "residues", "fx_fixed", "fx_atoms"))
def design_campaign(spark, sf_dir):
    """Chain B of every structure: mirrored, fixed positions, two poses, two temperatures, two samples; scored, ranked, written as the sorted CSV and read
    again, with the atoms of each pose's best design threaded on the mirrored structure."""
    atoms = plans.read_atoms(spark, sf_dir)
    own = F.col("native_idx")
    logits = lambda p: p.withColumn("logits", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: -F.abs(i - own) / 2.0 + ((F.col("pos") * 31 + i * 17) % 7) / 3.5))
    requests = R.distinct_chains(atoms).filter("chain = 'B'")
    places = campaign.design_positions(atoms, requests, fx.fixed(spark, sf_dir), logits)
    u = lambda pos, pose, t, s: ((pos * 7919 + pose * 31337 + t * 611953 + s * 104729) % 10007).cast("double") / 10007.0
    designs = cut(campaign.campaign(places, 2, [0.5, 1.0], 2, u), "designs")
    path = new_path(spark, "campaign")
    found = campaign.results(designs)
    found.write.option("header", True).csv(path)
    best = (
        campaign.threaded(R.mirror(fx.atoms(spark, sf_dir)), designs)
        .groupBy("name", "pose")
        .agg(F.count("*").alias("n_atoms"), F.round(F.sum("x"), 3).alias("sum_x"))
    )
    back = spark.read.schema(found.schema).option("header", True).csv(path).join(best, ["name", "pose"], "left")
    return back.select(
        "name",
        "pose",
        "temperature",
        "sample_id",
        "sequence",
        F.round("score", 4).alias("score"),
        F.round("recovery", 4).alias("recovery"),
        "rank",
        "filename",
        F.coalesce("n_atoms", F.lit(0)).alias("n_atoms"),
        F.coalesce("sum_x", F.lit(0.0)).alias("sum_x"),
    )


@query("leaderboard_stream", sql("SELECT pose, round(min(score), 4) AS best, count(*) AS n FROM fx_results GROUP BY pose", "fx_results"))
def leaderboard_stream(spark, sf_dir):
    return _board(spark, sf_dir).select("pose", F.round("best", 4).alias("best"), "n")


@query("leaderboard_top", sql("SELECT pose, row_number() OVER (PARTITION BY pose ORDER BY score, sequence) AS rank, round(score, 4) AS score, sequence FROM fx_results QUALIFY rank <= 5", "fx_results"))
def leaderboard_top(spark, sf_dir):
    """The five best of each pose, as the stream's state holds them."""
    each = _board(spark, sf_dir).select("pose", F.posexplode("top").alias("i", "t"))
    return each.select("pose", (F.col("i") + 1).alias("rank"), F.round("t.score", 4).alias("score"), F.col("t.sequence").alias("sequence"))


def _board(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "arriving")
    fx.results(spark, sf_dir).repartition(4, "pose").write.parquet(path)
    return leaderboard.run(spark, path, "pose string, sequence string, score double, sample_id long", new_path(spark, "stream"))
