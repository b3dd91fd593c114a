"""Queries on design constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import MODEL_ORDER
from ..operators import constraints as C
from ..operators import residues as R
from . import fixtures as fx
from . import residue_plans as plans
from .fixtures import sql
from .registry import query

_PARSE = "ARNDCQEGHILKMFPSTWYV"
_N = "SELECT unnest(range(0, 21)) AS i"
#: Letter i (from 0) of the model's order.
_AA = f"substr('{MODEL_ORDER}', CAST(i + 1 AS INT), 1)"


@query("apply_fixed_positions", sql(
    "SELECT r.name, r.chain, r.pos, CASE WHEN f.pos IS NOT NULL AND r.chain IN ('B', 'D') THEN 0 ELSE 1 END AS chain_m_pos FROM residues r "
    "LEFT JOIN (SELECT DISTINCT * FROM fx_fixed) f ON r.name = f.name AND r.chain = f.chain AND r.pos = f.pos", "residues", "fx_fixed"))
def apply_fixed_positions(spark, sf_dir):
    return C.apply_fixed(
        plans.residues(spark, sf_dir),
        fx.fixed(spark, sf_dir),
        plans.roles(spark, sf_dir),
    ).select("name", "chain", "pos", "chain_m_pos")


def _omit(spark, sf_dir) -> DataFrame:
    """At fixed positions, letters C and W are omitted."""
    return fx.fixed(spark, sf_dir).select("name", "chain", "pos", F.explode(F.split(F.lit("CW"), "")).alias("aa")).filter("aa <> ''")


@query("apply_omit", sql(
    f"SELECT r.name, r.chain, r.pos, string_agg(CASE WHEN f.pos IS NOT NULL AND {_AA} IN ('C', 'W') THEN '1' ELSE '0' END, '' "
    f"ORDER BY i) AS omit FROM residues r LEFT JOIN (SELECT DISTINCT * FROM fx_fixed) f ON r.name = f.name AND r.chain = f.chain "
    f"AND r.pos = f.pos CROSS JOIN ({_N}) AS n GROUP BY 1, 2, 3", "residues", "fx_fixed"))
def apply_omit(spark, sf_dir):
    done = C.apply_omit(plans.residues(spark, sf_dir), _omit(spark, sf_dir))
    digits = [F.when(F.get("omit_mask", F.lit(i)) == 1, "1").otherwise("0") for i in range(21)]
    return done.select("name", "chain", "pos", F.concat(*digits).alias("omit"))


@query("apply_pssm", sql(
    "SELECT r.name, r.chain, r.pos, CASE WHEN f.pos IS NULL THEN 0.0 ELSE 1.0 END AS coef, CASE "
    "WHEN f.pos IS NULL THEN 0.0 ELSE 5.0 END AS bias_sum, CASE WHEN f.pos IS NULL THEN 10000.0 ELSE 2.0 END AS log_odds_a FROM residues r "
    "LEFT JOIN (SELECT DISTINCT * FROM fx_fixed) f ON r.name = f.name AND r.chain = f.chain AND r.pos = f.pos", "residues", "fx_fixed"))
def apply_pssm(spark, sf_dir):
    """A PSSM row at each fixed position: coefficient 1, bias 5 at A, log-odds 2."""
    pssm = (
        fx.fixed(spark, sf_dir)
        .distinct()
        .select(
            "name",
            "chain",
            "pos",
            F.lit(1.0).alias("coef"),
            F.concat(F.array(F.lit(5.0)), F.array_repeat(F.lit(0.0), 20)).alias("bias"),
            F.array_repeat(F.lit(2.0), 21).alias("log_odds"),
        )
    )
    done = C.apply_pssm(plans.residues(spark, sf_dir), pssm)
    return done.select(
        "name",
        "chain",
        "pos",
        "coef",
        F.aggregate("bias", F.lit(0.0), lambda s, v: s + v).alias("bias_sum"),
        F.col("log_odds")[0].alias("log_odds_a"),
    )


@query("apply_bias", sql(
    f"SELECT r.name, r.chain, r.pos, {_AA} AS aa, (CASE WHEN f.pos IS NOT NULL AND {_AA} = 'L' THEN 1.5 ELSE 0.0 END) + (CASE "
    f"WHEN {_AA} = 'G' THEN 40.1 ELSE 0.0 END) AS bias FROM residues r LEFT JOIN (SELECT DISTINCT * FROM fx_fixed) f ON r.name = f.name "
    f"AND r.chain = f.chain AND r.pos = f.pos CROSS JOIN ({_N}) AS n", "residues", "fx_fixed"))
def apply_bias(spark, sf_dir):
    per_pos = fx.fixed(spark, sf_dir).distinct().select("name", "chain", "pos", F.lit("L").alias("aa"), F.lit(1.5).alias("bias"))
    done = C.apply_bias(plans.residues(spark, sf_dir), per_pos, {"G": 40.1})
    return done.select("name", "chain", "pos", F.posexplode("bias").alias("i", "bias")).select(
        "name",
        "chain",
        "pos",
        F.substr(F.lit(MODEL_ORDER), F.col("i") + 1, F.lit(1)).alias("aa"),
        "bias",
    )


@query("expand_tied_groups", sql(
    "SELECT f.name, f.pos AS group_id, 0 AS member, f.chain, f.pos, CASE WHEN f.pos = 1 THEN -1.0 ELSE 1.0 END AS beta, "
    "CAST(o.start + f.pos - 1 AS BIGINT) AS global_pos FROM fx_fixed f JOIN offsets o ON f.name = o.name AND f.chain = o.chain", "fx_fixed", "offsets"))
def expand_tied_groups(spark, sf_dir):
    """Both JSON forms, as read: with betas where the position is 1, without elsewhere."""
    from ..sources.records import parse_tied

    fixed = fx.fixed(spark, sf_dir)
    p = F.col("pos").cast("string")
    member = F.concat(
        F.lit('{"'),
        "chain",
        F.when(F.col("pos") == 1, F.concat(F.lit('": [['), p, F.lit("], [-1.0]]}"))).otherwise(F.concat(F.lit('": ['), p, F.lit("]}"))),
    )
    lines = fixed.select(F.concat(F.lit('{"'), "name", F.lit('": ['), member, F.lit("]}")).alias("line"))
    tied = parse_tied(lines).withColumn("group_id", F.col("pos"))
    return C.expand_tied(tied, R.chain_offsets(plans.chains(spark, sf_dir)))


@query("fixed_chains", sql(
    "SELECT c.name, c.chain, CASE WHEN d.name IS NOT NULL OR l.name IS NULL THEN 'designed' ELSE 'fixed' END AS role "
    "FROM (SELECT DISTINCT name, chain FROM fx_atoms) c LEFT JOIN (SELECT DISTINCT name, chain FROM fx_fixed) d ON c.name = d.name "
    "AND c.chain = d.chain LEFT JOIN (SELECT DISTINCT name FROM fx_fixed) l ON c.name = l.name", "fx_atoms", "fx_fixed"))
def fixed_chains(spark, sf_dir):
    return C.fixed_chains(R.distinct_chains(fx.atoms(spark, sf_dir)), fx.fixed(spark, sf_dir).select("name", "chain").distinct())


@query("parse_chain_lists", (
    "SELECT p_partkey AS task, substr('ABCDEFG', CAST(p_size % 7 AS INT) + 1, 1) || '/Z' AS chains, concat(p_size % 5, '+', "
    "p_size % 3) AS first_positions, 2 AS n_lists FROM part"
))
def parse_chain_lists(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    a, b = (F.col("p_size") % 5).cast("string"), (F.col("p_size") % 3).cast("string")
    tasks = part.select(
        F.col("p_partkey").alias("task"),
        F.concat(F.substr(F.lit("ABCDEFG"), (F.col("p_size") % 7 + 1).cast("int"), F.lit(1)), F.lit(", Z")).alias("chain_text"),
        F.concat(a, F.lit(" "), b, F.lit(", 7 8")).alias("position_text"),
    )
    done = C.parse_requests(tasks)
    return done.select(
        "task",
        F.array_join("chains", "/").alias("chains"),
        F.array_join(F.col("positions")[0].cast("array<string>"), "+").alias("first_positions"),
        F.size("positions").alias("n_lists"),
    )


@query("permute_pssm", sql(
    f"SELECT name, pos, i, CASE WHEN i = 20 THEN 0.0 ELSE round(logits[CAST(instr('{_PARSE}', {_AA}) AS INT)], 4) END AS v FROM fx_logits CROSS "
    f"JOIN ({_N}) AS n", "fx_logits"))
def permute_pssm(spark, sf_dir):
    moved = fx.logits(spark, sf_dir).select("name", "pos", F.posexplode(C.permute_pssm(F.col("logits"))).alias("i", "v"))
    return moved.withColumn("v", F.round("v", 4))


@query("build_pssm", sql(
    f"WITH m AS (SELECT name, pos, i, CASE WHEN i = 20 THEN 0.0 ELSE logits[CAST(instr('{_PARSE}', {_AA}) AS INT)] END AS v FROM fx_logits "
    f"CROSS JOIN ({_N}) AS n), s AS (SELECT *, CASE WHEN i = 20 THEN v - 1e8 ELSE v END AS w "
    f"FROM m), e AS (SELECT *, exp(w - max(w) OVER p) AS e FROM s WINDOW p AS (PARTITION BY name, pos)) "
    f"SELECT name, c.chain, pos, i, round(e / sum(e) OVER (PARTITION BY name, pos, c.chain), 6) AS bias FROM e CROSS "
    f"JOIN (SELECT unnest(['A', 'B']) AS chain) AS c", "fx_logits"))
def build_pssm(spark, sf_dir):
    """Copied to two chains."""
    rows = fx.logits(spark, sf_dir).select(
        "name",
        F.explode(F.array(F.lit("A"), F.lit("B"))).alias("chain"),
        "pos",
        F.slice("logits", 1, 20).alias("log_odds"),
    )
    return C.build_pssm(rows).select("name", "chain", "pos", F.posexplode("bias").alias("i", "bias")).withColumn("bias", F.round("bias", 6))


@query("broadcast_global_assignment", sql(
    "SELECT c.name, c.chain, t.pos FROM (SELECT DISTINCT name, chain FROM fx_atoms) c "
    "JOIN (VALUES ('A', 1), ('A', 2), ('C', 5)) AS t(chain, pos) ON c.chain = t.chain", "fx_atoms"))
def broadcast_global_assignment(spark, sf_dir):
    return C.fixed_from_assignment(R.distinct_chains(fx.atoms(spark, sf_dir)), ["A", "C"], [[1, 2], [5]])


@query("broadcast_global_chains", sql(
    "SELECT name, chain, CASE WHEN chain IN ('A', 'C') THEN 'designed' ELSE 'fixed' END AS role FROM (SELECT DISTINCT name, chain FROM fx_atoms)", "fx_atoms"))
def broadcast_global_chains(spark, sf_dir):
    """One list of designed chains for every structure."""
    chains = R.distinct_chains(fx.atoms(spark, sf_dir))
    listed = C.broadcast_assignment(chains.select("name").distinct(), [{"chain": "A"}, {"chain": "C"}])
    return C.fixed_chains(chains, listed)


@query("broadcast_global_bias", sql(
    "SELECT name, aa, bias FROM (SELECT DISTINCT name FROM fx_atoms) CROSS JOIN (VALUES ('D', 1.39), ('E', 1.39), ('H', -0.5)) AS t(aa, bias)", "fx_atoms"))
def broadcast_global_bias(spark, sf_dir):
    """One bias of letters for every structure."""
    names = fx.atoms(spark, sf_dir).select("name").distinct()
    return C.broadcast_assignment(names, [{"aa": "D", "bias": 1.39}, {"aa": "E", "bias": 1.39}, {"aa": "H", "bias": -0.5}])


_FIRST = "f AS (SELECT name, arg_min(len, chain) AS n FROM chains GROUP BY name), g AS (SELECT name, unnest(range(1, n + 1)) AS group_id FROM f)"


@query("build_tied_homooligomer", sql(f"WITH {_FIRST} SELECT g.name, group_id, chain, group_id AS pos, 1.0 AS beta FROM g JOIN chains c ON g.name = c.name", "chains"))
def build_tied_homooligomer(spark, sf_dir):
    return C.tied_homooligomer(plans.chains(spark, sf_dir))


@query("build_tied_lists", sql(
    "SELECT name, group_id, chain, pos, 1.0 AS beta FROM (SELECT DISTINCT name FROM fx_atoms) CROSS "
    "JOIN (VALUES (1, 'A', 1), (2, 'A', 2), (1, 'C', 3), (2, 'C', 4)) AS t(group_id, chain, pos)", "fx_atoms"))
def build_tied_lists(spark, sf_dir):
    return C.tied_lists(R.distinct_chains(fx.atoms(spark, sf_dir)), ["A", "C"], [[1, 2], [3, 4]])


@query("build_tied_weighted", sql(
    "WITH k AS (SELECT * FROM chains WHERE chain IN ('A', 'B')), f AS (SELECT name, arg_min(len, chain) AS n FROM k "
    "GROUP BY name), g AS (SELECT name, unnest(range(1, n + 1)) AS group_id FROM f) SELECT g.name, group_id, chain, group_id AS pos, CASE "
    "WHEN chain = 'A' THEN 1.0 ELSE -0.5 END AS beta FROM g JOIN k ON g.name = k.name", "chains"))
def build_tied_weighted(spark, sf_dir):
    return C.tied_weighted(plans.chains(spark, sf_dir), {"A": 1.0, "B": -0.5})


@query("build_position_bias", sql(
    "SELECT name, chain, pos, CASE WHEN chain = 'A' AND pos = 1 THEN 2.5 WHEN chain = 'A' AND pos = 2 THEN -1.0 ELSE 0.0 END AS bias_g "
    "FROM residues", "residues"))
def build_position_bias(spark, sf_dir):
    rules = spark.createDataFrame(
        [("A", 1, "G", 2.0), ("A", 1, "G", 0.5), ("A", 2, "G", -1.0), ("A", 2, "W", 3.0)],
        "chain string, pos int, aa string, bias double",
    )
    return C.position_bias(plans.residues(spark, sf_dir), rules).select("name", "chain", "pos", F.col("bias")[MODEL_ORDER.index("G")].alias("bias_g"))


@query("build_omit_rules", sql(
    "SELECT c.name, c.chain, count(f.pos) AS n_rules, coalesce(string_agg(CAST(f.pos AS VARCHAR), '/' ORDER BY f.pos), '') AS positions "
    "FROM (SELECT DISTINCT name, chain FROM fx_atoms) c LEFT JOIN fx_fixed f ON c.name = f.name AND c.chain = f.chain GROUP BY 1, 2", "fx_atoms", "fx_fixed"))
def build_omit_rules(spark, sf_dir):
    rules = fx.fixed(spark, sf_dir).select("name", "chain", F.array("pos").alias("positions"), F.lit("CW").alias("letters"))
    done = C.omit_rules(R.distinct_chains(fx.atoms(spark, sf_dir)), rules)
    return done.select(
        "name",
        "chain",
        F.size("rules").alias("n_rules"),
        F.array_join(F.transform("rules", lambda r: r["positions"][0].cast("string")), "/").alias("positions"),
    )


@query("design_mask", sql(
    "SELECT r.name, r.chain, r.pos, r.mask * (CASE WHEN r.chain IN ('B', 'D') THEN 1 ELSE 0 END) * (CASE WHEN f.pos IS NOT NULL "
    "AND r.chain IN ('B', 'D') THEN 0 ELSE 1 END) AS design FROM residues r LEFT JOIN (SELECT DISTINCT * FROM fx_fixed) f ON r.name = f.name "
    "AND r.chain = f.chain AND r.pos = f.pos", "residues", "fx_fixed"))
def design_mask(spark, sf_dir):
    done = C.apply_fixed(
        plans.residues(spark, sf_dir),
        fx.fixed(spark, sf_dir),
        plans.roles(spark, sf_dir),
    ).withColumn("chain_m", F.col("chain").isin("B", "D").cast("int"))
    return C.design_mask(done, "designed").select("name", "chain", "pos", "design")


@query("union_chain_sets", sql(
    "SELECT name, string_agg(DISTINCT chain, '' ORDER BY chain) AS chains FROM (SELECT name, chain FROM fx_fixed UNION SELECT name, chain "
    "FROM fx_atoms WHERE chain < 'C') GROUP BY name", "fx_fixed", "fx_atoms"))
def union_chain_sets(spark, sf_dir):
    sets = lambda t, c: t.groupBy("name").agg(F.collect_set("chain").alias(c))
    both = sets(fx.fixed(spark, sf_dir), "a").join(sets(fx.atoms(spark, sf_dir).filter("chain < 'C'"), "b"), "name", "full")
    none = F.array().cast("array<string>")
    return both.select("name", F.array_join(C.union_chain_sets(F.coalesce("a", none), F.coalesce("b", none)), "").alias("chains"))
