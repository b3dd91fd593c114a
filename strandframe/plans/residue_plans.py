"""Queries on residues, chains and complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import MODEL_ORDER, gap_to_unknown, to_index, to_letter
from ..operators import constraints as C
from ..operators import residues as R
from ..operators import scoring
from . import fixtures as fx
from .fixtures import sql
from .registry import query

_FLAT_SQL = ", ".join(f"round({a}_{c}, 3) AS {a}_{c}" for a in ("n", "ca", "c", "o") for c in "xyz")


def _flat() -> list:
    return [F.round(F.col(a)[i], 3).alias(f"{a}_{c}") for a in ("n", "ca", "c", "o") for i, c in enumerate("xyz")]


def read_atoms(spark, sf_dir) -> DataFrame:
    """ATOM rows, selenomethionine made MET (from files, that is parse_atoms after normalize_mse; see files.py)."""
    atoms = fx.atoms(spark, sf_dir).filter("record = 'ATOM' OR res3 = 'MSE'")
    return atoms.withColumn("record", F.lit("ATOM")).withColumn("res3", F.when(F.col("res3") == "MSE", "MET").otherwise(F.col("res3")))


def residues(spark, sf_dir) -> DataFrame:
    return R.residue_table(read_atoms(spark, sf_dir), fx.named(spark, sf_dir))


def chains(spark, sf_dir) -> DataFrame:
    return R.chain_table(read_atoms(spark, sf_dir))


def indexed(spark, sf_dir) -> DataFrame:
    return R.with_index(residues(spark, sf_dir))


@query("mirror", sql("SELECT name, line_no, round(-x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM fx_atoms", "fx_atoms"))
def mirror(spark, sf_dir):
    return R.mirror(fx.atoms(spark, sf_dir)).select("name", "line_no", *[F.round(c, 3).alias(c) for c in "xyz"])


@query("residues_from_atoms", sql(f"SELECT name, chain, resseq, icode, res3, {_FLAT_SQL} FROM res", "res"))
def residues_from_atoms(spark, sf_dir):
    return R.residues_from_atoms(read_atoms(spark, sf_dir)).select(*R.KEY, "res3", *_flat())


@query("fill_residue_gaps", sql("SELECT name, chain, resseq, icode, aa FROM residues", "residues"))
def fill_residue_gaps(spark, sf_dir):
    return R.fill_gaps(R.residues_from_atoms(read_atoms(spark, sf_dir)).select(*R.KEY, "aa"))


@query("residue_ordinal", sql("SELECT name, chain, resseq, icode, pos FROM residues", "residues"))
def residue_ordinal(spark, sf_dir):
    return residues(spark, sf_dir).select(*R.KEY, "pos")


@query("coord_mask", sql("SELECT name, chain, pos, mask, round(CASE WHEN mask = 1 THEN ca_x ELSE coalesce(ca_x, 0) END, 3) AS ca_x FROM residues", "residues"))
def coord_mask(spark, sf_dir):
    return residues(spark, sf_dir).select("name", "chain", "pos", "mask", F.round(F.col("ca0")[0], 3).alias("ca_x"))


@query("assemble_chain_sequence", sql("SELECT name, chain, seq, len FROM chains", "chains"))
def assemble_chain_sequence(spark, sf_dir):
    return chains(spark, sf_dir)


@query("assemble_complex", sql("SELECT name, count(*) AS num_of_chains, string_agg(seq, '' ORDER BY " + fx.RANK + ") AS seq, CAST(sum(len) AS BIGINT) AS length FROM chains GROUP BY name", "chains"))
def assemble_complex(spark, sf_dir):
    return R.complexes(chains(spark, sf_dir))


@query("distinct_chains", sql("SELECT DISTINCT name, chain FROM fx_atoms", "fx_atoms"))
def distinct_chains(spark, sf_dir):
    return R.distinct_chains(fx.atoms(spark, sf_dir))


@query("next_free_chain", sql(
    "SELECT name, count(DISTINCT chain) AS n_chains, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(count(DISTINCT chain) + 1 AS INT), "
    "1) AS design_chain FROM fx_atoms GROUP BY name", "fx_atoms"))
def next_free_chain(spark, sf_dir):
    return R.next_free_chain(fx.atoms(spark, sf_dir))


def roles(spark, sf_dir) -> DataFrame:
    """Chains B and D are designed; list positions by letter."""
    all_chains = R.distinct_chains(fx.atoms(spark, sf_dir))
    role = F.when(F.col("chain").isin("B", "D"), "designed").otherwise("fixed")
    return all_chains.select("name", "chain", role.alias("role"), F.ascii("chain").alias("list_pos"))


@query("chain_encoding", sql(
    "SELECT name, chain, role, row_number() OVER (PARTITION BY name ORDER BY role, chain) AS chain_no FROM (SELECT DISTINCT name, chain, CASE "
    "WHEN chain IN ('B', 'D') THEN 'designed' ELSE 'fixed' END AS role FROM fx_atoms)", "fx_atoms"))
def chain_encoding(spark, sf_dir):
    return R.chain_encoding(roles(spark, sf_dir)).select("name", "chain", "role", "chain_no")


@query("chain_offsets", sql("SELECT name, chain, len, chain_no, CAST(start AS BIGINT) AS start FROM offsets", "offsets"))
def chain_offsets(spark, sf_dir):
    return R.chain_offsets(chains(spark, sf_dir)).select("name", "chain", "len", "chain_no", "start")


_INDEX = (
    "idx AS (SELECT r.name, r.chain, r.pos, CAST(o.start + r.pos - 1 AS BIGINT) AS global_pos, "
    "CAST(100 * (o.chain_no - 1) + o.start + r.pos - 1 AS BIGINT) AS residue_idx, r.aa, r.mask, o.chain_no FROM residues r "
    "JOIN offsets o ON r.name = o.name AND r.chain = o.chain)"
)


@query("residue_index", sql(f"WITH {_INDEX} SELECT name, chain, pos, global_pos, residue_idx FROM idx", "residues", "offsets"))
def residue_index(spark, sf_dir):
    table = residues(spark, sf_dir)
    return R.residue_index(table, R.chain_offsets(R.chain_sequences(table))).select("name", "chain", "pos", "global_pos", "residue_idx")


@query(
    "adjacency_masks",
    sql(
        f"WITH {_INDEX} SELECT name, global_pos, CASE WHEN lag(residue_idx) OVER w = residue_idx - 1 THEN 1 ELSE 0 END AS phi, CASE "
        f"WHEN lead(residue_idx) OVER w = residue_idx + 1 THEN 1 ELSE 0 END AS psi, CASE "
        f"WHEN lead(residue_idx) OVER w = residue_idx + 1 THEN 1 ELSE 0 END AS omega FROM idx WINDOW w AS (PARTITION BY name "
        f"ORDER BY global_pos)", "residues", "offsets"),
)
def adjacency_masks(spark, sf_dir):
    return R.adjacency_masks(indexed(spark, sf_dir)).select("name", "global_pos", "phi", "psi", "omega")


_RUNS = (
    "runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY name, chain ORDER BY line_no) AS BIGINT) AS run_id FROM (SELECT *, CASE "
    "WHEN lag(resseq) OVER w = resseq THEN 0 ELSE 1 END AS new FROM fx_atoms WHERE record = 'ATOM' AND atom IN ('N', 'CA', 'C', 'O') "
    "WINDOW w AS (PARTITION BY name, chain ORDER BY line_no)))"
)


@query("residue_run_id", sql(f"WITH {_RUNS} SELECT name, line_no, run_id FROM runs", "fx_atoms"))
def residue_run_id(spark, sf_dir):
    return R.residue_runs(R.backbone(fx.atoms(spark, sf_dir))).select("name", "line_no", "run_id")


_THREAD = f"""WITH {_RUNS}, stops AS (SELECT name, min(line_no) AS stop FROM runs WHERE chain = 'B' AND run_id = 7 GROUP BY name), d AS (SELECT DISTINCT name FROM fx_atoms WHERE chain = 'B')
SELECT a.name, a.chain, a.line_no, CASE WHEN a.chain <> 'B' THEN a.res3 ELSE CASE r.run_id WHEN 1 THEN 'ALA' WHEN 2 THEN 'CYS' WHEN 3 THEN 'ASP' WHEN 4 THEN 'GLU' WHEN 5 THEN 'PHE' ELSE 'GLY' END END AS res3
FROM fx_atoms a JOIN d ON a.name = d.name LEFT JOIN runs r ON a.name = r.name AND a.chain = r.chain AND a.line_no = r.line_no LEFT JOIN stops s ON a.name = s.name
WHERE a.record = 'ATOM' AND (s.stop IS NULL OR a.line_no < s.stop) AND (a.chain <> 'B' OR r.run_id IS NOT NULL)"""


@query("thread_sequence", sql(_THREAD, "fx_atoms"))
def thread_sequence(spark, sf_dir):
    """Six letters on chain B of every structure that has one; a longer chain ends the output there, other chains stay."""
    atoms = fx.atoms(spark, sf_dir)
    designs = R.distinct_chains(atoms).filter("chain = 'B'").withColumn("sequence", F.lit("ACDEFG"))
    return R.thread_sequence(atoms, designs).select("name", "chain", "line_no", "res3")


@query("translate_residues", sql(f"SELECT name, line_no, {fx._letter} AS aa, coalesce(nullif(instr('{MODEL_ORDER}', {fx._letter}), 0) - 1, 20) AS aa_idx FROM fx_atoms", "fx_atoms"))
def translate_residues(spark, sf_dir):
    return fx.atoms(spark, sf_dir).select("name", "line_no", to_letter(F.col("res3")).alias("aa")).withColumn("aa_idx", to_index(F.col("aa")))


_ALPHABET = f"[^{MODEL_ORDER}-]"


@query("filter_alphabet", sql(f"SELECT doc_id, seq FROM fx_seq WHERE NOT regexp_matches(seq, '{_ALPHABET}')", "fx_seq"))
def filter_alphabet(spark, sf_dir):
    return fx.sequences(spark, sf_dir).filter(~F.col("seq").rlike(_ALPHABET))


@query("filter_max_length", sql("SELECT doc_id, length(seq) AS len FROM fx_seq WHERE length(seq) <= 2000", "fx_seq"))
def filter_max_length(spark, sf_dir):
    return fx.sequences(spark, sf_dir).select("doc_id", F.length("seq").alias("len")).filter("len <= 2000")


@query("gap_to_unknown", sql("SELECT doc_id, replace(seq, '-', 'X') AS seq FROM fx_seq", "fx_seq"))
def gap_to_unknown_q(spark, sf_dir):
    return fx.sequences(spark, sf_dir).select("doc_id", gap_to_unknown(F.col("seq")).alias("seq"))


@query("bad_letters", sql(
    f"SELECT doc_id, coalesce((SELECT string_agg(c, '' ORDER BY c) FROM (SELECT DISTINCT unnest(string_split(seq, '')) AS c) "
    f"WHERE instr('{MODEL_ORDER}-', c) = 0), '') AS bad FROM fx_seq", "fx_seq"))
def bad_letters(spark, sf_dir):
    return C.bad_letters(fx.sequences(spark, sf_dir)).select("doc_id", F.array_join("bad", "").alias("bad"))


_REASON = f"CASE WHEN regexp_matches(seq, '{_ALPHABET}') THEN 'bad_chars' WHEN length(seq) > 2000 THEN 'too_long' ELSE 'kept' END"


@query("discard_counts", sql(f"SELECT {_REASON} AS reason, count(*) AS n FROM fx_seq GROUP BY 1", "fx_seq"))
def discard_counts(spark, sf_dir):
    return fx.sequences(spark, sf_dir).groupBy(scoring.discard_reason(F.col("seq"), 2000).alias("reason")).agg(F.count("*").alias("n"))


@query("truncate_dataset", sql(f"SELECT doc_id, length(seq) AS len FROM fx_seq WHERE {_REASON} = 'kept' ORDER BY doc_id LIMIT 100", "fx_seq"))
def truncate_dataset(spark, sf_dir):
    """The first 100 valid entries: the limit is the operator."""
    kept = fx.sequences(spark, sf_dir).filter(scoring.discard_reason(F.col("seq"), 2000) == "kept")
    return kept.orderBy("doc_id").limit(100).select("doc_id", F.length("seq").alias("len"))


@query("length_batches", sql(
    "WITH c AS (SELECT name, sum(len) AS length FROM chains GROUP BY name), b AS (SELECT name, CAST(length AS BIGINT) AS length, "
    "CAST(ceil(log2(greatest(length, 1))) AS INT) AS bucket FROM c) SELECT name, length, bucket, "
    "CAST(floor((row_number() OVER (PARTITION BY bucket ORDER BY length, name) - 1) / greatest(floor(1000 / power(2, bucket)), "
    "1)) AS BIGINT) AS batch FROM b", "chains"))
def length_batches(spark, sf_dir):
    return scoring.length_batches(R.complexes(chains(spark, sf_dir)).select("name", "length"), 1000)


@query("pad_batch", sql(
    f"WITH {_INDEX}, s AS (SELECT name, count(*) AS length, length(name) AS batch FROM idx "
    f"GROUP BY name), g AS (SELECT batch, name, unnest(range(0, longest)) AS global_pos "
    f"FROM (SELECT *, max(length) OVER (PARTITION BY batch) AS longest FROM s)) "
    f"SELECT g.batch, g.name, g.global_pos, coalesce(i.aa, 'X') AS aa, coalesce(i.mask, 0) AS mask FROM g LEFT JOIN idx i ON g.name = i.name "
    f"AND g.global_pos = i.global_pos", "residues", "offsets"))
def pad_batch(spark, sf_dir):
    table = indexed(spark, sf_dir)
    batches = table.groupBy("name").agg(F.count("*").alias("length")).withColumn("batch", F.length("name"))
    return C.pad_batch(table, batches).select("batch", "name", "global_pos", "aa", "mask")


def _numbered(spark, sf_dir) -> DataFrame:
    return indexed(spark, sf_dir).select("name", "chain_no", "pos", "aa", *[F.col("ca0")[i].alias(c) for i, c in enumerate("xyz")])


_LAST = f"WITH {_INDEX}, l AS (SELECT *, max(chain_no) OVER (PARTITION BY name) AS last FROM idx)"


@query("complex_lengths", sql(
    f"{_LAST} SELECT name, count(*) FILTER (WHERE chain_no <> last) AS len_receptor, count(*) FILTER (WHERE chain_no = last) AS len_binder, "
    f"count(*) AS len_complex FROM l GROUP BY name", "residues", "offsets"))
def complex_lengths(spark, sf_dir):
    return R.complex_lengths(_numbered(spark, sf_dir))


@query("receptor_selection", sql(f"{_LAST} SELECT name, chain_no, pos, aa FROM l WHERE chain_no <> last", "residues", "offsets"))
def receptor_selection(spark, sf_dir):
    return R.receptor_selection(_numbered(spark, sf_dir)).select("name", "chain_no", "pos", "aa")


@query("extend_complex", sql(
    f"WITH {_INDEX} SELECT name, chain_no, pos, aa FROM idx UNION ALL SELECT name, m + 1, unnest(range(1, 6)), 'A' "
    f"FROM (SELECT name, max(chain_no) AS m FROM idx GROUP BY name)", "residues", "offsets"))
def extend_complex(spark, sf_dir):
    table = _numbered(spark, sf_dir)
    return R.extend_complex(table, table.select("name").distinct().withColumn("len_binder", F.lit(5))).select("name", "chain_no", "pos", "aa")
