"""Queries on scans and sinks: files are written from the fixtures and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.letters import MODEL_ORDER
from ..operators import residues as R
from ..operators import scoring
from ..operators.ranks import dense_numbered
from ..scratch import new_path
from ..sources import containers, records, structures
from . import fixtures as fx
from .fixtures import sql
from .registry import query


def _lines(spark, sf_dir: str, by: str = "part") -> DataFrame:
    return structures.render_atoms(fx.atoms(spark, sf_dir, by))


@query("scan_structures", sql("SELECT name, count(*) AS n_lines, count(*) FILTER (WHERE record = 'ATOM') AS n_atom_lines FROM fx_file_atoms GROUP BY name", "fx_file_atoms"))
def scan_structures(spark, sf_dir):
    path = new_path(spark, "structures")
    containers.write(_lines(spark, sf_dir, "supplier"), path)
    lines = containers.scan(spark, path).filter("line <> ''")
    return lines.groupBy("name").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line").startswith("ATOM")).alias("n_atom_lines"))


@query("parse_atoms", sql(
    "SELECT name, line_no, atom, res3, chain, resseq, icode, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, element FROM fx_atoms "
    "WHERE record = 'ATOM'", "fx_atoms"))
def parse_atoms(spark, sf_dir):
    return structures.parse_atoms(_lines(spark, sf_dir)).select(
        "name",
        "line_no",
        "atom",
        "res3",
        "chain",
        "resseq",
        "icode",
        *[F.round(c, 3).alias(c) for c in "xyz"],
        "element",
    )


@query("normalize_mse", sql("SELECT name, count(*) AS n_atoms, count(*) FILTER (WHERE res3 = 'MET') AS n_met FROM read_atoms GROUP BY name", "read_atoms"))
def normalize_mse(spark, sf_dir):
    atoms = structures.parse_atoms(structures.normalize_mse(_lines(spark, sf_dir)))
    return atoms.groupBy("name").agg(F.count("*").alias("n_atoms"), F.count_if(F.col("res3") == "MET").alias("n_met"))


@query("chain_subset_scan", sql("SELECT name, chain, count(*) AS n_atoms FROM fx_atoms WHERE record = 'ATOM' AND chain IN ('A', 'C') GROUP BY name, chain", "fx_atoms"))
def chain_subset_scan(spark, sf_dir):
    """The filter on chains is applied by the reader of the containers, before lines become rows."""
    path = new_path(spark, "structures")
    containers.write(_lines(spark, sf_dir), path)
    lines = structures.chain_subset(containers.scan(spark, path), ["A", "C"])
    return structures.parse_atoms(lines).groupBy("name", "chain").agg(F.count("*").alias("n_atoms"))


@query("split_insertion_code", sql("SELECT name, line_no, resseq, icode, resseq + 1 AS number FROM fx_atoms", "fx_atoms"))
def split_insertion_code(spark, sf_dir):
    text = fx.atoms(spark, sf_dir).select("name", "line_no", F.concat((F.col("resseq") + 1).cast("string"), "icode").alias("t"))
    number, icode = structures.split_insertion_code(F.col("t"))
    return text.select("name", "line_no", number.alias("resseq"), icode.alias("icode"), (number + 1).alias("number"))


@query("drop_hydrogens", sql("SELECT name, line_no, trim(element) AS element FROM fx_atoms WHERE NOT (element = 'O' AND line_no % 2 = 0)", "fx_atoms"))
def drop_hydrogens(spark, sf_dir):
    """Every second oxygen is made a hydrogen first."""
    atoms = fx.atoms(spark, sf_dir).withColumn(
        "element",
        F.when((F.col("element") == "O") & (F.col("line_no") % 2 == 0), "H").otherwise(F.col("element")),
    )
    return structures.drop_hydrogens(structures.render_atoms(atoms)).select("name", "line_no", F.trim(F.substring("line", 77, 2)).alias("element"))


@query("select_backbone", sql("SELECT name, line_no FROM fx_atoms WHERE record = 'ATOM' AND (chain <> 'B' OR atom IN ('N', 'CA', 'C', 'O'))", "fx_atoms"))
def select_backbone(spark, sf_dir):
    return structures.select_backbone(_lines(spark, sf_dir), "B").select("name", "line_no")


@query("write_structures", sql(
    "SELECT name, count(*) AS n_atoms, round(sum(x), 4) AS sum_x, round(sum(z), 4) AS sum_z FROM fx_file_atoms WHERE record = 'ATOM' "
    "GROUP BY name", "fx_file_atoms"))
def write_structures(spark, sf_dir):
    path = new_path(spark, "structures")
    containers.write(_lines(spark, sf_dir, "supplier"), path)
    back = structures.parse_atoms(containers.scan(spark, path))
    return back.groupBy("name").agg(F.count("*").alias("n_atoms"), F.round(F.sum("x"), 4).alias("sum_x"), F.round(F.sum("z"), 4).alias("sum_z"))


def _written(spark, lines: DataFrame, name: str, by: str = "name") -> DataFrame:
    """Lines (by, line_no, line) written to containers, a part of them for each value of by, and scanned again."""
    path = new_path(spark, name)
    containers.write(lines.withColumnRenamed(by, "name"), path)
    return containers.scan(spark, path).drop("chain").filter("line <> ''").withColumnRenamed("name", by)


def _complex_lines(spark, sf_dir) -> DataFrame:
    """JSON lines of complexes with coordinates, written and read as text; residues come from parsed lines of structure files."""
    # A line item makes one residue at most, so structures are counted without rendering and parsing their lines.
    table = R.residue_table(structures.parse_atoms(structures.normalize_mse(_lines(spark, sf_dir))), fx.named(spark, sf_dir))
    path = new_path(spark, "complexes")
    records.render_complexes(table).select("line").write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


_WHOLE = f"w AS (SELECT name, count(*) AS num_of_chains, string_agg(seq, '' ORDER BY {fx.RANK}) AS whole FROM chains GROUP BY name)"
_COORDS = f"""WITH {_WHOLE}, a AS (SELECT name, chain, unnest(['N', 'CA', 'C', 'O']) AS atom, unnest([n_x, ca_x, c_x, o_x]) AS x, unnest([n_z, ca_z, c_z, o_z]) AS z FROM residues)
SELECT a.name, w.num_of_chains, w.whole, a.chain, atom, count(*) AS n_positions, count(*) FILTER (WHERE x IS NULL) AS n_missing, round(coalesce(sum(x), 0), 3) AS sum_x, round(coalesce(sum(z), 0), 3) AS sum_z FROM a JOIN w ON a.name = w.name GROUP BY 1, 2, 3, 4, 5"""


@query("write_complex_jsonl", sql(_COORDS, "residues", "chains"))
def write_complex_jsonl(spark, sf_dir):
    """Every coordinate comes back from the written objects; missing atoms are NaN there."""
    chains = records.parse_complexes(_complex_lines(spark, sf_dir))
    atom = F.array(*[F.struct(F.lit(a.upper()).alias("atom"), F.col(a).alias("coords")) for a in ("n", "ca", "c", "o")])
    each = chains.select("name", "num_of_chains", "whole", "chain", F.inline(atom)).filter(F.size("coords") > 0)
    # A chain's positions are a row already; they are summed there.
    at = lambda p, i: F.coalesce(F.nanvl(F.get(p, F.lit(i)), F.lit(0.0)), F.lit(0.0))
    total = lambda i: F.aggregate("coords", F.lit(0.0), lambda acc, p: acc + at(p, i))
    missing = F.size(F.filter("coords", lambda p: F.isnan(F.get(p, F.lit(0))))).cast("long")
    return each.select(
        "name", "num_of_chains", "whole", "chain", "atom", F.size("coords").cast("long").alias("n_positions"), missing.alias("n_missing"),
        *[F.round(total(i), 3).alias(f"sum_{c}") for c, i in (("x", 0), ("z", 2))],
    )


@query("scan_complex_jsonl", sql(
    "SELECT name, chain, pos, aa, " + ", ".join(f"{a}_{c}" for a in ("n", "ca", "c", "o") for c in "xyz") + " FROM residues", "residues"))
def scan_complex_jsonl(spark, sf_dir):
    """Letters and coordinates of every position, as the objects hold them."""
    return records.complex_positions(records.parse_complexes(_complex_lines(spark, sf_dir)))


def _fixed_lines(spark, sf_dir) -> DataFrame:
    """A line {name: {chain: [pos]}} for each part; files by part size."""
    fixed = fx.fixed(spark, sf_dir).withColumn("k", F.substr("name", F.lit(2)).cast("long"))
    part = (
        spark.read
        .parquet(f"{sf_dir}/part.parquet")
        .select(F.col("p_partkey").alias("k"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("file"))
    )
    line = F.to_json(F.create_map("name", F.create_map("chain", F.array("pos"))))
    return fixed.join(part, "k").select("file", F.col("k").alias("line_no"), line.alias("line"))


@query("scan_constraints", sql(
    "SELECT concat('f', p_size) AS file, arg_max(name, p_partkey) AS name, arg_max(chain, p_partkey) AS chain, arg_max(pos, p_partkey) AS pos "
    "FROM fx_fixed JOIN part ON name = concat('P', p_partkey) GROUP BY p_size", "fx_fixed"))
def scan_constraints(spark, sf_dir):
    return records.parse_fixed(records.last_line(_written(spark, _fixed_lines(spark, sf_dir), "constraints", "file")))


def _constraint_files(spark, sf_dir, value: Column) -> DataFrame:
    """Files by part size of lines {name: value}, value made from name, chain and pos of fx_fixed; the last line of each counts."""
    line = F.concat(F.lit('{"'), "name", F.lit('": '), value, F.lit("}"))
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("file"))
    lines = fx.fixed(spark, sf_dir).join(sizes, "name").select("file", F.substr("name", F.lit(2)).cast("long").alias("line_no"), line.alias("line"))
    return records.last_line(_written(spark, lines, "constraints", "file"))


_LAST_FIXED = "l AS (SELECT arg_max(name, p_partkey) AS name, arg_max(chain, p_partkey) AS chain, arg_max(pos, p_partkey) AS pos FROM fx_fixed JOIN part ON name = concat('P', p_partkey) GROUP BY p_size)"


@query("scan_omit", sql(f"WITH {_LAST_FIXED} SELECT name, chain, pos + i AS pos, aa FROM l CROSS JOIN (VALUES (0, 'C'), (0, 'W'), (1, 'C'), (1, 'W'), (2, 'K')) AS t(i, aa)", "fx_fixed"))
def scan_omit(spark, sf_dir):
    """Two rules for a chain: letters C and W at two positions, K at a third."""
    p = lambda i: (F.col("pos") + i).cast("string")
    rules = F.concat(F.lit('{"'), "chain", F.lit('": [[['), p(0), F.lit(", "), p(1), F.lit('], "CW"], [['), p(2), F.lit('], "K"]]}'))
    return records.parse_omit(_constraint_files(spark, sf_dir, rules))


@query("scan_chain_roles", sql(f"WITH {_LAST_FIXED} SELECT name, chain, 'designed' AS role, 0 AS list_pos FROM l UNION ALL SELECT name, c, 'fixed', i FROM l CROSS JOIN (VALUES (0, 'Y'), (1, 'Z')) AS t(i, c)", "fx_fixed"))
def scan_chain_roles(spark, sf_dir):
    """One designed chain, two fixed ones."""
    return records.parse_chain_roles(_constraint_files(spark, sf_dir, F.concat(F.lit('[["'), "chain", F.lit('"], ["Y", "Z"]]'))))


def _files_of(part: str, line: str) -> str:
    return f"(SELECT concat('f', p_size) AS file, arg_max({line}, p_partkey) AS v FROM {part} GROUP BY p_size)"


@query("scan_bias", f"SELECT file, substr('{MODEL_ORDER}', CAST(v % 20 + 1 AS INT), 1) AS aa, (v % 50) / 4.0 AS bias FROM {_files_of('part', 'p_partkey')}")
def scan_bias(spark, sf_dir):
    """Files of lines {letter: bias}: the last line counts."""
    k = F.col("p_partkey")
    line = F.to_json(F.create_map(F.substr(F.lit(MODEL_ORDER), (k % 20 + 1).cast("int"), F.lit(1)), (k % 50) / 4.0))
    lines = (
        spark.read
        .parquet(f"{sf_dir}/part.parquet")
        .select(F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("file"), k.alias("line_no"), line.alias("line"))
    )
    return records.parse_bias(records.last_line(_written(spark, lines, "bias", "file")))


@query("scan_bias_by_residue", sql(
    "SELECT name, chain, unnest(range(1, 4)) AS pos, j, pos / 2.0 + j + unnest(range(1, 4)) AS bias FROM fx_fixed CROSS "
    "JOIN (SELECT unnest(range(0, 21)) AS j)", "fx_fixed"))
def scan_bias_by_residue(spark, sf_dir):
    """Three positions of one chain for each structure, a file for each part size with one object; 21 numbers a position."""
    fixed = fx.fixed(spark, sf_dir).join(
        spark.read
        .parquet(f"{sf_dir}/part.parquet")
        .select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"),
            F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("file"),
        ),
        "name",
    )
    rows = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.col("pos") / 2.0 + j + i))
    lines = (
        fixed.groupBy("file")
        .agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", F.create_map("chain", rows))))).alias("line"))
        .withColumn("line_no", F.lit(0))
    )
    found = records.parse_bias_by_residue(_written(spark, lines, "bias-by-residue", "file"))
    return found.select("name", "chain", "pos", F.posexplode("bias").alias("j", "bias"))


@query("merge_constraint_lines", "SELECT concat('S', p_size) AS name, concat('v', max(p_partkey)) AS value FROM part GROUP BY p_size")
def merge_constraint_lines(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.to_json(F.create_map(F.concat(F.lit("S"), F.col("p_size").cast("string")), F.concat(F.lit("v"), F.col("p_partkey").cast("string"))))
    return records.merge_lines(part.select(F.col("p_partkey").alias("line_no"), line.alias("line")))


@query("scan_pssm_json", (
    "SELECT concat('S', p_size) AS name, 'A' AS chain, unnest([1, 2]) AS pos, unnest([k / 2.0, k / 4.0]) AS coef, unnest([k + 3.0, "
    "k + 7.0]) AS bias_d, unnest([k - 3.0, k - 7.0]) AS log_odds_d FROM (SELECT p_size, CAST(max(p_partkey) AS DOUBLE) AS k FROM part "
    "GROUP BY p_size)"
))
def scan_pssm_json(spark, sf_dir):
    """Lines {name: {chain: arrays}} with two positions; of lines for one name, files by it, the last counts."""
    k = F.col("p_partkey").cast("double")
    one = lambda a, b: F.array(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.when(j == 2, a).otherwise(0.0)), F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.when(j == 2, b).otherwise(0.0)))
    name = F.concat(F.lit("S"), F.col("p_size").cast("string"))
    line = F.to_json(
        F.create_map(
            name,
            F.create_map(
                F.lit("A"),
                F.struct(F.array(k / 2, k / 4).alias("pssm_coef"), one(k + 3, k + 7).alias("pssm_bias"), one(k - 3, k - 7).alias("pssm_log_odds")),
            ),
        )
    )
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(name.alias("file"), F.col("p_partkey").alias("line_no"), line.alias("line"))
    found = records.parse_pssm_json(_written(spark, lines, "pssm", "file"))
    return found.select("name", "chain", "pos", "coef", F.col("bias")[2].alias("bias_d"), F.col("log_odds")[2].alias("log_odds_d"))


@query("scan_pssm_text", sql(
    "SELECT name, pos, j, CAST(floor(logits[j + 1]) AS BIGINT) AS log_odds, abs(CAST(floor(logits[21 - j]) AS BIGINT)) AS prob FROM fx_logits "
    "CROSS JOIN (SELECT unnest(range(0, 20)) AS j)", "fx_logits"))
def scan_pssm_text(spark, sf_dir):
    text = lambda v: F.lpad(v.cast("string"), 5, " ")
    whole = F.transform("logits", lambda v: F.floor(v))
    cells = F.concat(F.transform(F.slice(whole, 1, 20), text), F.transform(F.slice(F.reverse(whole), 1, 20), lambda v: text(F.abs(v))))
    rows = fx.logits(spark, sf_dir).select(
        "name",
        (F.col("pos") + 2).alias("line_no"),
        F.concat(F.lpad(F.lit("1"), 4, " "), F.array_join(cells, "")).alias("line"),
    )
    heads = (
        rows.select("name")
        .distinct()
        .select(
            "name",
            F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("line_no"), F.lit("header").alias("line")) for i in range(3)])).alias("h"),
        )
        .select("name", "h.*")
    )
    found = records.parse_pssm_text(_written(spark, rows.unionByName(heads), "pssm-text"))
    zipped = found.select("name", "pos", F.posexplode(F.arrays_zip("log_odds", "probs")).alias("j", "z"))
    return zipped.select("name", "pos", "j", F.col("z.log_odds").cast("long").alias("log_odds"), F.col("z.probs").cast("long").alias("prob"))


def _fasta(spark, sf_dir) -> DataFrame:
    """A file for each customer: the best score as the native record, then all samples, at two temperatures."""
    r = fx.results(spark, sf_dir)
    chains = lambda *x: F.array(*map(F.lit, x))
    native = (
        r.groupBy("name")
        .agg(F.min("score").alias("score"), F.min_by("sequence", "sample_id").alias("sequence"))
        .select("*", chains("B").alias("fixed_chains"), chains("C", "A").alias("designed_chains"), F.lit("v1").alias("model_name"))
    )
    samples = r.select(
        "name",
        F.when(F.col("sample_id") % 2 == 0, 0.1).otherwise(0.15).alias("temperature"),
        "sample_id",
        "score",
        F.lit(0.5).alias("recovery"),
        "sequence",
    )
    return _written(spark, records.render_fasta(native, samples), "fasta")


def _text4(x: str) -> str:
    return f"printf('%.4f', CAST(CAST({x} AS FLOAT) AS DOUBLE))"


_RECORDS = f"""r AS (SELECT name, 0 AS own, 0.0 AS t, 0 AS sample_id, '>' || name || ', score=' || {_text4("min(score)")} || ', fixed_chains=[''B''], designed_chains=[''A'', ''C''], model_name=v1' AS head, arg_min(sequence, sample_id) AS sequence FROM fx_results GROUP BY name
UNION ALL SELECT name, 1, CASE WHEN sample_id % 2 = 0 THEN 0.1 ELSE 0.15 END, sample_id, '>T=' || CASE WHEN sample_id % 2 = 0 THEN '0.1' ELSE '0.15' END || ', sample=' || sample_id || ', score=' || {_text4("score")} || ', seq_recovery=0.5000', sequence FROM fx_results),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY own, t, sample_id) - 1 AS k FROM r)"""


@query("write_fasta", sql(f"WITH {_RECORDS} SELECT name, 2 * k AS line_no, head AS line FROM k UNION ALL SELECT name, 2 * k + 1, sequence FROM k", "fx_results"))
def write_fasta(spark, sf_dir):
    return _fasta(spark, sf_dir)


@query("scan_design_fasta", sql(
    f"SELECT name AS file, false AS native, CASE WHEN sample_id % 2 = 0 THEN 0.1 ELSE 0.15 END AS temperature, sample_id AS sample, "
    f"CAST({_text4('score')} AS DOUBLE) AS score, 0.5 AS recovery, '' AS designed, sequence FROM fx_results UNION ALL "
    f"SELECT name, true, -1.0, -1, CAST({_text4('min(score)')} AS DOUBLE), -1.0, 'AC', arg_min(sequence, sample_id) FROM fx_results "
    f"GROUP BY name", "fx_results"))
def scan_design_fasta(spark, sf_dir):
    found = records.parse_design_fasta(_fasta(spark, sf_dir).withColumnRenamed("name", "file"))
    known = lambda c: F.coalesce(F.col(c), F.lit(-1)).alias(c)
    return found.select(
        "file",
        "native",
        known("temperature"),
        known("sample"),
        "score",
        known("recovery"),
        F.coalesce(F.array_join("designed_chains", ""), F.lit("")).alias("designed"),
        "sequence",
    )


#: The s-th fifth of the sequence has each letter moved on in the model's order.
_MOVED = f"translate({{part}}, '{MODEL_ORDER}', '{MODEL_ORDER[1:] + MODEL_ORDER[0]}')"


def _samples(spark, sf_dir) -> DataFrame:
    """Four samples for each sequence that isn't empty; a filter would make every sequence twice, once for itself."""
    four = F.when(F.col("seq") != "", F.sequence(F.lit(0), F.lit(3)))
    seq = fx.sequences(spark, sf_dir).select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("name"),
        F.col("seq").alias("native"),
        F.explode(four).alias("sample_id"),
    )
    cut = seq.withColumn("lo", F.floor(F.length("native") * F.col("sample_id") / 5).cast("int")).withColumn(
        "hi",
        F.floor(F.length("native") * (F.col("sample_id") + 1) / 5).cast("int"),
    )
    part = lambda a, b: F.substr("native", F.col(a) + 1 if a else F.lit(1), (F.col(b) - (F.col(a) if a else 0)) if b else F.length("native"))
    return cut.select(
        "name",
        "sample_id",
        "native",
        F.concat(part(None, "lo"), F.translate(part("lo", "hi"), MODEL_ORDER, MODEL_ORDER[1:] + MODEL_ORDER[0]), part("hi", None)).alias("sequence"),
    )


_SAMPLES_SQL = f"""s AS (SELECT concat('D', doc_id) AS name, k AS sample_id, seq AS native, CAST(floor(length(seq) * k / 5.0) AS INT) AS lo, CAST(floor(length(seq) * (k + 1) / 5.0) AS INT) AS hi FROM fx_seq CROSS JOIN (SELECT unnest(range(0, 4)) AS k) WHERE seq <> ''),
l AS (SELECT name, sample_id, unnest(string_split(native, '')) AS native, unnest(string_split(substr(native, 1, lo) || {_MOVED.format(part="substr(native, lo + 1, hi - lo)")} || substr(native, hi + 1), '')) AS aa FROM s)"""


@query("seq_recovery", sql(
    f"WITH {_SAMPLES_SQL} SELECT name, sample_id, round(CAST(count(*) FILTER (WHERE native <> 'X' "
    f"AND native = aa) AS DOUBLE) / nullif(count(*) FILTER (WHERE native <> 'X'), 0), 4) AS recovery FROM l GROUP BY name, sample_id", "fx_seq"))
def seq_recovery(spark, sf_dir):
    return scoring.seq_recovery(_samples(spark, sf_dir), ["name", "sample_id"]).withColumn("recovery", F.round("recovery", 4))


@query("write_results", sql("SELECT pose, sequence, score, concat('Pose_', pose, '_', sequence, '.pdb') AS filename FROM fx_results", "fx_results"))
def write_results(spark, sf_dir):
    path = new_path(spark, "results")
    named = fx.results(spark, sf_dir).select(
        "pose",
        "sequence",
        "score",
        F.concat(F.lit("Pose_"), "pose", F.lit("_"), "sequence", F.lit(".pdb")).alias("filename"),
    )
    scoring.rank_results(named).write.option("header", True).csv(path)
    return spark.read.schema("pose string, sequence string, score double, filename string").option("header", True).csv(path)


@query("write_scores", sql("SELECT name, count(*) AS n_positions, round(sum(logits[1]), 4) AS first_sum FROM fx_logits GROUP BY name", "fx_logits"))
def write_scores(spark, sf_dir):
    path = new_path(spark, "scores")
    records.write_scores(fx.logits(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("name").agg(F.count("*").alias("n_positions"), F.round(F.sum(F.col("logits")[0]), 4).alias("first_sum"))


@query("pose_layout", sql("SELECT pose, sequence, 'Poses/Pose' || dense_rank() OVER (ORDER BY pose) || '_' || sequence || '.pdb' AS path FROM fx_results", "fx_results"))
def pose_layout(spark, sf_dir):
    """Poses are numbered in a table of their own, by ranges, which is joined."""
    return dense_numbered(fx.results(spark, sf_dir), "pose", "i").select(
        "pose",
        "sequence",
        F.concat(F.lit("Poses/Pose"), F.col("i").cast("string"), F.lit("_"), "sequence", F.lit(".pdb")).alias("path"),
    )
