"""Structure and design tables derived from the driver's tables, for Spark and, as common table expressions, for DuckDB.

All views cover their whole source tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.letters import CHAINS, LETTER_OF

#: The place of a one-letter chain in the order in which chains are listed.
RANK = f"instr('{CHAINS}0123456789', chain)"

#: Line items that are dealt to a task, about.
_DEALT = 250_000

_RES_RAW = """
SELECT concat('{prefix}', CAST({key} AS VARCHAR(20))) AS name, substr('ABCDba1', CAST(l_linenumber AS INT), 1) AS chain,
  CAST(l_orderkey % 12 AS INT) - 2 AS resseq, CASE WHEN CAST(l_quantity AS INT) % 10 = 0 THEN 'A' ELSE '' END AS icode,
  CAST(l_suppkey % 22 AS INT) AS res_code, l_quantity - 25 AS x0, l_discount * 100 AS y0, l_tax * 300 AS z0, l_orderkey AS okey,
  row_number() OVER (PARTITION BY {key} ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate, l_quantity, l_extendedprice) AS rn
FROM {lineitem}"""

_ATOMS = """
SELECT name, chain, resseq, icode, (rn - 1) * 5 + j AS line_no, atom, CASE WHEN res_code = 20 THEN 'HETATM' ELSE 'ATOM' END AS record,
  substr('ALAARGASNASPCYSGLNGLUGLYHISILELEULYSMETPHEPROSERTHRTRPTYRVALMSEUNK', res_code * 3 + 1, 3) AS res3,
  round(x0 + j * 1.25, 3) AS x, round(y0 + j * 0.75, 3) AS y, round(z0 - j * 0.5, 3) AS z, substr('NCCOC', j + 1, 1) AS element
FROM {raw} CROSS JOIN (SELECT * FROM (VALUES (0,'N'),(1,'CA'),(2,'C'),(3,'O'),(4,'CB')) AS t(j, atom)) AS a
WHERE (okey + j) % 17 <> 0"""

_PUNCTUATION = " .,;:!?''\"()-/0123456789"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEQ = f"""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN s ELSE translate(s, 'BJOUZ', '-XAGS') END AS seq FROM
 (SELECT doc_id, translate(translate(translate(coalesce(text, ''), '{_LOWER}', '{_UPPER}'), '{_PUNCTUATION}', ''), chr(10), '') AS s FROM {{documents}}) AS q"""

_FIXED = """
SELECT concat('P', CAST(p_partkey AS VARCHAR(20))) AS name, substr('ABCDba1', CAST(p_size % 7 AS INT) + 1, 1) AS chain, CAST(p_size % 4 AS INT) + 1 AS pos FROM {part}"""

_RESULTS = """
SELECT o_orderpriority AS pose, CAST(o_orderkey AS VARCHAR(20)) AS sequence, o_totalprice / 100000 AS score, o_orderkey AS sample_id, concat('C', CAST(o_custkey AS VARCHAR(20))) AS name FROM {orders}"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(spark: SparkSession, sf_dir: str, by: str = "part") -> DataFrame:
    """The line items with the name of their structure: one at least for each residue, so that structures can be counted without their atoms."""
    prefix, key = ("P", "l_partkey") if by == "part" else ("S", "l_suppkey")
    return _table(spark, sf_dir, "lineitem").withColumn("name", F.concat(F.lit(prefix), F.col(key).cast("string")))


def atoms(spark: SparkSession, sf_dir: str, by: str = "part") -> DataFrame:
    """Five atoms for each line item, some missing; a structure is a part, or a supplier (fewer and larger, for files).

    Lines are numbered by name, not by the key it is made of: rows lie by name, also where line numbers aren't asked for, and what follows by name or within it needs no further shuffle.
    """
    items = named(spark, sf_dir, by)
    # What a task sorts and holds follows the rows dealt to it, whatever the number of shuffle partitions; the count is read from the files' footers.
    parts = -(-items.count() // _DEALT)
    items = items.repartition(parts, "name") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else items.repartition("name")
    text = _RES_RAW.replace("concat('{prefix}', CAST({key} AS VARCHAR(20))) AS name", "name").replace("PARTITION BY {key}", "PARTITION BY name")
    raw = spark.sql(text.format(lineitem="{lineitem}"), lineitem=items)
    # Half of the time to make atoms went into decimal multiplication and rounding: as doubles, with round where a half is near or the number is large.
    text = _ATOMS
    for place in ("x0 + j * 1.25", "y0 + j * 0.75", "z0 - j * 0.5"):
        v = f"({place}D)"
        text = text.replace(f"round({place}, 3)", f"CASE WHEN abs({v}) < 1e6D AND abs({v} * 1000 - rint({v} * 1000)) < 0.499999D THEN rint({v} * 1000) / 1000 + 0D ELSE round({v}, 3) END")
    return spark.sql(text, raw=raw)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SEQ, documents=_table(spark, sf_dir, "documents"))


def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FIXED, part=_table(spark, sf_dir, "part"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RESULTS, orders=_table(spark, sf_dir, "orders"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, pos, logits: 21 numbers for each embedding; a structure is a label's part of 500 embeddings, so structures grow in number only."""
    e = _table(spark, sf_dir, "embeddings").withColumn(
        "name",
        F.concat(F.lit("L"), F.col("label").cast("string"), F.lit("p"), F.floor(F.col("vec_id") / 500).cast("string")),
    )
    return spark.sql(
        "SELECT name, row_number() OVER (PARTITION BY name ORDER BY vec_id) AS pos, transform(slice(embedding, 1, 21), "
        "v -> CAST(v AS DOUBLE) * 10) AS logits FROM {e}",
        e=e,
    )


_letter = "CASE res3 " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LETTER_OF.items()) + " ELSE '-' END"


def _xyz(atom: str) -> str:
    low = atom.lower()
    return ", ".join(f"arg_min({c}, line_no) FILTER (WHERE atom = '{atom}') AS {low}_{c}" for c in "xyz")


_BACKBONE = [f"{a}_{c}" for a in ("n", "ca", "c", "o") for c in "xyz"]

#: Common table expressions by name; each may use those above it.
CTES = {
    "fx_res_raw": _RES_RAW.format(prefix="P", key="l_partkey", lineitem="lineitem"),
    "fx_atoms": _ATOMS.format(raw="fx_res_raw"),
    "fx_file_raw": _RES_RAW.format(prefix="S", key="l_suppkey", lineitem="lineitem"),
    "fx_file_atoms": _ATOMS.format(raw="fx_file_raw"),
    "read_atoms": (
        "SELECT name, chain, resseq, icode, line_no, atom, CASE WHEN res3 = 'MSE' THEN 'MET' ELSE res3 END AS res3, x, y, z FROM fx_atoms "
        "WHERE record = 'ATOM' OR res3 = 'MSE'"
    ),
    "res": (
        f"SELECT name, chain, resseq, icode, arg_min(res3, line_no) AS res3, {', '.join(_xyz(a) for a in ('N', 'CA', 'C', 'O'))} "
        f"FROM read_atoms GROUP BY name, chain, resseq, icode"
    ),
    "spans": (
        "SELECT name, chain, unnest(range(lo, hi + 1)) AS resseq FROM (SELECT name, chain, min(resseq) AS lo, max(resseq) AS hi FROM res "
        "GROUP BY name, chain)"
    ),
    "residues": f"SELECT s.name, s.chain, s.resseq, coalesce(r.icode, '') AS icode, {_letter} AS aa, {', '.join(_BACKBONE)}, row_number() OVER (PARTITION BY s.name, s.chain ORDER BY s.resseq, coalesce(r.icode, '')) AS pos, "
    f"CASE WHEN {' AND '.join(f'{a}_x IS NOT NULL' for a in ('n', 'ca', 'c', 'o'))} THEN 1 ELSE 0 END AS mask FROM spans s LEFT "
    f"JOIN res r ON s.name = r.name AND s.chain = r.chain AND s.resseq = r.resseq",
    "chains": "SELECT name, chain, string_agg(aa, '' ORDER BY pos) AS seq, count(*) AS len FROM residues GROUP BY name, chain",
    "offsets": "SELECT name, chain, seq, len, row_number() OVER w AS chain_no, coalesce(sum(len) OVER (PARTITION BY name ORDER BY " + RANK + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM chains WINDOW w AS (PARTITION BY name ORDER BY " + RANK + ")",
    "fx_seq": _SEQ.format(documents="documents"),
    "fx_fixed": _FIXED.format(part="part"),
    "fx_results": _RESULTS.format(orders="orders"),
    "fx_logits": (
        "SELECT concat('L', label, 'p', vec_id // 500) AS name, row_number() OVER (PARTITION BY label, vec_id // 500 "
        "ORDER BY vec_id) AS pos, list_transform(embedding[1:21], lambda v: CAST(v AS DOUBLE) * 10) AS logits FROM embeddings"
    ),
    "fx_logp": "SELECT name, pos, unnest(logits) AS l, unnest(range(0, 21)) AS idx FROM fx_logits",
    "fx_soft": (
        "SELECT name, pos, idx, l, exp(l - m) / z AS p, l - m - ln(z) AS lp FROM (SELECT *, sum(exp(l - m)) OVER (PARTITION BY name, pos) AS z "
        "FROM (SELECT *, max(l) OVER (PARTITION BY name, pos) AS m FROM fx_logp))"
    ),
}
_NEEDS = {
    "fx_atoms": ["fx_res_raw"], "fx_file_atoms": ["fx_file_raw"], "read_atoms": ["fx_atoms"], "res": ["read_atoms"], "spans": ["res"], "residues": ["spans", "res"], "chains": ["residues"], "offsets": ["chains"], "fx_logp": ["fx_logits"], "fx_soft": ["fx_logp"],
}


def sql(query: str, *needed: str) -> str:
    """query after the common table expressions that it needs."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        wanted.add(name)

    for n in needed:
        add(n)
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in wanted)
    more = query.strip()
    if more.startswith("WITH "):
        return f"WITH {ctes}, {more[5:]}"
    return f"WITH {ctes} {more}"
