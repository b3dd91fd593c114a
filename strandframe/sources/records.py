"""JSON lines of complexes and constraints, PSSM text, FASTA of designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.letters import chain_rank

_MAP = "map<string,string>"
_ATOMS = ("n", "ca", "c", "o")


def parse_complexes(lines: DataFrame) -> DataFrame:
    """name, num_of_chains, whole, chain, seq, n, ca, c, o of each chain of complexes with dynamic seq_chain_<letter> and coords_chain_<letter> keys (column line); whole is the complex's
    sequence, atoms are arrays of positions. What an object lacks is null.

    A line is read once, its coordinates once more as numbers; a complex's chains come out of its row, nothing is grouped.
    """
    m, starts = F.col("m"), (("seq_chain_", 11), ("coords_chain_", 14))
    letter = lambda k: F.coalesce(*[F.when(k.startswith(s), F.substr(k, F.lit(at))) for s, at in starts])
    chains = F.array_distinct(F.filter(F.transform(F.map_keys("m"), letter), lambda c: c.isNotNull()))
    one = lambda c: F.struct(c.alias("chain"), *[m[F.concat(F.lit(s), c)].alias(f"_{s}") for s, _ in starts])
    keyed = lines.select(F.from_json("line", _MAP).alias("m")).select(
        m["name"].alias("name"), m["num_of_chains"].cast("long").alias("num_of_chains"), m["seq"].alias("whole"), F.inline(F.transform(chains, one))
    )
    # Out of an explode, so that each use of an atom doesn't parse the object anew.
    numbers = F.explode(F.array(F.struct(F.from_json("_coords_chain_", "map<string,array<array<double>>>").alias("q"))))
    read = keyed.select("name", "num_of_chains", "whole", "chain", F.col("_seq_chain_").alias("seq"), numbers.alias("_n"))
    atoms = [F.col("_n.q")[F.concat(F.lit(f"{a.upper()}_chain_"), "chain")].alias(a) for a in _ATOMS]
    return read.select("name", "num_of_chains", "whole", "chain", "seq", *atoms)


def parse_complex_json(lines: DataFrame) -> DataFrame:
    """name, chain, seq of parse_complexes, for callers that want sequences alone."""
    keyed = lines.select(F.from_json("line", _MAP).alias("m")).select(F.col("m")["name"].alias("name"), F.explode("m").alias("key", "seq"))
    return keyed.filter(F.col("key").startswith("seq_chain_")).select("name", F.substr("key", F.lit(11)).alias("chain"), "seq")


def complex_positions(complexes: DataFrame) -> DataFrame:
    """name, chain, pos, aa, <atom>_<axis>: a row for each position of parse_complexes' chains, as many as the longer of letters and coordinates; NaN is null."""
    n = F.greatest(F.coalesce(F.length("seq"), F.lit(0)), *[F.coalesce(F.size(a), F.lit(0)) for a in _ATOMS])
    each = complexes.select("name", "chain", F.split("seq", "").alias("_letters"), *_ATOMS, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("_i"))
    i = F.col("_i")
    axes = [F.nanvl(F.get(F.get(a, i), F.lit(j)), F.lit(None).cast("double")).alias(f"{a}_{c}") for a in _ATOMS for j, c in enumerate("xyz")]
    return each.select("name", "chain", (i + 1).alias("pos"), F.get("_letters", i).alias("aa"), *axes)


def parse_complex_coords(lines: DataFrame) -> DataFrame:
    """name, chain, atom, coords (array of positions) from the coords_chain_<letter> objects."""
    keyed = (
        lines.select(F.from_json("line", _MAP).alias("m"))
        .select(F.col("m")["name"].alias("name"), F.explode("m").alias("key", "value"))
        .filter(F.col("key").startswith("coords_chain_"))
    )
    atoms = keyed.select("name", F.substr("key", F.lit(14)).alias("chain"), F.explode(F.from_json("value", _MAP)).alias("atom", "xyz"))
    return atoms.select(
        "name",
        "chain",
        F.substring_index("atom", "_chain_", 1).alias("atom"),
        F.from_json("xyz", "array<array<double>>").alias("coords"),
    )


def last_line(lines: DataFrame, by: str = "file") -> DataFrame:
    """Each file's last line: later lines replace earlier ones."""
    return lines.groupBy(by).agg(F.max_by("line", "line_no").alias("line"))


def parse_fixed(lines: DataFrame, by: str = "file") -> DataFrame:
    """by, name, chain, pos from {name: {chain: [pos]}}."""
    names = lines.select(by, F.explode(F.from_json("line", "map<string,map<string,array<int>>>")).alias("name", "chains"))
    return names.select(by, "name", F.explode("chains").alias("chain", "positions")).select(by, "name", "chain", F.explode("positions").alias("pos"))


def parse_chain_roles(lines: DataFrame) -> DataFrame:
    """name, chain, role, list_pos from {name: [[designed], [fixed]]}."""
    names = lines.select(F.explode(F.from_json("line", "map<string,array<array<string>>>")).alias("name", "lists"))
    lists = names.select("name", F.posexplode("lists").alias("which", "chains"))
    return lists.select(
        "name",
        F.when(F.col("which") == 0, "designed").otherwise("fixed").alias("role"),
        F.posexplode("chains").alias("list_pos", "chain"),
    ).select("name", "chain", "role", "list_pos")


def parse_tied(lines: DataFrame) -> DataFrame:
    """name, group_id, member, chain, pos, beta from {name: [{chain: [pos]} or {chain: [[pos], [beta]]}]}; member numbers a group's positions as they are
    listed; beta is 1 where not given."""
    groups = lines.select(
        F.explode(F.from_json("line", "map<string,array<map<string,string>>>")).alias("name", "groups")
    ).select("name", F.posexplode("groups").alias("group_id", "g"))
    def of(chain):
        value, both = chain["value"], F.from_json(chain["value"], "array<array<double>>")
        weighted = value.startswith("[[")
        positions = F.when(weighted, F.transform(both[0], lambda p: p.cast("int"))).otherwise(F.from_json(value, "array<int>"))
        betas = F.when(weighted, both[1]).otherwise(F.transform(positions, lambda _: F.lit(1.0)))
        return F.zip_with(
            positions,
            betas,
            lambda p, b: F.struct(chain["key"].alias("chain"), p.alias("pos"), F.coalesce(b, F.lit(1.0)).alias("beta")),
        )

    members = groups.select("name", "group_id", F.posexplode(F.flatten(F.transform(F.map_entries("g"), of))).alias("member", "m"))
    return members.select("name", "group_id", "member", "m.chain", "m.pos", "m.beta")


def parse_bias(lines: DataFrame, by: str = "file") -> DataFrame:
    """by, aa, bias from {letter: bias}, for all structures."""
    return lines.select(by, F.explode(F.from_json("line", "map<string,double>")).alias("aa", "bias"))


def parse_bias_by_residue(lines: DataFrame) -> DataFrame:
    """name, chain, pos, bias (21 numbers) from {name: {chain: [[21 numbers] of each position]}}."""
    names = lines.select(F.explode(F.from_json("line", "map<string,map<string,array<array<double>>>>")).alias("name", "chains"))
    return (
        names.select("name", F.explode("chains").alias("chain", "rows"))
        .select("name", "chain", F.posexplode("rows").alias("_i", "bias"))
        .select("name", "chain", (F.col("_i") + 1).alias("pos"), "bias")
    )


def parse_pssm_json(lines: DataFrame) -> DataFrame:
    """name, chain, pos, coef, bias, log_odds from {name: {chain: {pssm_coef, pssm_bias, pssm_log_odds}}}; of lines for one name the last counts."""
    kind = "map<string,struct<pssm_coef: array<double>, pssm_bias: array<array<double>>, pssm_log_odds: array<array<double>>>>"
    chains = merge_lines(lines).select("name", F.explode(F.from_json("value", kind)).alias("chain", "p"))
    rows = chains.select("name", "chain", F.posexplode(F.arrays_zip("p.pssm_coef", "p.pssm_bias", "p.pssm_log_odds")).alias("_i", "r"))
    return rows.select(
        "name",
        "chain",
        (F.col("_i") + 1).alias("pos"),
        F.col("r.pssm_coef").alias("coef"),
        F.col("r.pssm_bias").alias("bias"),
        F.col("r.pssm_log_odds").alias("log_odds"),
    )


def parse_omit(lines: DataFrame) -> DataFrame:
    """name, chain, pos, aa from {name: {chain: [[[positions], letters]]}}."""
    names = lines.select(
        F.explode(F.from_json("line", "map<string,map<string,array<array<string>>>>")).alias("name", "chains")
    ).select("name", F.explode("chains").alias("chain", "rules"))
    rules = names.select("name", "chain", F.explode("rules").alias("r")).select(
        "name",
        "chain",
        F.explode(F.from_json(F.col("r")[0], "array<int>")).alias("pos"),
        F.col("r")[1].alias("letters"),
    )
    return rules.select("name", "chain", "pos", F.explode(F.filter(F.split("letters", ""), lambda c: c != "")).alias("aa"))


def merge_lines(lines: DataFrame) -> DataFrame:
    """name, value over all lines ({name: value}); a later line replaces an earlier one's name."""
    each = lines.select("line_no", F.explode(F.from_json("line", _MAP)).alias("name", "value"))
    return each.groupBy("name").agg(F.max_by("value", "line_no").alias("value"))


def parse_pssm_text(lines: DataFrame, by: str = "name") -> DataFrame:
    """by, pos, log_odds (20), probs (20): two lines and a header are skipped, then each row loses four characters and is split at blanks."""
    rows = lines.filter("line_no >= 3").select(
        by,
        (F.col("line_no") - 2).alias("pos"),
        F.split(F.trim(F.substr("line", F.lit(5))), "\\s+").alias("cells"),
    )
    numbers = rows.select(by, "pos", F.transform("cells", lambda c: c.try_cast("double")).alias("v"))
    return numbers.select(by, "pos", F.slice("v", 1, 20).alias("log_odds"), F.slice("v", 21, 20).alias("probs"))


def parse_design_fasta(lines: DataFrame, by: str = "file") -> DataFrame:
    """A row for each record (columns by, line_no, line): native headers give name, fixed and designed chains; sample headers T, sample, recovery."""
    after = F.lead("line").over(W.partitionBy(by).orderBy("line_no"))
    heads = lines.withColumn("sequence", after).filter(F.col("line").startswith(">"))
    line = F.col("line")
    native = ~line.startswith(">T=")
    field = lambda key, what: F.nullif(F.regexp_extract(line, f"(?:^>|, ){key}={what}", 1), F.lit(""))
    chains = lambda key: F.from_json(F.translate(field(key, "(\\[[^\\]]*\\])"), "'", '"'), "array<string>")
    return heads.select(
        by, "line_no", native.alias("native"), F.when(native, F.regexp_extract(line, "^>([^,]*)", 1)).alias("name"), field("T", "([^,]*)").cast("double").alias("temperature"), field("sample", "([^,]*)").cast("long").alias("sample"),
        field("score", "([^,]*)").cast("double").alias("score"), field("seq_recovery", "([^,]*)").cast("double").alias("recovery"), chains("fixed_chains").alias("fixed_chains"), chains("designed_chains").alias("designed_chains"), "sequence",
    )


def _text(value: Column) -> Column:
    """A string as JSON text."""
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _member(key: Column, value: Column) -> Column:
    """A JSON object's one member from its key and its value's text, without the braces."""
    return F.concat(_text(key), F.lit(": "), value)


def _coords(rows: Column) -> Column:
    """The member coords_chain_<chain>, from the chain's residues by place (n, ca, c, o)."""
    atoms = [F.concat(_text(F.concat(F.lit(f"{a.upper()}_chain_"), "chain")), F.lit(":"), F.replace(F.to_json(rows[a]), F.lit('"NaN"'), F.lit("NaN"))) for a in _ATOMS]
    return _member(F.concat(F.lit("coords_chain_"), "chain"), F.concat(F.lit("{"), F.concat_ws(",", *atoms), F.lit("}")))


def _placed(*more: str) -> Column:
    """A chain's residues by place: pos, more, and the atoms, NaN where missing."""
    nan = F.array(*[F.lit(float("nan"))] * 3)
    return F.sort_array(F.collect_list(F.struct("pos", *more, *[F.coalesce(a, nan).alias(a) for a in _ATOMS])))


def _seq_member() -> Column:
    return _member(F.concat(F.lit("seq_chain_"), "chain"), _text(F.col("seq")))


def render_complex_json(chains: DataFrame, residues: DataFrame | None = None) -> DataFrame:
    """name, line: one JSON object for each complex, chains as they are listed, from (name, chain, seq); with residues (name, chain, pos, n, ca, c, o), the
    coordinates too. A missing atom is three NaN."""
    parts = chains.select("name", "chain", "seq", _seq_member().alias("text"))
    if residues is not None:
        coords = residues.groupBy("name", "chain").agg(_placed().alias("rows")).select("name", "chain", _coords(F.col("rows")).alias("coords"))
        parts = parts.join(coords, ["name", "chain"], "left").withColumn("text", F.concat_ws(", ", "text", "coords")).drop("coords")
    return _objects(parts)


def render_complexes(residues: DataFrame) -> DataFrame:
    """render_complex_json from residues with their letters (name, chain, pos, aa, n, ca, c, o) alone: sequences and coordinates come from one grouping, and residues that lie by name aren't shuffled."""
    chains = residues.groupBy("name", "chain").agg(_placed("aa").alias("rows"))
    spelled = chains.select("name", "chain", "rows", F.array_join(F.col("rows")["aa"], "").alias("seq"))
    return _objects(spelled.select("name", "chain", "seq", F.concat(_seq_member(), F.lit(", "), _coords(F.col("rows"))).alias("text")))


def _objects(parts: DataFrame) -> DataFrame:
    """name, line from each chain's seq and members (text)."""
    rank = chain_rank(F.col("chain"))
    per = parts.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "chain", "seq", "text"))).alias("c"))
    rest = [_member(F.lit("name"), _text(F.col("name"))), _member(F.lit("num_of_chains"), F.size("c").cast("string")), _member(F.lit("seq"), _text(F.array_join(F.col("c")["seq"], "")))]
    return per.select("name", F.concat(F.lit("{"), F.concat_ws(", ", F.array_join(F.col("c")["text"], ", "), *rest), F.lit("}")).alias("line"))


def fixed4(x: Column) -> Column:
    """A score as single-precision number with four decimals; exact halves go to the even digit."""
    return F.bround(x.cast("float").cast("double").cast("decimal(38,20)"), 4).cast("string")


def _quoted(chains: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(chains), lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))


def render_fasta(natives: DataFrame, samples: DataFrame) -> DataFrame:
    """name, line_no, line: the native record (name, score, fixed_chains, designed_chains, model_name, sequence) first, then its samples
    (name, temperature, sample_id, score, recovery, sequence) by temperature and id; two lines a record."""
    head = F.concat(
        F.lit(">"),
        "name",
        F.lit(", score="),
        fixed4(F.col("score")),
        F.lit(", fixed_chains="),
        _quoted(F.col("fixed_chains")),
        F.lit(", designed_chains="),
        _quoted(F.col("designed_chains")),
        F.lit(", model_name="),
        "model_name",
    )
    first = natives.select(
        "name",
        F.lit(0).alias("own"),
        F.lit(0.0).alias("temperature"),
        F.lit(0).cast("long").alias("sample_id"),
        head.alias("header"),
        "sequence",
    )
    head = F.concat(
        F.lit(">T="),
        F.col("temperature").cast("string"),
        F.lit(", sample="),
        F.col("sample_id").cast("string"),
        F.lit(", score="),
        fixed4(F.col("score")),
        F.lit(", seq_recovery="),
        fixed4(F.col("recovery")),
    )
    rest = samples.select(
        "name",
        F.lit(1).alias("own"),
        F.col("temperature").cast("double"),
        F.col("sample_id").cast("long"),
        head.alias("header"),
        "sequence",
    )
    order = W.partitionBy("name").orderBy("own", "temperature", "sample_id")
    numbered = first.unionByName(rest).withColumn("k", F.row_number().over(order) - 1)
    return numbered.select(
        "name",
        F.posexplode(F.array("header", "sequence")).alias("_i", "line"),
        "k",
    ).select("name", (2 * F.col("k") + F.col("_i")).alias("line_no"), "line")


def write_scores(scores: DataFrame, path: str) -> None:
    """Numbers by structure and position (name, pos, ...), in files that hold ranges of names, sorted, so that a structure's are found by the files' least and greatest names."""
    scores.repartitionByRange("name", "pos").sortWithinPartitions("name", "pos").write.parquet(path)
