"""From atoms to residues, chains and complexes. Positions are 1-based and count gap residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.letters import CHAINS, chain_rank, to_letter, to_three
from ..scratch import cut
from .ranks import with_small

ATOMS = ("N", "CA", "C", "O")
KEY = ["name", "chain", "resseq", "icode"]


def mirror(atoms: DataFrame) -> DataFrame:
    """The mirror image: x changes sign."""
    return atoms.withColumn("x", -F.col("x"))


def residues_from_atoms(atoms: DataFrame) -> DataFrame:
    """One row for each residue; the first line wins for its name and for each atom (n, ca, c, o: arrays, null where missing).

    All aggregation buffers are numbers (a name of up to seven characters is one long), so Spark aggregates by hash and before its shuffle.
    """
    line = F.col("line_no")
    firsts = [F.min_by(c, F.when(F.col("atom") == a, line)).alias(f"_{a}_{c}") for a in ATOMS for c in "xyz"]
    byte = lambda i: F.ascii(F.substr("res3", F.lit(i), F.lit(1))).cast("long")
    # Names of three ASCII letters, which nearly all have, get the same number without its digits being written and read.
    name = (
        F.when((F.octet_length("res3") == 3) & (F.length("res3") == 3), byte(1) * 65536 + byte(2) * 256 + byte(3))
        .when(F.octet_length("res3") <= 7, F.conv(F.hex("res3"), 16, 10).cast("long"))
        .otherwise(F.raise_error(F.lit("a residue name has seven bytes at most")).cast("long"))
    )
    grouped = atoms.groupBy(*KEY).agg(F.min_by(name, line).alias("_res3"), *firsts)
    res3 = F.coalesce(F.unhex(F.hex("_res3")).cast("string"), F.lit(""))
    xyz = lambda a: F.when(F.coalesce(*[f"_{a}_{c}" for c in "xyz"]).isNotNull(), F.array(*[f"_{a}_{c}" for c in "xyz"]))
    return grouped.select(*KEY, res3.alias("res3"), *[xyz(a).alias(a.lower()) for a in ATOMS]).withColumn("aa", to_letter(F.col("res3")))


def placed(residues: DataFrame, width: int = 256, small: int = 4096, counted: DataFrame | None = None) -> DataFrame:
    """All residue numbers between a chain's least and largest; those without residue are '-' without atoms. With them pos, the 1-based place in the chain by number, then insertion
    code ('' first), chain_no, the chain's place in its structure as chains are listed, and start, the residues of the chains before.

    Structures of up to ``small`` residues are ordered by windows of a chain and of a structure, which rows that lie by name are ready for; larger ones, if a count finds
    any, by ranges, so that one of any size goes over many tasks. residues: KEY, aa and any others; counted: rows to count instead, one at least for each residue.
    """
    large = cut((residues if counted is None else counted).groupBy("name").agg(F.count("*").alias("_n")).filter(F.col("_n") > small).select("name"), "large")
    if large.isEmpty():
        return _by_windows(residues)
    of = F.broadcast(large)  # one row for at least ``small`` residues
    return _by_windows(residues.join(of, "name", "left_anti")).unionByName(_by_ranges(residues.join(of, "name", "left_semi"), width))


def _by_windows(residues: DataFrame) -> DataFrame:
    chain = W.partitionBy("name", "chain")
    ordered = chain.orderBy("resseq", "icode")
    # Places of chains and of numbers that residues share; only a chain's last row knows how many it has, so chains are summed from there.
    rows = residues.withColumns({
        "_next": F.lead("resseq").over(ordered),
        "_pos": F.col("resseq") - F.first("resseq").over(ordered) + 1 + F.row_number().over(ordered) - F.dense_rank().over(chain.orderBy("resseq")),
    })
    listed = W.partitionBy("name").orderBy(chain_rank(F.col("chain")), "chain")
    upto = listed.rangeBetween(W.unboundedPreceding, W.currentRow)
    length = F.when(F.col("_next").isNull(), F.col("_pos"))
    # Before the windows of the structure, so that rows still lie as the chain's windows left them.
    rows = rows.withColumn("_len", F.max(length).over(chain))
    rows = rows.withColumns({"chain_no": F.dense_rank().over(listed), "start": F.sum(F.coalesce(length, F.lit(0))).over(upto)})
    return _filled(rows.withColumn("start", F.col("start") - F.col("_len")), residues.columns, F.coalesce("_next", F.col("resseq") + 1))


def _filled(rows: DataFrame, columns: list[str], follows: Column) -> DataFrame:
    """A row for each number from a residue's to the next one's; rows: columns, _pos, chain_no, start."""
    each = rows.withColumn("_at", F.explode(F.sequence("resseq", F.greatest(F.col("resseq"), follows - 1))))
    own = F.col("_at") == F.col("resseq")
    return each.select(
        "name",
        "chain",
        F.col("_at").alias("resseq"),
        F.when(own, F.col("icode")).otherwise("").alias("icode"),
        *[F.when(own, F.col(c)).alias(c) for c in columns if c not in (*KEY, "aa")],
        F.when(own, F.col("aa")).otherwise("-").alias("aa"),
        (F.col("_pos") + F.col("_at") - F.col("resseq")).cast("int").alias("pos"),
        F.col("chain_no").cast("int").alias("chain_no"),
        F.col("start").cast("long").alias("start"),
    )


def _by_ranges(residues: DataFrame, width: int) -> DataFrame:
    """In two phases, so that a chain or structure of any size goes over many tasks: residues are ordered within ranges of ``width`` numbers; a table of a row for each range
    gives what the ranges before hold, where the next one begins, and the chains' lengths, and is joined back. A place is the number less the chain's
    least one, plus the further residues of equal numbers before. As residues are written in between, leave out columns not needed.
    """
    ranges = [*KEY[:2], "_range"]
    w = W.partitionBy(*ranges)
    here = residues.withColumn("_range", F.floor(F.col("resseq") / width))
    ordered = w.orderBy("resseq", "icode")
    extra = F.row_number().over(ordered) - F.dense_rank().over(w.orderBy("resseq"))
    rows = cut(here.withColumn("_next", F.lead("resseq").over(ordered)).withColumn("_extra", extra), "residues")
    held = rows.groupBy(*ranges).agg(F.min("resseq").alias("_first"), F.max("resseq").alias("_last"), F.max("_extra").alias("_more"))
    of = W.partitionBy("name", "chain").orderBy("_range")
    heads = held.select(
        *ranges,
        F.coalesce(F.sum("_more").over(of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lead("_first").over(of).alias("_follows"),
    )
    lengths = held.groupBy("name", "chain").agg(F.min("_first").alias("_least"), (F.max("_last") - F.min("_first") + 1 + F.sum("_more")).alias("len"))
    table = heads.join(chain_offsets(lengths), ["name", "chain"])
    joined = rows.join(table, ranges)
    pos = F.col("resseq") - F.col("_least") + 1 + F.col("_before") + F.col("_extra")
    return _filled(joined.withColumn("_pos", pos), residues.columns, F.coalesce("_next", "_follows", F.col("resseq") + 1))


def fill_gaps(residues: DataFrame) -> DataFrame:
    """Residues and the numbers without one, see placed."""
    return placed(residues).drop("pos", "chain_no", "start")


def _complete() -> Column:
    has = F.lit(True)
    for a in ATOMS:
        has = has & F.col(a.lower()).isNotNull()
    return has


def with_mask(residues: DataFrame) -> DataFrame:
    """mask: 1 if all four backbone atoms are there; missing coordinates become zero."""
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return residues.withColumn("mask", _complete().cast("int")).withColumns({f"{a.lower()}0": F.coalesce(a.lower(), zero) for a in ATOMS})


def chain_table(atoms: DataFrame, width: int = 256) -> DataFrame:
    """name, chain, seq, len, gaps filled, from atoms: letters of a range of ``width`` numbers are joined first, then the ranges of a chain."""
    gap = lambda last, first: F.repeat(F.lit("-"), F.greatest(F.coalesce(first - last, F.lit(1)) - 1, F.lit(0)).cast("int"))
    item = F.struct("resseq", "icode", "aa")
    rows = residues_from_atoms(atoms).groupBy("name", "chain", F.floor(F.col("resseq") / width).alias("_range")).agg(F.array_sort(F.collect_list(item)).alias("_r"))
    letters = F.transform("_r", lambda r, i: F.concat(r["aa"], gap(r["resseq"], F.get(F.col("_r"), i + 1)["resseq"])))
    parts = rows.select("name", "chain", F.struct(F.get("_r", F.lit(0))["resseq"].alias("first"), F.element_at("_r", -1)["resseq"].alias("last"), F.array_join(letters, "").alias("seq")).alias("_part"))
    chains = parts.groupBy("name", "chain").agg(F.array_sort(F.collect_list("_part")).alias("_p"))
    joined = F.transform("_p", lambda p, i: F.concat(p["seq"], gap(p["last"], F.get(F.col("_p"), i + 1)["first"])))
    return chains.select("name", "chain", F.array_join(joined, "").alias("seq")).withColumn("len", F.length("seq").cast("long"))


def residue_table(atoms: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Residues of all chains with gaps filled, places and masks; counted: see placed, by default the atoms."""
    # The mask is worked out before residues are placed: where it alone is needed, no coordinates are sorted.
    residues = residues_from_atoms(atoms).withColumn("_mask", _complete().cast("int"))
    rows = placed(residues, counted=atoms if counted is None else counted)
    return with_mask(rows).withColumn("mask", F.coalesce("_mask", F.lit(0))).drop("_mask")


def chain_sequences(residues: DataFrame) -> DataFrame:
    """name, chain, seq, len, from ordered letters."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "aa")))
    return (
        residues.groupBy("name", "chain")
        .agg(ordered.alias("s"))
        .select("name", "chain", F.array_join(F.transform("s", lambda r: r["aa"]), "").alias("seq"), F.size("s").cast("long").alias("len"))
    )


def complexes(chains: DataFrame, most_chains: int = 352) -> DataFrame:
    """name, num_of_chains, seq (chains as they are listed), length; complexes of more chains than letters go."""
    ordered = F.array_sort(F.collect_list(F.struct(chain_rank(F.col("chain")).alias("rank"), "chain", "seq")))
    per = chains.groupBy("name").agg(ordered.alias("c"), F.sum("len").alias("length"))
    return per.select(
        "name",
        F.size("c").cast("long").alias("num_of_chains"),
        F.array_join(F.transform("c", lambda c: c["seq"]), "").alias("seq"),
        "length",
    ).filter(F.col("num_of_chains") <= most_chains)


def distinct_chains(atoms: DataFrame) -> DataFrame:
    """Non-blank chains of each structure, over ATOM and HETATM."""
    return atoms.filter(F.trim("chain") != "").select("name", "chain").distinct()


def next_free_chain(atoms: DataFrame) -> DataFrame:
    """The letter after as many letters as the structure has chains; an error where there is none left."""
    counted = distinct_chains(atoms).groupBy("name").agg(F.count("*").alias("n_chains"))
    none = F.raise_error(F.concat(F.lit("no chain letter is left for "), "name")).cast("string")
    return counted.withColumn(
        "design_chain",
        F.when(F.col("n_chains") < len(CHAINS), F.substr(F.lit(CHAINS), (F.col("n_chains") + 1).cast("int"), F.lit(1))).otherwise(none),
    )


def chain_encoding(roles: DataFrame) -> DataFrame:
    """chain_no: 1, 2, ... designed chains first, each role in its own order."""
    return roles.withColumn(
        "chain_no",
        F.row_number().over(W.partitionBy("name").orderBy(F.when(F.col("role") == "designed", 0).otherwise(1), "list_pos", "chain")),
    )


def chain_offsets(chains: DataFrame, *order: str | Column) -> DataFrame:
    """chain_no and start (of the chain in the whole complex); by default chains are in the order in which they are listed."""
    w = W.partitionBy("name").orderBy(*(order or (chain_rank(F.col("chain")), "chain")))
    return chains.withColumn("chain_no", F.row_number().over(w)).withColumn(
        "start",
        F.coalesce(F.sum("len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    )


def residue_index(residues: DataFrame, offsets: DataFrame) -> DataFrame:
    """residue_idx: 100 * (chain_no - 1) + place in the complex from 0, so that chains aren't adjacent."""
    joined = residues.drop("chain_no", "start").join(offsets.select("name", "chain", "chain_no", "start"), ["name", "chain"])
    return joined.withColumn("global_pos", F.col("start") + F.col("pos") - 1).withColumn(
        "residue_idx",
        100 * (F.col("chain_no") - 1) + F.col("global_pos"),
    )


def with_index(residues: DataFrame) -> DataFrame:
    """chain_no, global_pos and residue_idx with chains as they are listed; residues of ``placed`` have chain_no and start already, for others they come from their chains' lengths."""
    if "start" not in residues.columns:
        return residue_index(residues, chain_offsets(residues.groupBy("name", "chain").agg(F.count("*").alias("len")))).drop("start")
    index = residues.withColumn("global_pos", F.col("start") + F.col("pos") - 1)
    return index.withColumn("residue_idx", 100 * (F.col("chain_no") - 1) + F.col("global_pos")).drop("start")


def adjacency_masks(indexed: DataFrame) -> DataFrame:
    """phi: a residue with the index before it comes before; psi, omega: one with the next index follows."""
    w = W.partitionBy("name").orderBy("global_pos")
    before = (F.lag("residue_idx").over(w) == F.col("residue_idx") - 1).cast("int")
    after = (F.lead("residue_idx").over(w) == F.col("residue_idx") + 1).cast("int")
    return indexed.withColumn("phi", F.coalesce(before, F.lit(0))).withColumn("psi", F.coalesce(after, F.lit(0))).withColumn("omega", F.col("psi"))


def backbone(atoms: DataFrame) -> DataFrame:
    """ATOM rows of N, CA, C and O."""
    return atoms.filter((F.col("record") == "ATOM") & F.col("atom").isin(*ATOMS))


def residue_runs(atoms: DataFrame, *parts: str) -> DataFrame:
    """run_id: grows whenever the residue number (without insertion code) changes from one line of the chain, or of its part by the columns parts, to the next."""
    w = W.partitionBy("name", "chain", *parts).orderBy("line_no")
    before = F.lag("resseq").over(w)
    new = F.when(before.isNull() | (before != F.col("resseq")), 1).otherwise(0)
    return atoms.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def thread_sequence(atoms: DataFrame, designs: DataFrame) -> DataFrame:
    """For each design (name, chain, sequence, and columns of its own that tell designs of a structure apart): the structure's ATOM rows with those
    columns, the k-th residue run of the design chain's backbone named by the k-th letter; side chains of that chain go, other chains stay.

    A chain longer than its sequence ends the output there: that line and all later ones of the structure go.
    """
    own = [c for c in designs.columns if c not in ("name", "chain", "sequence")]
    # Runs of the other lines of a chain are counted beside those of its backbone and left out, so that lines needn't be joined to their runs.
    part = (F.col("chain").isNotNull() & F.coalesce(F.col("atom").isin(*ATOMS), F.lit(False))).alias("_part")
    marked = residue_runs(atoms.filter("record = 'ATOM'").select(*atoms.columns, part), "_part").withColumn("run_id", F.when(F.col("_part"), F.col("run_id"))).drop("_part")
    begins = residue_runs(backbone(atoms)).groupBy("name", "chain", "run_id").agg(F.min("line_no").alias("_stop"))
    wanted = designs.select("name", F.col("chain").alias("_chain"), "sequence", *own)
    stops = wanted.withColumn("_run", F.length("sequence") + 1).join(
        begins.select("name", F.col("chain").alias("_chain"), F.col("run_id").alias("_run"), "_stop"),
        ["name", "_chain", "_run"],
        "left",
    )
    placed = marked.join(stops.hint("merge"), "name").filter(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop")))
    kept = placed.filter((F.col("chain") != F.col("_chain")) | F.col("run_id").isNotNull())
    letter = F.substr("sequence", F.col("run_id").cast("int"), F.lit(1))
    return kept.withColumn("res3", F.when(F.col("chain") == F.col("_chain"), to_three(letter)).otherwise(F.col("res3"))).select(*atoms.columns, *own)


def extend_complex(residues: DataFrame, lengths: DataFrame) -> DataFrame:
    """Receptor residues (name, chain_no, pos, aa, x, y, z) and placeholders at the origin, as many as lengths (name, len_binder) says, on a new chain."""
    last = residues.groupBy("name").agg(F.max("chain_no").alias("last"))
    binder = (
        lengths.filter("len_binder > 0")
        .join(last, "name")
        .select("name", (F.col("last") + 1).alias("chain_no"), F.explode(F.sequence(F.lit(1), F.col("len_binder").cast("int"))).alias("pos"))
    )
    zero = F.lit(0.0)
    return residues.select("name", "chain_no", "pos", "aa", "x", "y", "z").unionByName(
        binder.select("name", "chain_no", "pos", F.lit("A").alias("aa"), zero.alias("x"), zero.alias("y"), zero.alias("z"))
    )


def complex_lengths(residues: DataFrame) -> DataFrame:
    """Residues of the last chain (binder), of the others (receptor) and of all."""
    chains = residues.groupBy("name", "chain_no").agg(F.count("*").alias("_n"))
    whole = chains.groupBy("name").agg(F.sum("_n").alias("_all"), F.max_by("_n", "chain_no").alias("_last"))
    return whole.select("name", (F.col("_all") - F.col("_last")).alias("len_receptor"), F.col("_last").alias("len_binder"), F.col("_all").alias("len_complex"))


def receptor_selection(residues: DataFrame) -> DataFrame:
    """The residues that aren't of the last chain."""
    last = residues.groupBy("name").agg(F.max("chain_no").alias("_last"))
    return with_small(residues, last, by="pos").filter("chain_no <> _last").drop("_last")
