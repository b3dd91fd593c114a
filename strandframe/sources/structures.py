"""Structure files: fixed-width atom lines in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_structures(spark: SparkSession, paths: str | list[str], glob: str = "*.pdb") -> DataFrame:
    """name, line_no, line of all files, in file order; name is the file's name without its ending, or the value of a ``name=`` folder.

    Each file is one row at first, so order is kept; a structure file, or one of constraints or designs of a structure, is small.
    """
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(paths, wholetext=True)
    path = F.col("_metadata.file_path")
    folder = F.url_decode(F.regexp_extract(path, "/name=([^/]+)/[^/]*$", 1))
    base = F.url_decode(F.regexp_extract(path, "([^/]+)\\.[^./]*$", 1))
    named = files.select(F.when(folder != "", folder).otherwise(base).alias("name"), "value")
    lines = named.select("name", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.select("name", "line_no", F.rtrim(F.regexp_replace("line", "\r$", "")).alias("line"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column name, out of an explode, so that filters on it aren't pushed below, where each of their terms would work it out anew."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def normalize_mse(lines: DataFrame) -> DataFrame:
    """Selenomethionine HETATM lines become ATOM lines of MET."""
    line = F.col("line")
    is_mse = line.startswith("HETATM") & (F.substring(line, 18, 3) == "MSE")
    made = F.when(is_mse, F.replace(F.replace(line, F.lit("HETATM"), F.lit("ATOM  ")), F.lit("MSE"), F.lit("MET"))).otherwise(line)
    return _once(lines, "line", made).select(*lines.columns)


def split_insertion_code(text: Column) -> tuple[Column, Column]:
    """'52A' to (51, 'A'), '52' to (51, ''): the number less one, and the letter at the end. Text that is more than a number and a letter takes patterns, which cost ten times as much."""
    last = F.substring(text, -1, 1)
    code = F.ascii(last)
    letter = code.between(65, 90) | code.between(97, 122)
    rest = F.when(letter, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    number = F.when(~rest.contains("."), rest.try_cast("int"))
    icode = F.when(letter, last).when(code.between(33, 126), "").otherwise(F.regexp_extract(text, "[A-Za-z]$", 0))
    return F.coalesce(number, F.regexp_extract(text, "-?[0-9]+", 0).try_cast("int")) - 1, icode


def parse_atoms(lines: DataFrame, records: tuple[str, ...] = ("ATOM",)) -> DataFrame:
    """Columns of the atom lines (those that begin with one of records), cut at their fixed places. resseq is the residue number less one.

    Lines without a residue number or coordinates aren't atoms; rejected_atoms lists them.
    """
    return _atoms(lines, records).filter(F.col("resseq").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())


def rejected_atoms(lines: DataFrame, records: tuple[str, ...] = ("ATOM",)) -> DataFrame:
    """name, line_no of the atom lines whose residue number or coordinates are no numbers."""
    return (
        _atoms(lines, records)
        .filter(F.col("resseq").isNull() | F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull())
        .select("name", "line_no")
    )


def _atoms(lines: DataFrame, records: tuple[str, ...]) -> DataFrame:
    cut = lambda at, n: F.substring("line", at, n)
    record = F.lit(None).cast("string")
    for r in records:
        record = F.when(F.col("line").startswith(r), F.lit(r)).otherwise(record)
    found = lines.withColumn("record", record).filter("record IS NOT NULL")
    resseq, icode = split_insertion_code(F.trim(cut(23, 5)))
    # Callers filter on the numbers.
    numbers = F.struct(resseq.alias("resseq"), *[cut(at, 8).try_cast("double").alias(c) for at, c in ((31, "x"), (39, "y"), (47, "z"))])
    return _once(found.select("name", "line_no", "record", "line"), "_n", numbers).select(
        "name", "line_no", "record", F.trim(cut(13, 4)).alias("atom"), F.trim(cut(17, 1)).alias("altloc"), F.trim(cut(18, 3)).alias("res3"), cut(22, 1).alias("chain"),
        "_n.resseq", icode.alias("icode"), "_n.x", "_n.y", "_n.z", F.trim(cut(77, 2)).alias("element"),
    )


def chain_subset(atoms: DataFrame, chains: list[str] | None) -> DataFrame:
    """Atoms (or lines) of the chains asked for; None: all. Over containers.scan the reader applies it."""
    return atoms if chains is None else atoms.filter(F.col("chain").isin(*chains))


def _plain(x: Column) -> Column:
    """%8.3f of what fits, else null."""
    negative = F.when(x == 0, x.cast("string").startswith("-")).otherwise(x < 0)  # -0.0 as well
    # A number of three decimals is that many thousandths, whose digits need no decimal.
    thousandths, whole = F.rint(F.abs(x) * 1000), F.floor(F.abs(x))
    digits = F.when(
        thousandths / 1000.0 == F.abs(x),
        F.concat(whole.cast("string"), F.lit("."), F.substring((thousandths.cast("long") - whole * 1000 + 1000).cast("string"), 2, 3)),
    ).otherwise(F.abs(x).cast("decimal(18,3)").cast("string"))
    return F.when(F.abs(x) < 999, F.lpad(F.concat(F.when(negative, "-").otherwise(""), digits), 8, " "))


def render_atoms(atoms: DataFrame) -> DataFrame:
    """name, line_no, line: each atom as a fixed-width line; the residue number is resseq plus one.

    Columns that fit their places are padded; a line with any other is formatted, which takes many times as long. The line comes out of an explode, which filters on it
    don't go below: pushed into a projection they would render it anew for each of their terms.
    """
    # Atom names of up to three letters begin in the second place.
    atom = F.when(F.length("atom") < 4, F.concat(F.lit(" "), F.col("atom"))).otherwise(F.col("atom"))
    number, icode = F.col("resseq") + 1, F.when(F.col("icode") == "", " ").otherwise(F.col("icode"))
    ready = atoms.select(
        "name", "line_no", "record", atom.alias("atom"), "res3", "chain", number.cast("int").alias("number"), icode.alias("icode"), "element", (F.col("line_no") % 100000).cast("int").alias("_no"),
        *[F.col(c).cast("double").alias(c) for c in "xyz"], *[_plain(F.col(c).cast("double")).alias("_" + c) for c in "xyz"],
    )
    fits = (F.length("record") <= 6) & (F.length("atom") <= 4) & (F.length("res3") <= 3) & (F.length("chain") <= 1) & (F.length("icode") <= 1) & (F.length("element") <= 2) & F.col("number").between(-999, 9999) & (F.col("_no") >= 0)
    padded = F.concat(
        F.rpad("record", 6, " "), F.lpad(F.col("_no").cast("string"), 5, " "), F.lit(" "), F.rpad("atom", 4, " "), F.lit(" "), F.lpad("res3", 3, " "), F.lit(" "), F.lpad("chain", 1, " "),
        F.lpad(F.col("number").cast("string"), 4, " "), F.lpad("icode", 1, " "), F.lit("   "), "_x", "_y", "_z", F.lit("  1.00  0.00          "), F.lpad("element", 2, " "),
    )
    whole = F.format_string(
        "%-6s%5d %-4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", "record", "_no", "atom", "res3", "chain", "number", "icode", "x", "y", "z", F.lit(1.0), F.lit(0.0), "element"
    )
    return _once(ready, "line", F.coalesce(F.when(fits, padded), whole)).select("name", "line_no", "line")


def write_structures(lines: DataFrame, path: str) -> None:
    """One folder for each name, its lines in order: for tools that want a file a structure. Many structures are written by containers.write."""
    lines.repartition("name").sortWithinPartitions("name", "line_no").select("name", "line").write.partitionBy("name").text(path)


def drop_hydrogens(lines: DataFrame) -> DataFrame:
    """Atom lines whose element isn't H; all other lines go."""
    return lines.filter(F.trim(F.substring("line", 1, 6)).isin("ATOM", "HETATM") & (F.trim(F.substring("line", 77, 2)) != "H"))


def select_backbone(lines: DataFrame, design_chain: Column | str) -> DataFrame:
    """On the design chain N, CA, C, O only; of other chains every ATOM; TER and lines of at most 21 characters stay."""
    chain = F.lit(design_chain) if isinstance(design_chain, str) else design_chain
    record, own = F.trim(F.substring("line", 1, 6)), F.substring("line", 22, 1) == chain
    backbone = F.trim(F.substring("line", 13, 4)).isin("N", "CA", "C", "O")
    return lines.filter((record == "TER") | (F.length("line") <= 21) | ((record == "ATOM") & (~own | backbone)))
