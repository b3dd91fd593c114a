"""Residue letters: three-letter names, parse order, model order."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two letter orders, and three-letter names in parse order.
PARSE_ORDER = "ARNDCQEGHILKMFPSTWYV-"
MODEL_ORDER = "ACDEFGHIKLMNPQRSTVWYX"
THREE = ["ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL"]

LETTER_OF = dict(zip(THREE, PARSE_ORDER, strict=False))
#: Chain letters in the order in which chains are listed.
CHAINS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _lookup(pairs: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain(*pairs.items())])[key], F.lit(other))


def to_letter(res3: Column) -> Column:
    """ALA to A; unknown names to -."""
    return _lookup(LETTER_OF, res3, "-")


def to_three(letter: Column) -> Column:
    """A to ALA; unknown letters to UNK."""
    return _lookup({v: k for k, v in LETTER_OF.items()}, letter, "UNK")


def to_index(letter: Column) -> Column:
    """Place in the model's order, from 0; unknown letters count as X."""
    at = F.instr(F.lit(MODEL_ORDER), letter)
    return F.when((at > 0) & (F.length(letter) == 1), at - 1).otherwise(20)


def chain_rank(chain: Column) -> Column:
    """The order in which chains are listed: A-Z, a-z, then numbers by value, then any other name."""
    one = F.instr(F.lit(CHAINS), chain)
    return F.when((one > 0) & (F.length(chain) == 1), one - 1).otherwise(
        F.coalesce(len(CHAINS) + F.when(chain.rlike("^[0-9]+$"), chain.try_cast("int")), F.lit(2**31 - 1))
    )


def gap_to_unknown(seq: Column) -> Column:
    return F.translate(seq, "-", "X")


def letters(seq: Column) -> Column:
    """Array of a sequence's letters."""
    return F.filter(F.split(seq, ""), lambda c: c != "")
