"""Codons, amino acids and tuples of them, as Column expressions. Tuples are strings joined by an underscore."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, bases in the order T, C, A, G at each place; * ends a protein.
BASES, CODE = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
MISSING, UNKNOWN, UNKNOWN_AA = "---", "ZZZ", "X"
#: Secondary-structure letters and their classes; the rest have none.
SS_CLASSES = {"E": "SHEET", "H": "HELIX", "T": "TURN", "G": "OTHER", "I": "OTHER", "S": "OTHER", "B": "OTHER"}


def codon_table() -> dict[str, str]:
    """Amino acid of each of the 61 codons."""
    triples = [a + b + c for a in BASES for b in BASES for c in BASES]
    return {t: aa for t, aa in zip(triples, CODE, strict=True) if aa != "*"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def codon_to_aac(codon: Column | str) -> Column:
    """``A-GCT`` for GCT; null for what is no codon."""
    codon = F.upper(F.col(codon) if isinstance(codon, str) else codon)
    return F.concat_ws("-", F.when(_lookup(codon_table(), codon).isNotNull(), _lookup(codon_table(), codon)), F.when(_lookup(codon_table(), codon).isNotNull(), codon))


def consolidate_ss(letter: Column | str) -> Column:
    letter = F.col(letter) if isinstance(letter, str) else letter
    return _lookup(SS_CLASSES, letter)


def aac_aa(aac: Column | str) -> Column:
    return F.split_part(F.col(aac) if isinstance(aac, str) else aac, F.lit("-"), F.lit(1))


def aac_codon(aac: Column | str) -> Column:
    return F.split_part(F.col(aac) if isinstance(aac, str) else aac, F.lit("-"), F.lit(2))


def tuple_items(t: Column | str) -> Column:
    return F.split(F.col(t) if isinstance(t, str) else t, "_")


def tuple_name(items: Column) -> Column:
    return F.array_join(items, "_")


def tuple_to_aas(t: Column | str) -> Column:
    """``A_R`` for ``A-GCT_R-CGT``."""
    return tuple_name(F.transform(tuple_items(t), lambda x: F.split_part(x, F.lit("-"), F.lit(1))))


def is_synonymous(t1: Column | str, t2: Column | str) -> Column:
    """Whether two tuples code for the same amino acids."""
    return tuple_to_aas(t1) == tuple_to_aas(t2)


def group_codon(aac: Column | str, by: str) -> Column:
    """``any``: ``A-*``; ``last_nucleotide``: ``A-*T`` for A-GCT."""
    return F.concat(aac_aa(aac), F.lit("-*"), F.lit("") if by == "any" else F.substring(aac_codon(aac), -1, 1))


def group_tuple(t: Column | str, position: int, by: str) -> Column:
    """A tuple with one of its codons grouped across amino acids: ``*`` (by ``any``), or ``*T`` for A-GCT (by
    ``last_nucleotide``). position: from 0, or from -1 backwards."""
    items = tuple_items(t)
    at = F.size(items) + position if position < 0 else F.lit(position)
    grouped = F.lit("*") if by == "any" else None
    star = lambda x: grouped if grouped is not None else F.concat(F.lit("*"), F.substring(aac_codon(x), -1, 1))
    return tuple_name(F.transform(items, lambda x, i: F.when(i == at, star(x)).otherwise(x)))


def split_id(pdb_id: Column | str) -> list[Column]:
    """base, chain and entity of ``1ABC:A`` or ``1ABC:1``; anything else is an error."""
    x = F.upper(F.col(pdb_id) if isinstance(pdb_id, str) else pdb_id)
    pattern = r"^([0-9][A-Z0-9]{3})(?::(?:([A-Z]{1,3})|([0-9]{1,2})))?$"
    part = lambda k: F.when(x.rlike(pattern), F.nullif(F.regexp_extract(x, pattern, k), F.lit(""))).otherwise(F.raise_error(F.concat(F.lit("no structure id: "), x)))
    return [part(1).alias("base_id"), part(2).alias("chain_id"), part(3).alias("entity_id")]


def format_contact(chain: str, res: str, idx: str, dist: str, altloc: str | None = None, atom: str | None = None) -> Column:
    """``A:K:87:3.21``, with ``:altloc`` before and ``@atom`` after the place where given."""
    place = F.concat_ws(":", F.col(chain), F.col(res), F.col(idx).cast("string"), *([F.col(altloc)] if altloc else []))
    return F.concat(place, *([F.lit("@"), F.col(atom)] if atom else []), F.lit(":"), F.format_string("%.2f", F.col(dist)))


def parse_contact(text: Column | str) -> list[Column]:
    x = F.col(text) if isinstance(text, str) else text
    pattern = r"^([^:]*):([^:]*):(-?\d+)(?::([^:@]*))?(?:@([^:]*))?:([0-9.]+)$"
    get = lambda k: F.nullif(F.regexp_extract(x, pattern, k), F.lit(""))
    return [get(1).alias("chain"), get(2).alias("res"), get(3).cast("int").alias("idx"), get(4).alias("altloc"), get(5).alias("atom"), get(6).cast("double").alias("dist")]


def match_type(same_struct: Column, same_protein: Column, same_aa: Column, same_codon: Column) -> Column:
    """How a matched residue relates to the reference; null (no match) for the same protein and residue, other codon."""
    return (
        F.when(same_struct, "REFERENCE")
        .when(same_protein & same_aa & same_codon, "VARIANT")
        .when(same_protein & same_aa, F.lit(None))
        .when(same_protein, "ALTERATION")
        .when(same_aa & same_codon, "SAME")
        .when(same_aa, "SILENT")
        .otherwise("MUTATION")
    )
