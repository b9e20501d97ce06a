"""Vectors made from a text by hashing, as column expressions: the same text has the same vector everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amino acids, one letter each, and their groups; a residue of two belongs to the first. Fixed values.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
GROUPS = {"hydrophobic": "AILMFWV", "polar": "STNQ", "positive": "KRH", "negative": "DE", "special": "CGP", "aromatic": "FYW"}


def unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def hash_vector(text: Column, dim: int, seed: int = 42) -> Column:
    """Unit vector of dim entries, each from the hash of the text and its place; the sum of four uniforms is near normal."""
    u = lambda i, k: F.pmod(F.xxhash64(text, i, F.lit(seed + k)), F.lit(1 << 24)) / float(1 << 24)
    return unit(F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: u(i, 0) + u(i, 1) + u(i, 2) + u(i, 3) - 2.0))


def valid_sequence(s: Column) -> Column:
    return F.coalesce(F.upper(s).rlike("^[ACDEFGHIKLMNPQRSTVWYX*]+$"), F.lit(False))


def sequence_vector(s: Column, dim: int = 64, seed: int = 42) -> Column:
    """hash_vector of a protein with twice the residues' shares on the first 20 entries and its length on the first."""
    up = F.upper(s)
    share = F.transform(F.array(*(F.lit(r) for r in RESIDUES)), lambda r: 2.0 * (F.length(up) - F.length(F.replace(up, r, F.lit("")))) / F.length(up))
    base = hash_vector(up, dim, seed)
    mixed = F.transform(base, lambda x, i: x + F.coalesce(F.get(share, i), F.lit(0.0)) + F.when(i == 0, F.log1p(F.length(up)) / 10).otherwise(0.0))
    return F.when(valid_sequence(s), unit(mixed))


def text_vector(text: Column, keywords: list[str], dim: int = 64, seed: int = 42) -> Column:
    """hash_vector of a text with one for each keyword that it holds on the first entries."""
    flags = F.transform(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.lower(text).contains(k).cast("double"))
    return unit(F.transform(hash_vector(F.lower(text), dim, seed), lambda x, i: x + F.coalesce(F.get(flags, i), F.lit(0.0))))


def residue_group(r: Column) -> Column:
    groups: dict[str, str] = {}
    for g, residues in GROUPS.items():
        for one in residues:
            groups.setdefault(one, g)
    return F.coalesce(F.create_map(*(F.lit(x) for pair in groups.items() for x in pair))[F.upper(r)], F.lit("other"))


def substitution_score(ref: Column, alt: Column) -> Column:
    """0 for the same residue, 0.3 inside a group, 0.7 where a charge is turned, 0.5 otherwise."""
    a, b = residue_group(ref), residue_group(alt)
    charged = a.isin("positive", "negative") & b.isin("positive", "negative")
    return F.when(F.upper(ref) == F.upper(alt), 0.0).when(a == b, 0.3).when(charged, 0.7).otherwise(0.5)


def context_vector(gene: Column, cell_type: Column, dim: int, seed: int = 42) -> Column:
    """hash_vector of a gene in a cell type: another vector in each."""
    return hash_vector(F.concat_ws("_", F.upper(gene), cell_type), dim, seed)


def normal_id(gene: Column) -> Column:
    """Trimmed; identifiers that begin with ENSG or ENSP stay, all others become upper case."""
    t = F.trim(gene)
    return F.when(t.rlike("^ENS[GP]"), t).otherwise(F.upper(t))


def variant_effects(sequence: Column, variants: Column) -> Column:
    """position, ref, alt, score of those variants (position from 1, ref, alt) whose residue the sequence has there."""
    fits = F.filter(variants, lambda v: (v["position"] >= 1) & (F.upper(F.substring(sequence, v["position"], F.lit(1))) == F.upper(v["ref"])))
    return F.transform(fits, lambda v: F.struct(v["position"].alias("position"), v["ref"].alias("ref"), v["alt"].alias("alt"), substitution_score(v["ref"], v["alt"]).alias("score")))
