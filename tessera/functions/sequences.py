"""DNA text functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: bases and their complements (U reads as T), case kept
BASES = "ACGTUNacgtun"
COMPLEMENTS = "TGCAANtgcaan"

# fixed values: restriction site (both strands) and the cloning context around a guide
RESTRICTION_SITES = ("CGTCTC", "GAGACG")
CLONING_LEFT, CLONING_RIGHT = "CACCG", "GTTT"


def reverse_complement(seq: Column) -> Column:
    """Unknown letters raise."""
    known = seq.rlike(f"^[{BASES}]*$")
    flipped = F.translate(F.reverse(seq), BASES, COMPLEMENTS)
    bad = F.raise_error(F.concat(F.lit("not a DNA sequence: "), seq)).cast("string")
    return F.when(seq.isNull(), None).when(known, flipped).otherwise(bad)


def has_homopolymer(seq: Column, n: int) -> Column:
    return seq.rlike("|".join(f"{b}{{{n}}}" for b in "ATGC"))


def has_restriction_site(seq: Column) -> Column:
    cloned = F.concat(F.lit(CLONING_LEFT), F.upper(seq), F.lit(CLONING_RIGHT))
    return F.contains(cloned, F.lit(RESTRICTION_SITES[0])) | F.contains(cloned, F.lit(RESTRICTION_SITES[1]))
