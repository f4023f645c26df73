"""Column expressions of the annotation chain and the weights of variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Consequences that count as loss of function.
LOSS_OF_FUNCTION = ["splice_acceptor_variant", "splice_donor_variant", "frameshift_variant", "stop_gained", "stop_lost", "start_lost"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_variant(c: Column | str) -> dict[str, Column]:
    """chrom, pos, ref, alt of ``chr:pos:ref>alt``."""
    parts = F.split(col(c), "[:>]")
    return {"chrom": parts[0], "pos": parts[1].cast("long"), "ref": parts[2], "alt": parts[3]}


def parse_name(c: Column | str) -> dict[str, Column]:
    """chrom, pos, ref, alt of ``chrom_pos_ref/alt``."""
    parts = F.split(F.translate(col(c), "_/", "::"), ":")
    return {"chrom": parts[0], "pos": parts[1].cast("long"), "ref": parts[2], "alt": parts[3]}


def splice_delta(c: Column | str) -> Column:
    """The largest of the second to fifth of the values between bars; null if all are missing."""
    values = F.filter(F.slice(F.split(col(c), r"\|"), 2, 4), lambda v: ~v.isin("-", "nan", ""))
    return F.array_max(F.transform(values, lambda v: v.cast("double")))


def consequence_flags(c: Column | str, names: list[str], prefix: str = "Consequence_") -> dict[str, Column]:
    """A 0/1 column for each name: whether the comma list holds it."""
    listed = F.split(col(c), ",")
    return {f"{prefix}{n}": F.coalesce(F.array_contains(listed, n), F.lit(False)).cast("double") for n in names}


def normal_chrom(c: Column | str) -> Column:
    return F.concat(F.lit("chr"), F.regexp_replace(col(c), "^.*chr", ""))


def strip_version(c: Column | str) -> Column:
    return F.split(col(c), r"\.")[0]


def is_plof(columns: list[str]) -> Column:
    """1 if any of the consequence flags is 1."""
    flags = [F.coalesce(F.col(c), F.lit(0)) for c in columns]
    return ((F.greatest(*flags) if len(flags) > 1 else flags[0]) == 1).cast("int")


def maf(af: Column | str) -> Column:
    return F.least(col(af), 1 - col(af))


def maf_mb(af: Column | str) -> Column:
    """Madsen-Browning weight."""
    return F.pow(col(af) * (1 - col(af)) + 1e-8, -0.5)


def beta_weight(m: Column | str, b: int = 25) -> Column:
    """Density of Beta(1, b)."""
    return b * F.pow(1 - col(m), b - 1)


def sift_polyphen_weight(sift: Column | str, polyphen: Column | str) -> Column:
    return (1 - col(sift) + col(polyphen)) / 2


def variant_weight(weight: Column, plof: Column | str) -> Column:
    """The weight, 1 for loss of function."""
    return F.when(col(plof) == 1, 1.0).otherwise(weight)


def kept_weight(weight: Column, bound: float = 0.0) -> Column:
    """Square root of weights above the bound, null else (0.8 for SIFT/PolyPhen weights)."""
    return F.when(weight > bound, F.sqrt(weight))


def homozygotes_once(gt: Column | str, flag: bool = True) -> Column:
    return F.when(col(gt) == 2, 1).otherwise(col(gt)) if flag else col(gt)


def replaced(c: Column | str, old, new) -> Column:
    return F.when(col(c) == old, new).otherwise(col(c))


def minus_log10(p: Column | str) -> Column:
    return -F.log10(col(p))


def from_log10(p: Column | str) -> Column:
    return F.pow(F.lit(10.0), -col(p))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def display(c: Column | str, names: dict[str, str]) -> Column:
    """The mapped name, or the value with spaces for underscores."""
    mapped = F.create_map(*[F.lit(v) for kv in sorted(names.items()) for v in kv])[col(c)] if names else F.lit(None).cast("string")
    return F.coalesce(mapped, F.regexp_replace(col(c), "_", " "))


def repeat_of(c: Column | str) -> Column:
    """The number after the last underscore."""
    return F.regexp_extract(col(c), r"_(\d+)[^_]*$", 1).cast("int")


def method_of(path: Column | str) -> Column:
    """The fourth and third last part of a path, joined by a dash; null for a shorter path."""
    parts = F.split(col(path), "/")
    return F.when(F.size(parts) >= 4, F.concat_ws("-", F.try_element_at(parts, F.lit(-4)), F.try_element_at(parts, F.lit(-3))))


def dosage(gt: Column | str) -> Column:
    """Alternative alleles of ``a/b`` or ``a|b``; null if one is missing."""
    alleles = F.split(col(gt), r"[/|]")
    return F.aggregate(F.transform(alleles, lambda a: F.when(a == ".", None).otherwise(a.cast("int"))), F.lit(0), lambda s, a: s + a)


def remove_prefix(c: Column | str, prefix: str) -> Column:
    return F.when(F.startswith(col(c), F.lit(prefix)), F.substr(col(c), F.lit(len(prefix) + 1))).otherwise(col(c))


def one_hot(seq: Column | str, seed: int | None = None) -> Column:
    """A row (A, C, G, T) for each base; other letters are zeros, or with a seed a base drawn by a hash of the place."""
    bases = F.split(F.upper(col(seq)), "(?<=.)(?=.)")

    def row(ch: Column, i: Column) -> Column:
        drawn = F.element_at(F.array(*map(F.lit, "ACGT")), (F.pmod(F.xxhash64(F.lit(seed), col(seq), i), F.lit(4)) + 1).cast("int")) if seed is not None else F.lit("N")
        base = F.when(ch.isin(*"ACGT"), ch).otherwise(drawn)
        return F.array(*[(base == b).cast("int") for b in "ACGT"])

    return F.transform(bases, row)


def substituted(seq: Column | str, alt: Column | str, strand: Column | str) -> Column:
    """The sequence with a single-base alternative as the last base of its first half (on the minus strand, the one after it); null for other alternatives."""
    middle = (F.length(col(seq)) / 2).cast("int") + F.when(col(strand) == "-", 1).otherwise(0)
    return F.when(F.length(col(alt)) == 1, F.overlay(col(seq), col(alt), middle))
