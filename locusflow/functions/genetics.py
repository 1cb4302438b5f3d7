"""Column functions of population genetics. All are built from SQL expressions and stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Why a record is left out, in the order in which the reasons are tried.
SKIPS = ("non_autosomal", "not_biallelic_snp", "site_filter")
CATEGORIES = ("missing", "unsupported", "filtered", "called")
COUNTS = ("called", "heterozygous", "alt_alleles", "missing", "quality_filtered", "unsupported_ploidy")

# SAM flag bits (fixed values).
PAIRED, PROPER, UNMAPPED, REVERSE, FIRST, SECOND = 1, 2, 4, 16, 64, 128
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 256, 512, 1024, 2048


# ---- sites


def is_autosome(contig: Column) -> Column:
    """Exactly 1 to 22, with or without ``chr`` in front; nothing is normalised."""
    return contig.rlike("^(chr)?([1-9]|1[0-9]|2[0-2])$")


def is_biallelic_snp(ref: Column, alts: Column) -> Column:
    """One alternative, both single upper-case bases, and different."""
    alt = F.get(alts, F.lit(0))
    return (F.size(alts) == 1) & ref.rlike("^[ACGT]$") & F.coalesce(alt.rlike("^[ACGT]$"), F.lit(False)) & (ref != alt)


def passes_filters(filters: Column) -> Column:
    """No filter, or every one of them PASS (or a dot)."""
    return F.forall(filters, lambda x: x.isin("PASS", "."))


def skip_reason(contig: Column, ref: Column, alts: Column, filters: Column) -> Column:
    """The first reason for which a record isn't eligible; null if it is."""
    return (
        F.when(~is_autosome(contig), SKIPS[0])
        .when(~F.coalesce(is_biallelic_snp(ref, alts), F.lit(False)), SKIPS[1])
        .when(~passes_filters(filters), SKIPS[2])
    )


def strip_chr(contig: Column) -> Column:
    return F.regexp_replace(contig, "^chr", "")


def variant_id(contig: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", strip_chr(contig), pos.cast("string"), ref, alt)


# ---- genotypes


def decode_gt(gt: Column) -> Column:
    """Alleles of a genotype's text as integers, null where missing."""
    return F.transform(F.split(gt, "[/|]"), lambda x: x.try_cast("int"))


def is_phased(gt: Column) -> Column:
    return F.contains(gt, F.lit("|"))


def category(alleles: Column, dp: Column, gq: Column, min_dp: int = 0, min_gq: int = 0) -> Column:
    """Missing, then unsupported ploidy, then filtered, then called.

    Thresholds are inclusive, an absent value fails one that is on, and 0 turns one off: it isn't even part of the plan.
    """
    return category_of(alleles.isNull() | F.exists(alleles, lambda x: x.isNull()), F.size(alleles) == 2, dp, gq, min_dp, min_gq)


def category_of(missing: Column, diploid: Column, dp: Column, gq: Column, min_dp: int = 0, min_gq: int = 0) -> Column:
    """:func:`category` of a call of which is known whether an allele is missing and whether there are two."""
    out = F.when(missing, CATEGORIES[0]).when(~diploid, CATEGORIES[1])
    for value, least in ((dp, min_dp), (gq, min_gq)):
        if least:
            out = out.when(~F.coalesce(value >= least, F.lit(False)), CATEGORIES[2])
    return out.otherwise(CATEGORIES[3])


def dosage(alleles: Column) -> Column:
    """The number of alternative alleles; null if any allele is missing."""
    return F.aggregate(alleles, F.lit(0), lambda s, x: s + x)


def unphased(gt: Column) -> Column:
    """The genotype's text with ordered alleles and without phase."""
    return F.array_join(F.array_sort(F.split(F.regexp_replace(gt, r"\|", "/"), "/")), "/")


def count_columns(cat: Column, alleles: Column | None = None, dose: Column | None = None) -> list[Column]:
    """The additive counts of one call, as sums to be grouped in any way. ``dose``: what :func:`dosage` gives, if it is known."""
    called = cat == CATEGORIES[3]
    dose = dosage(alleles) if dose is None else dose
    terms = (called, called & (dose == 1), None, cat == CATEGORIES[0], cat == CATEGORIES[2], cat == CATEGORIES[1])
    return [F.coalesce(F.sum(F.when(called, dose) if t is None else F.when(t, 1)), F.lit(0)).cast("long").alias(n) for n, t in zip(COUNTS, terms, strict=True)]


# ---- ratios and text


def ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def alt_frequency(alt_alleles: Column, called: Column) -> Column:
    return ratio(alt_alleles, 2 * called)


def expected_heterozygosity(alt_alleles: Column, called: Column) -> Column:
    p = alt_frequency(alt_alleles, called)
    return 2 * p * (1 - p)


def number_text(value: Column) -> Column:
    """Twelve significant digits without trailing zeros; NA for null."""
    text = F.format_string("%.12g", value)
    text = F.when(value == 0, F.lit("0")).otherwise(text)
    text = F.regexp_replace(text, r"(\.[0-9]*?)0+(e|$)", "$1$2")
    return F.when(value.isNull(), "NA").otherwise(F.regexp_replace(text, r"\.(e|$)", "$1"))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


def standardised(dose: Column, p: Column) -> Column:
    """(g - 2p) / sqrt(2p(1 - p)); 0 for a missing dosage."""
    return F.coalesce((dose - 2 * p) / F.sqrt(2 * p * (1 - p)), F.lit(0.0))


# ---- alignments and reads


def usable_alignment(flag: Column) -> Column:
    """A proper pair that is mapped, primary, not failed and no duplicate."""
    bad = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE | SUPPLEMENTARY
    return (flag.bitwiseAND(PROPER) == PROPER) & (flag.bitwiseAND(bad) == 0)


def primary_alignment(flag: Column) -> Column:
    return flag.bitwiseAND(SECONDARY | SUPPLEMENTARY) == 0


def aligned_places(cigar: Column, length: Column) -> Column:
    """For each base of a read how far behind the alignment's first base it lies; null where it isn't aligned.

    A CIGAR that is null, ``*`` or one run of matches takes no work.
    """
    plain = cigar.isNull() | cigar.rlike(r"^(\*|[0-9]+[M=X])$")
    runs = F.arrays_zip(F.transform(F.regexp_extract_all(cigar, F.lit(r"([0-9]+)[MIDNSHP=X]"), 1), lambda n: n.cast("int")).alias("n"), F.regexp_extract_all(cigar, F.lit(r"[0-9]+([MIDNSHP=X])"), 1).alias("op"))
    nothing = F.array().cast("array<int>")

    def step(state: Column, run: Column) -> Column:
        n, op, at = run["n"], run["op"], state["at"]
        aligned, inside, skipped = op.isin("M", "=", "X"), op.isin("I", "S"), op.isin("D", "N")
        more = F.when((n > 0) & aligned, F.sequence(at, at + n - 1)).when((n > 0) & inside, F.array_repeat(F.lit(None).cast("int"), n)).otherwise(nothing)
        return F.struct(F.when(aligned | skipped, at + n).otherwise(at).alias("at"), F.concat(state["places"], more).alias("places"))

    walked = F.aggregate(runs, F.struct(F.lit(0).alias("at"), nothing.alias("places")), step, lambda s: s["places"])
    return F.when(plain, F.sequence(F.lit(0), length - 1)).otherwise(walked)


def qualities(text: Column) -> Column:
    """Phred scores of a quality string with offset 33."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - 33)


def read_passes(quals: Column, length: Column, min_length: int = 35, qualified: int = 20, unqualified_percent: int = 40) -> Column:
    """Long enough, and at most so many percent of the bases below the quality."""
    return (length >= min_length) & (F.size(F.filter(quals, lambda q: q < qualified)) * 100 <= unqualified_percent * length)


def low_bases(text: Column, qualified: int = 20) -> Column:
    """Bases of a quality string (offset 33) below the quality, counted without splitting the string."""
    # Codes of the characters, so that none of them means anything to the pattern.
    return F.length(F.regexp_replace(text, rf"[^\x21-\x{32 + qualified:02x}]", "")) if qualified > 0 else F.lit(0)


def passes_quality(length: Column, low: Column, min_length: int = 35, unqualified_percent: int = 40) -> Column:
    """As :func:`read_passes`, from the counts."""
    return (length >= min_length) & (low * 100 <= unqualified_percent * length)


# ---- hashing of the synthetic call set


def mixed32(x: Column) -> Column:
    """A 32-bit mixer in 64-bit arithmetic: products are split so that they never leave 63 bits."""

    def times(v: Column, k: int) -> Column:
        low = v.bitwiseAND(0xFFFF) * k
        high = F.shiftright(v, 16) * (k & 0xFFFF)
        return (low + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)

    x = x.bitwiseAND(0xFFFFFFFF)
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = times(x, 0x7FEB352D)
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = times(x, 0x846CA68B)
    return x.bitwiseXOR(F.shiftright(x, 16))


def synthetic_code(sample: Column, site: Column) -> Column:
    """0 to 99 for a (sample, site): 0 missing, below 50 hom ref, below 85 het, else hom alt."""
    x = (sample * 0x9E3779B9 + site * 0x85EBCA6B + 17).bitwiseAND(0xFFFFFFFF)
    return mixed32(x) % 100


# ---- places in files


def fasta_offset(pos: Column, offset: Column, line_bases: Column, line_bytes: Column) -> Column:
    """The byte of a FASTA file at which a 0-based base of a contig stands, by the contig's index entry."""
    return offset + F.floor(pos / line_bases) * line_bytes + pos % line_bases


def fasta_bytes(length: Column, line_bases: Column, line_bytes: Column) -> Column:
    """Bytes from a contig's first base to its last, line ends between them included; 0 for an empty one."""
    last = length - 1
    return F.when(length > 0, fasta_offset(last, F.lit(0), line_bases, line_bytes) + 1).otherwise(0)


def next_random(state: Column) -> Column:
    """The next state of the 32-bit linear congruential generator that described fixtures are drawn with."""
    return (state * 1664525 + 1013904223).bitwiseAND(0xFFFFFFFF)
