"""Paired reads: checks, quality filter, duplicates, pileup and calls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions import genetics as g
from locusflow.session import prepare_workers

MAX_DEPTH = 250


def pair_problems(reads: DataFrame) -> DataFrame:
    """(ordinal, problem) of pairs that break a rule. reads: ordinal, mate (1 or 2), name, seq, qual.

    The mates of an ordinal are put side by side by one grouped aggregate; a missing mate and different names show there.
    """
    mate = lambda k, c: F.max(F.when(F.col("mate") == k, F.col(c)))
    suffix = lambda c, k: F.regexp_replace(F.regexp_extract(F.col(c), r"^(\S*)", 1), f"/{k}$", "")
    pairs = reads.groupBy("ordinal").agg(F.count("*").alias("n"), *(mate(k, c).alias(f"{c}{k}") for k in (1, 2) for c in ("name", "seq", "qual")))
    bad_seq = lambda k: ~F.coalesce(F.col(f"seq{k}").rlike("^[ACGTNacgtn]+$"), F.lit(False))
    bad_qual = lambda k: F.length(f"seq{k}") != F.length(f"qual{k}")
    range_ = lambda k: ~F.coalesce(F.col(f"qual{k}").rlike("^[!-~]*$"), F.lit(False))
    problem = (
        F.when(F.col("n") != 2, "mates")
        .when(F.col("name1").isNull() | F.col("name2").isNull(), "mates")
        .when(suffix("name1", 1) != suffix("name2", 2), "names")
        .when(bad_seq(1) | bad_seq(2), "bases")
        .when(bad_qual(1) | bad_qual(2), "lengths")
        .when(range_(1) | range_(2), "qualities")
    )
    return pairs.select("ordinal", problem.alias("problem")).where("problem IS NOT NULL")


def pair_totals(reads: DataFrame) -> DataFrame:
    """One row: pairs, bases, min_length, max_length."""
    n = F.length("seq")
    return reads.agg(F.count_if(F.col("mate") == 1).alias("pairs"), F.coalesce(F.sum(n), F.lit(0)).alias("bases"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def passing_pairs(reads: DataFrame, key: list[str], min_length: int = 35, qualified: int = 20, unqualified_percent: int = 40) -> DataFrame:
    """Reads of pairs whose mates both pass the quality filter."""
    ok = g.read_passes(g.qualities(F.col("qual")), F.length("seq"), min_length, qualified, unqualified_percent)
    good = reads.groupBy(*key).agg(F.bool_and(ok).alias("ok")).where("ok").select(*key)
    return reads.join(good, key, "left_semi")


def mark_duplicates(fragments: DataFrame, position: list[str], score: str, name: str) -> DataFrame:
    """Adds duplicate: all but the best fragment of those with one position. Ties go to the smaller name."""
    # The winner is settled by an aggregate with partial results, so a pile of any height is one row per task.
    top = fragments.groupBy(*position).agg(F.min_by(name, F.struct(-F.col(score), F.col(name))).alias("_best"))
    out = fragments.join(top, position)
    return out.withColumn("duplicate", F.col(name) != F.col("_best")).drop("_best")


def capped(rows: DataFrame, group: list[str], order: list, most: int = MAX_DEPTH) -> DataFrame:
    """At most so many rows of each group: the depth cap that callers ask for."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def pileup(alignments: DataFrame, min_mapq: int = 20, min_base_quality: int = 20, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(sample, contig, pos, base, quality, reverse) of the bases of usable alignments.

    alignments: sample, library, contig, pos (1-based), flag, mapq, name, seq, qual, and cigar if there are gaps or clipped
    ends. Depth is capped per library.
    """
    rows = alignments.where(g.usable_alignment(F.col("flag")) & (F.col("mapq") >= min_mapq))
    at = g.aligned_places(F.col("cigar"), F.length("seq")) if "cigar" in rows.columns else F.sequence(F.lit(0), F.length("seq") - 1)
    bases = rows.where(F.length("seq") > 0).select("sample", "library", "contig", "pos", "name", "flag", F.explode(F.arrays_zip(F.split("seq", "").alias("base"), g.qualities(F.col("qual")).alias("quality"), at.alias("at"))).alias("b")).where("b.at IS NOT NULL")
    bases = bases.select("sample", "library", "contig", (F.col("pos") + F.col("b.at")).alias("pos"), "name", F.col("flag").bitwiseAND(g.REVERSE).alias("strand"), F.upper("b.base").alias("base"), F.col("b.quality").alias("quality"))
    bases = bases.where((F.col("quality") >= min_base_quality) & F.col("base").isin("A", "C", "G", "T"))
    return capped(bases, ["library", "contig", "pos"], ["name", "strand"], max_depth).select("sample", "contig", "pos", "base", "quality", "strand")


#: Alleles of a site at most: one for each base. Pairs of them in the order in which the format lists genotypes.
ALLELES = 4
GENOTYPES = [(i, j) for j in range(ALLELES) for i in range(j + 1)]


def genotype_likelihoods(bases: DataFrame, sites: DataFrame) -> DataFrame:
    """Depths and log10 likelihoods of all genotypes by (sample, site). sites: contig, pos, ref, alts.

    depths has the reference's depth and that of each alternative; likelihoods are in the order of GENOTYPES, as many as
    the site's alleles make. All are sums, so a site's bases are added up where they are before anything moves.
    """
    e = F.pow(F.lit(10.0), -F.col("quality") / 10)
    rows = bases.join(sites, ["contig", "pos"]).withColumn("alleles", F.concat(F.array("ref"), "alts"))
    of = F.transform("alleles", lambda a: F.when(F.col("base") == a, 1 - e).otherwise(e / 3))
    rows = rows.withColumn("p", of)
    at = lambda k: F.get("p", F.lit(k))
    n = F.size("alts") + 1
    logs = [F.sum(F.log10((at(i) + at(j)) / 2)).alias(f"_l{i}{j}") for i, j in GENOTYPES]
    depths = [F.count_if(F.col("base") == F.get("alleles", F.lit(k))).alias(f"_d{k}") for k in range(ALLELES)]
    out = rows.groupBy("sample", "contig", "pos", "ref", "alts").agg(F.count("*").alias("dp"), *depths, *logs)
    every = F.array(*(F.col(f"_l{i}{j}") for i, j in GENOTYPES))
    return out.select("sample", "contig", "pos", "ref", "alts", "dp", F.slice(F.array(*(F.col(f"_d{k}") for k in range(ALLELES))), F.lit(1), n).alias("depths"), F.slice(every, F.lit(1), (n * (n + 1) / 2).cast("int")).alias("likelihoods"))


def call_genotypes(likelihoods: DataFrame, prior: float = 1e-3) -> DataFrame:
    """Adds gt and gq: the likeliest genotype under a prior for non-reference ones, and its Phred-scaled odds."""
    weight = lambda i, j: F.lit(0.0 if j == 0 else math.log10(prior) if i == 0 else math.log10(prior / 2) * (1 if i == j else 2))
    every = F.arrays_zip(F.col("likelihoods").alias("l"), F.array(*(weight(i, j) for i, j in GENOTYPES)).alias("w"), F.array(*(F.lit(f"{i}/{j}") for i, j in GENOTYPES)).alias("gt"))
    ranked = F.sort_array(F.transform(F.filter(every, lambda x: x["l"].isNotNull()), lambda x: F.struct((x["l"] + x["w"]).alias("p"), x["gt"].alias("gt"))), asc=False)
    gq = F.least(F.lit(99), F.round(10 * (ranked[0]["p"] - ranked[1]["p"])).cast("int"))
    return likelihoods.withColumns({"gt": ranked[0]["gt"], "gq": gq})


def candidate_sites(bases: DataFrame, reference: DataFrame, chunk: int, least_alt: int = 2) -> DataFrame:
    """Sites where bases other than the reference are seen often enough: contig, pos, ref, alts (all such, the commonest first).

    reference: contig, chunk, bases of ``chunk`` bases each.
    """
    counts = bases.groupBy("contig", "pos", "base").agg(F.count("*").alias("n"))
    joined = counts.withColumn("chunk", F.floor((F.col("pos") - 1) / chunk)).join(reference, ["contig", "chunk"])
    ref = F.upper(F.substring(F.col("bases"), (F.col("pos") - 1 - F.col("chunk") * chunk + 1).cast("int"), F.lit(1)))
    other = joined.withColumn("ref", ref).where((F.col("base") != F.col("ref")) & F.col("ref").isin("A", "C", "G", "T") & (F.col("n") >= least_alt))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "base")))
    return other.groupBy("contig", "pos", "ref").agg(F.transform(ranked, lambda x: x["base"]).alias("alts"))


def library_counts(alignments: DataFrame) -> DataFrame:
    """records, mapped, duplicates and usable alignments by library."""
    flag = F.col("flag")
    has = lambda bit: flag.bitwiseAND(bit) != 0
    return alignments.groupBy("library").agg(F.count("*").alias("records"), F.count_if(~has(g.UNMAPPED)).alias("mapped"), F.count_if(has(g.DUPLICATE)).alias("duplicates"), F.count_if(g.usable_alignment(flag)).alias("usable"))


def depth(points: DataFrame, keys: list[str], alt: Column) -> DataFrame:
    """Depth and depth of the alternative by the keys."""
    return points.groupBy(*keys).agg(F.count("*").alias("depth"), F.count_if(alt).alias("alt_depth"))


def mate_links(alignments: DataFrame) -> DataFrame:
    """One row per template (library, name): firsts and seconds counted, the places of the two, and ``linked``.

    Mates are brought together by name in one grouped aggregate, whatever the order of the alignments. Primary records
    count; a template is linked if it has one first and one second mate.
    """
    rows = alignments.where(g.primary_alignment(F.col("flag")))
    has = lambda bit: F.col("flag").bitwiseAND(bit) != 0
    place = F.struct("contig", "pos", "flag")
    out = rows.groupBy("library", "name").agg(*(x for n, bit in (("first", g.FIRST), ("second", g.SECOND)) for x in (F.count_if(has(bit)).alias(f"{n}s"), F.min(F.when(has(bit), place)).alias(n))))
    return out.withColumn("linked", (F.col("firsts") == 1) & (F.col("seconds") == 1))


def posteriors(likelihoods: np.ndarray, alleles: int, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights of each sample's genotypes, allele frequencies, log10 gain over a site without alternatives).

    likelihoods: log10, samples by genotypes. Frequencies are those that make all samples' likelihoods most probable under
    Hardy-Weinberg proportions, by expectation-maximisation from 0.9 for the reference on.
    """
    pairs = np.array(GENOTYPES[: alleles * (alleles + 1) // 2])
    e = 10.0 ** (likelihoods - likelihoods.max(1, keepdims=True))
    share = np.zeros((len(pairs), alleles))
    for k in range(2):
        share[np.arange(len(pairs)), pairs[:, k]] += 0.5
    twice = np.where(pairs[:, 0] == pairs[:, 1], 1.0, 2.0)
    weights = lambda f: e * (twice * f[pairs[:, 0]] * f[pairs[:, 1]])
    f = np.full(alleles, 0.1 / max(1, alleles - 1))
    f[0] = 1 - f[1:].sum()
    for _ in range(steps):
        w = weights(f)
        f = (w / w.sum(1, keepdims=True) @ share).mean(0)
    w = weights(f)
    gain = np.log10(np.maximum(w.sum(1), 1e-300)) - np.log10(np.maximum(e[:, 0], 1e-300))
    return np.maximum(w, 1e-300), f, float(gain.sum())


def _called(steps: int, variant: float):
    """Rows (contig, pos, ref, alts, s), s the samples of a site, to one row for each sample of a variant site."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                alts = row["alts"]
                w, f, gain = posteriors(np.array([x["likelihoods"] for x in row["s"]]), len(alts) + 1, steps)
                if 10 * gain < variant:
                    continue
                best = w.argmax(1)
                # An alternative that nobody has goes, but for the commonest if nobody has any.
                had = {a for g_ in best for a in GENOTYPES[g_]} - {0} or {1 + int(f[1:].argmax())}
                keep = [0, *sorted(had)]
                number = {a: k for k, a in enumerate(keep)}
                wrong = 1 - w[np.arange(len(best)), best] / w.sum(1)
                for x, g_, odds in zip(row["s"], best.tolist(), wrong.tolist(), strict=True):
                    i, j = GENOTYPES[g_]
                    gt = f"{number[i]}/{number[j]}" if i in number and j in number else "./."
                    out.append(
                        {"sample": x["sample"], "contig": row["contig"], "pos": row["pos"], "ref": row["ref"], "alts": [alts[a - 1] for a in keep[1:]], "dp": x["dp"], "depths": [x["depths"][a] for a in keep]}
                        | {"gt": gt, "gq": min(99, round(-10 * math.log10(max(odds, 1e-10)))), "frequencies": [float(f[a]) for a in keep[1:]], "quality": 10 * gain}
                    )
            if out:
                yield pa.RecordBatch.from_pylist(out, _CALLED)

    return run


_CALLED = pa.schema([("sample", pa.string()), ("contig", pa.string()), ("pos", pa.int64()), ("ref", pa.string()), ("alts", pa.list_(pa.string())), ("dp", pa.int64()), ("depths", pa.list_(pa.int64())), ("gt", pa.string()), ("gq", pa.int32()), ("frequencies", pa.list_(pa.float64())), ("quality", pa.float64())])


def joint_genotypes(likelihoods: DataFrame, steps: int = 20, variant: float = 10.0) -> DataFrame:
    """Genotypes of all samples of a site together: sample, contig, pos, ref, alts, dp, depths, gt, gq, frequencies, quality.

    A site may have several alternatives, and all diploid genotypes of its alleles count. The frequencies are what makes all samples'
    likelihoods most probable (see :func:`posteriors`, inside one row per site: its size is that of the cohort) and every
    sample's prior. quality is the Phred-scaled gain over a site without alternatives; sites below ``variant`` go. An
    alternative that no sample has isn't listed.
    """
    prepare_workers(likelihoods.sparkSession)
    own = F.struct("sample", F.col("dp").cast("long").alias("dp"), F.transform("depths", lambda d: d.cast("long")).alias("depths"), "likelihoods")
    sites = likelihoods.groupBy("contig", F.col("pos").cast("long").alias("pos"), "ref", "alts").agg(F.sort_array(F.collect_list(own)).alias("s"))
    shape = "sample string, contig string, pos long, ref string, alts array<string>, dp long, depths array<long>, gt string, gq int, frequencies array<double>, quality double"
    return sites.mapInArrow(_called(steps, variant), shape)
