"""Quality rules whose cutoffs carry a bound on falsely rejected documents.

One half of the labelled documents proposes cutoffs; the other half, the holdout,
certifies them. In every stratum (language) nested variants, from the loosest to
the strictest, are tested in turn: a variant holds if the exact binomial probability
of so few false rejections, were the true rate at the limit, is small enough. Testing
in a fixed order needs no correction within a stratum; Holm's correction runs over
strata. So with the stated confidence no stratum loses more than the limit of
its good documents to the rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.llm.labels import quality_labels
from faultline.llm.statistics import with_counts
from faultline.session import cut

LIMIT = 0.05
ERROR = 0.05
VARIANTS = 3
COST = 20

# Highest allowed values, from strict to loose.
GRIDS: dict[str, list[float]] = {
    "symbols": [0.02, 0.05, 0.08, 0.12, 0.16, 0.2, 0.3],
    "bangs": [0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 1.8],
    "capitals": [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "duplicate_lines": [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "sameness": [0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 0.9],
}


def values() -> dict[str, Column]:
    """The rules' values; a document fails a rule if its value is above the cutoff."""
    of = lambda top, below: F.col(top) / F.greatest(F.col(below), F.lit(1))
    return {
        "symbols": of("n_symbols", "word_chars"),
        "bangs": of("n_bangs", "n_words"),
        "capitals": of("n_capitals", "word_chars"),
        "duplicate_lines": of("n_dup_lines", "n_lines"),
        "sameness": F.when(F.col("n_words") > 0, 1 - of("n_distinct", "n_words")).otherwise(0.0),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, rate: float) -> float:
    """Exact P(X <= k) of n trials at ``rate``."""
    if k >= n:
        return 1.0
    total = 0.0
    for i in range(k + 1):
        log = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        total += math.exp(log + i * math.log(rate) + (n - i) * math.log1p(-rate))
    return min(1.0, total)


def certify(
    tested: dict[str, list[tuple[int, int]]], limit: float = LIMIT, error: float = ERROR
) -> dict[str, int]:
    """stratum -> strictest certified variant, from (false rejections, good) per variant, loosest first.

    A graphical procedure: strata share the error evenly, and a stratum's whole share tests its
    variants in turn, the next only once the one before is certified. A stratum that has all its
    variants certified hands its share on, once, to the strata still at work.
    """
    share = {s: error / len(tested) for s in tested}
    at = {s: 0 for s, variants in tested.items() if variants}
    active = sorted(at)
    moved = True
    while moved:
        moved = False
        for stratum in list(active):
            k, n = tested[stratum][at[stratum]]
            if k > limit * n or binomial_tail(k, n, limit) > share[stratum]:
                continue
            moved = True
            at[stratum] += 1
            if at[stratum] == len(tested[stratum]):
                active.remove(stratum)
                for other in active:
                    share[other] += share[stratum] / len(active)
    return {s: n - 1 for s, n in at.items() if n}


def propose(tuning: DataFrame) -> list[dict[str, float]]:
    """Cutoffs from loosest to strictest; rules that reject nothing worth it are left out.

    A rejected good document weighs as ``COST`` rejected bad ones. Equal gains take the loosest cutoff.
    """
    sums = [
        F.sum(F.when(v > g, F.when(F.col("quality") == 0, 1).otherwise(-COST)).otherwise(0)).alias(f"{r}_{i}")
        for r, v in values().items() for i, g in enumerate(GRIDS[r])
    ]
    gained = tuning.agg(*sums).first().asDict()
    best = {}
    for rule, grid in GRIDS.items():
        gain = [gained[f"{rule}_{i}"] or 0 for i in range(len(grid))]
        at = max(range(len(grid)), key=lambda i: (gain[i], i))
        if gain[at] > 0:
            best[rule] = at
    # The strictest variant is the proposal itself, the others are one and two steps looser.
    return [
        {r: GRIDS[r][min(i + step, len(GRIDS[r]) - 1)] for r, i in best.items()}
        for step in range(VARIANTS - 1, -1, -1)
    ]


def rejected(cutoffs: dict[str, float]) -> Column:
    out = F.lit(False)
    for rule, cutoff in cutoffs.items():
        out = out | (values()[rule] > cutoff)
    return out


def learn(labelled: DataFrame) -> dict[str, dict[str, float]]:
    """stratum -> certified cutoffs, from rows with counts, stratum and quality.

    Counts per stratum and variant reach the driver: one row per language.
    """
    rows = labelled.where(~base_failed()).withColumn("_half", F.crc32(F.col("doc_id").cast("string")) % 2)
    variants = propose(rows.where("_half = 0"))
    if not variants[0]:
        return {}
    good = rows.where("_half = 1 and quality = 1").groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(rejected(v).cast("int")).alias(f"k{i}") for i, v in enumerate(variants)],
    )
    tested = {r["stratum"]: [(r[f"k{i}"], r["n"]) for i in range(len(variants))] for r in good.collect()}
    return {s: variants[v] for s, v in certify(tested).items()}


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, counts, base_failed, rejected_by (array of rules) and kept of every row.

    Null texts have no words and fail the base; a null language is a stratum of its own.
    A stratum without enough labelled good documents has no certified cutoff, so the
    base alone decides there. Repeated rows are judged alike; an empty table gives no rows.
    """
    named = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("stratum"))
    counted = cut(with_counts(named, ["doc_id", "stratum"]))
    cutoffs = learn(counted.join(quality_labels(spark, sf_dir), "doc_id"))
    # One literal map of at most a few hundred languages.
    tests = []
    for rule in GRIDS:
        known = [x for s, c in cutoffs.items() if rule in c for x in (F.lit(s), F.lit(c[rule]))]
        if known:
            allowed = F.element_at(F.create_map(*known), F.col("stratum"))
            tests.append(F.when(values()[rule] > allowed, F.lit(rule)))
    failed = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return (
        counted.withColumn("base_failed", base_failed())
        .withColumn("rejected_by", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    )
