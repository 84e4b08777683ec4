"""Quality rules with risk-controlled cutoffs (operator 4).

Every rule rejects texts whose statistic exceeds a cutoff.  Labelled documents
are the holdout: within a stratum (a language) a cutoff is certified when the
exact binomial test on the good documents, P(Bin(n, alpha) <= rejected), falls
under delta / (strata * rules), which is the Clopper-Pearson upper limit of
false rejection lying under alpha at that level.  Each rule's grid is walked
from lenient to strict and the walk stops at the first cutoff that fails
(fixed-sequence testing), so the grid needs no further correction, and with
probability 1 - delta no chosen cutoff exceeds alpha anywhere.  Among the
certified cutoffs the one with the best difference of caught and falsely
rejected shares is used, the most lenient on ties; a rule stays off in a
stratum that has too few good labels to certify anything.

The binomial model takes documents as independent, so copies must not swell a
holdout: one row of each doc_id and one of each text (by hash; that of the
least doc_id) is counted, whatever its stratum.  Texts that differ are taken
as independent, near copies too.

Cases: a null text has no words; a null language is a stratum of its own; a
document whose labels disagree counts as bad; label rows without a document,
or with null quality, are ignored; without labels only the base rules act.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.session import materialize

from .docstats import with_counts
from .registry import query, table

ALPHA, DELTA = 0.02, 0.05
#: What a falsely rejected share weighs against a caught share.
FALSE_WEIGHT = 4.0

#: rule -> (statistic over the counts, cutoffs from lenient to strict).
RULES = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.8, 0.6, 0.5, 0.4, 0.35, 0.3, 0.2, 0.1)),
    "upper_case": ("n_upper / greatest(word_chars, 1)", (0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
}


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p)
            + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(rejected: list[int], n: int, alpha: float, level: float) -> int:
    """How many cutoffs of a grid, from its lenient end, pass the test."""
    for i, k in enumerate(rejected):
        if k >= alpha * n or binomial_cdf(k, n, alpha) > level:
            return i
    return len(rejected)


def calibrate(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> list[dict]:
    """One dict per certifiable stratum: its name and a cutoff per rule (None:
    off).  ``counted`` has doc_id, stratum, copy (a hash of the text) and the counts.  Only sums per
    stratum come to the driver, and only of strata whose number of good labels
    could certify anything at all (ln(delta) / ln(1 - alpha), 149 here)."""
    marks = (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.min("quality").alias("quality")))
    enough = math.ceil(math.log(delta) / math.log1p(-alpha))
    held = counted.join(marks, "doc_id")
    for key, order in (("doc_id", "copy"), ("copy", "doc_id")):  # one row of each id, then of each text
        rest = [c for c in held.columns if c != key]
        held = (held.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, "stratum")).alias("row"))
                .select(key, "row.*"))
    sums = (held.withColumn("good", F.col("quality") == 1).groupBy("stratum")
            .agg(F.sum(F.col("good").cast("int")).alias("n_good"), F.sum((~F.col("good")).cast("int")).alias("n_bad"),
                 *[F.sum(F.when((F.expr(stat) > cut) & (F.col("good") == good), 1).otherwise(0))
                   .alias(f"{rule}:{i}:{int(good)}")
                   for rule, (stat, cuts) in RULES.items() for i, cut in enumerate(cuts) for good in (True, False)])
            .filter(F.col("n_good") >= enough).collect())
    out = []
    for row in sums:
        chosen = {"stratum": row["stratum"]}
        for rule, (_, cuts) in RULES.items():
            false = [row[f"{rule}:{i}:1"] for i in range(len(cuts))]
            caught = [row[f"{rule}:{i}:0"] for i in range(len(cuts))]
            safe = certified(false, row["n_good"], alpha, delta / (len(sums) * len(RULES)))
            gain = [caught[i] / max(row["n_bad"], 1) - FALSE_WEIGHT * false[i] / row["n_good"] for i in range(safe)]
            best = max(range(safe), key=lambda i: (gain[i], -i), default=None)
            chosen[rule] = None if best is None or gain[best] <= 0 else cuts[best]
        out.append(chosen)
    return out


def judged(counted: DataFrame, cutoffs: list[dict], prefix: str = "") -> DataFrame:
    """Adds base_failed, rejected_by (names of the rules) and kept.  The
    cutoffs, one row per certified stratum, are part of the plan."""
    def named(sql: str):
        for c in ("n_words", "n_symbols", "n_repeat_words", "n_dup_lines", "n_lines", "n_upper", "word_chars"):
            sql = sql.replace(c, f"`{prefix}{c}`")
        return F.expr(sql)

    fired = []
    for rule, (stat, _) in RULES.items():
        at = [F.lit(c["stratum"]) for c in cutoffs if c[rule] is not None]
        to = [F.lit(c[rule]) for c in cutoffs if c[rule] is not None]
        if at:
            pairs = F.create_map(*[x for p in zip(at, to) for x in p])
            fired.append(F.when(named(stat) > F.try_element_at(pairs, F.col(f"{prefix}stratum")), F.lit(rule)))
    return (counted
            .withColumn(f"{prefix}base_failed", named("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
            .withColumn(f"{prefix}rejected_by", F.array_compact(F.array(*fired)) if fired
                        else F.array().cast("array<string>"))
            .withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.size(f"{prefix}rejected_by") == 0)))


def _stratum() -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))


def count_documents(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, copy (a hash of the text) and the counts, written once."""
    text = F.col("text").cast("string")
    slim = docs.select("doc_id", _stratum().alias("stratum"), F.xxhash64(text).alias("copy"), text.alias("text"))
    return materialize(with_counts(slim, keep_text=False), "rule-counts")


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, rejected_by, kept."""
    counted = count_documents(docs)
    return judged(counted, calibrate(counted, labels, alpha, delta))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.  Texts
    are counted a second time where they lie, which spares a shuffle of them."""
    cutoffs = calibrate(count_documents(docs), labels, alpha, delta)
    p = "_rule_"
    counted = with_counts(docs, prefix=p).withColumn(f"{p}stratum", _stratum())
    return judged(counted, cutoffs, p).filter(f"{p}kept").select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op4_risk_rules")
def op4(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "rejected_by")
