"""Quality scores by pairwise ranking (operator 1).

A Bradley-Terry model: the chance that a document beats another is the
logistic function of the difference of their scores, and a score is linear in
features of the whole text.  Weights minimise the logistic loss on feature
differences of (good, bad) pairs of labelled documents, with an L2 penalty, by
Newton steps.  The threshold is a quantile of the training scores: the share
of bad documents among the labelled ones.  Scores are shifted so that the
threshold lies at 0.3.

The model is fitted on every labelled training document.  They are numbered in
the order of a hash, good and bad ones apart; each meets OPPONENTS documents of
the other kind, those whose numbers follow its own.  The differences are a table
written once; a Newton step is one pass over it that returns its sums, and the
threshold's place among the training scores is found by numbering them in ranges.

Cases: a null or empty text has zero counts and gets a score from them; with
no label, or labels of one kind only, every score is 0.5; a document whose
labels disagree, or are null, does not train; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.operators.ordering import row_number_by
from bitext.session import materialize

from .docstats import with_counts
from .registry import query, table

#: Opponents that each labelled document meets in training.
OPPONENTS = 8
L2 = 1e-3
THRESHOLD = 0.3

#: Features of a text, as SQL over its counts.
FEATURES = (
    "least(n_symbols / greatest(n_words, 1), 1)",
    "ln(1 + 20 * n_symbols / greatest(n_words, 1))",
    "n_repeat_words / greatest(n_words, 1)",
    "greatest(n_repeat_words / greatest(n_words, 1) - 0.5, 0)",
    "n_dup_lines / greatest(n_lines, 1)",
    "n_distinct_words / greatest(n_words, 1)",
    "n_upper / greatest(word_chars, 1)",
    "least(n_stops / greatest(n_words, 1), 1)",
    "n_punct / greatest(n_words, 1)",
    "n_digits / greatest(word_chars, 1)",
    "least(abs(word_chars / greatest(n_words, 1) - 5), 5)",
    "ln(1 + n_words)",
)


def _sums(w: np.ndarray):
    """Differences d (winner less loser) -> a task's number of them and its sums
    of the loss's gradient and curvature at weights ``w``."""
    def run(batches):
        n, grad, curve = 0, np.zeros(len(w)), np.zeros((len(w),) * 2)
        for batch in batches:
            d = batch.column(0).flatten().to_numpy().reshape(-1, len(w))
            lose = 1.0 / (1.0 + np.exp(np.clip(d @ w, -30, 30)))
            n += len(d)
            grad -= (d * lose[:, None]).sum(axis=0)
            curve += (d * (lose * (1 - lose))[:, None]).T @ d
        yield pa.RecordBatch.from_arrays(
            [pa.array([n]), pa.array([grad.tolist()]), pa.array([curve.ravel().tolist()])], names=["n", "grad", "curve"])
    return run


def fit_weights(differences: DataFrame, size: int, l2: float = L2, steps: int = 25) -> np.ndarray:
    """Weights of a Bradley-Terry model over a table of differences ``d``."""
    w = np.zeros(size)
    for _ in range(steps):
        rows = differences.select("d").mapInArrow(_sums(w), "n long, grad array<double>, curve array<double>").collect()  # one a task
        n = sum(r["n"] for r in rows)
        grad = np.sum([r["grad"] for r in rows], axis=0) / n + l2 * w
        curve = np.sum([r["curve"] for r in rows], axis=0).reshape(size, size) / n + l2 * np.eye(size)
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _differences(marked: DataFrame, names: list[str], scale: list[float], n: dict, opponents: int) -> DataFrame:
    """``d``: a winner's features less a loser's, in units of ``scale``."""
    order = [F.xxhash64("doc_id", *names), "doc_id", *names]
    numbered = row_number_by(marked, ["quality"], order, "i").select(
        "quality", (F.col("i") - 1).alias("i"), F.array(*[F.col(c) / s for c, s in zip(names, scale)]).alias("x"))
    numbered = materialize(numbered, "pair-numbers")
    parts = []
    for kind, sign in ((1, 1.0), (0, -1.0)):
        asks = numbered.where(F.col("quality") == kind).select("x", F.explode(F.sequence(
            F.col("i") * opponents, F.col("i") * opponents + opponents - 1)).alias("j"))
        others = numbered.where(F.col("quality") == 1 - kind).select(F.col("i").alias("j"), F.col("x").alias("y"))
        met = asks.withColumn("j", F.pmod("j", F.lit(n[1 - kind]))).join(others, "j")
        parts.append(met.select(F.zip_with("x", "y", lambda a, b: (a - b) * sign).alias("d")))
    return materialize(parts[0].unionByName(parts[1]), "pair-differences")


def score_documents(docs: DataFrame, labels: DataFrame, held_out: F.Column, opponents: int = OPPONENTS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.  ``held_out`` is a
    boolean over doc_id; only rows where it is false may train."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counted = materialize(with_counts(slim, keep_text=False), "pair-counts")
    marks = (labels.filter("doc_id is not null").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
             .filter("quality = most and quality in (0, 1)").filter(~held_out).select("doc_id", "quality"))
    x = [F.expr(f).cast("double").alias(f"f{i}") for i, f in enumerate(FEATURES)]
    names = [f"f{i}" for i in range(len(x))]
    # repeated rows of a document count once
    marked = materialize(counted.join(marks, "doc_id").select("doc_id", "quality", *x).distinct(), "pair-marked")
    base = counted.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), *x)
    n = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}  # two at most
    if len(n) < 2:
        return base.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    scale = [s or 1.0 for s in marked.agg(*[F.stddev_pop(c) for c in names]).first()]
    w = fit_weights(_differences(marked, names, scale, n, opponents), len(names))
    raw = sum((F.col(c) * float(w[i] / scale[i]) for i, c in enumerate(names)), F.lit(0.0))
    ranked = row_number_by(marked.select("doc_id", raw.alias("s")), [], ["s", "doc_id"], "r")
    around = ranked.where(F.col("r").isin(n[0], n[0] + 1)).collect()  # the two at the threshold
    cut = float(sum(r["s"] for r in around)) / 2
    score = 1.0 / (1.0 + F.exp(-(raw - cut + float(np.log(THRESHOLD / (1 - THRESHOLD))))))
    return base.withColumn("score", score).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op1_pairwise_quality")
def op1(spark, sf_dir: str) -> DataFrame:
    """Contract: rows with crc32(doc_id as text) mod 5 = 0 are held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
