"""Language identification by string kernels (operator 5).

A text is the set of byte n-grams (n = 1..MAX_N) of its lower-cased whole
text, hashed to DIMENSIONS places: a blended spectrum of presences.  The
kernel of two texts is the size of their common set over the geometric mean
of their sizes.  Landmarks, some training texts of each language, give the
Nystroem form: a text is its kernel values with them, and one-versus-rest
kernel ridge regression is solved in the landmarks' span,

    (C'C + ridge * n * W) a = C'Y,   C = k(train, landmarks), W = k(landmarks, landmarks).

All texts are then scored in blocks by two matrix products.

The fit reads a sample: for each language the PER_LANGUAGE first distinct
training texts by hash, fewer if there are so many languages that SAMPLE_ROWS
would be exceeded; every document is scored.  A cut of the hash that leaves
about CUT_SHARE times as many texts, from an estimate of each language's
distinct texts, is taken where the rows lie; only hashes under it are ranked,
and only the ranked texts are read again.

Cases: a null text, or one without a letter, is ``und`` with score 0; null
languages do not train; without any training row everything is ``und``;
equal scores go to the first language by code point; repeated rows are scored
alike and train once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitext.session import materialize

from . import textkit as tk
from .registry import query, table

DIMENSIONS, MAX_N = 8192, 3
PER_LANGUAGE, SAMPLE_ROWS = 400, 20_000
#: Texts that the hash cut leaves, over those wanted.
CUT_SHARE = 2.0
LANDMARKS = 128
RIDGE = 1e-4
#: Steepness of the softmax over the regressions' outputs.
SHARPNESS = 4.0
BLOCK = 64

_MULTIPLIERS = tk.mix64(np.arange(1, MAX_N + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def presence(text: np.ndarray) -> np.ndarray:
    """Which places the n-grams of a byte array take."""
    out = np.zeros(DIMENSIONS, bool)
    code = np.zeros(len(text), np.uint32)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    for n in range(1, MAX_N + 1):
        if len(text) < n:
            break
        code = (code[: len(text) - n + 1] << np.uint32(8)) | text[n - 1:]
        out[(code + np.uint32(n)) * _MULTIPLIERS[n - 1] >> shift] = True
    return out


def _lower(col):
    col = col.cast(pa.large_string())
    return tk.flat_utf8(pc.utf8_lower(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col))


def _bits(batches):
    """(lang, text) -> (lang, its presences as bits)."""
    for batch in batches:
        data, off = _lower(batch.column(1))
        bits = [np.packbits(presence(data[a:b])).tobytes() for a, b in zip(off, off[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["lang", "bits"])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over the root of their number of places, so a product is a kernel."""
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit_ridge(x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """(languages, landmark rows, coefficients)."""
    names = sorted(set(langs))
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang in langs])
    each = max(1, landmarks // len(names))
    seen: dict[str, int] = {}
    chosen = []
    for i, lang in enumerate(langs):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= each:
            chosen.append(i)
    rows = _unit(x)
    marks = rows[chosen]
    c, w = (rows @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    a = np.linalg.solve(c.T @ c + ridge * len(langs) * w + 1e-8 * np.eye(len(chosen)), c.T @ y)
    return names, marks, a.astype(np.float32)


def _predict(model):
    def run(batches):
        names, marks, a = model.value
        for batch in batches:
            data, off = _lower(batch.column(1))
            n = len(off) - 1
            out, score = np.full(n, "und", object), np.zeros(n)
            letters = np.array([t is not None and any(map(str.isalpha, t))
                                for t in (v.as_py() for v in batch.column(1))], bool) if n else np.zeros(0, bool)
            for lo in range(0, n if names else 0, BLOCK):
                hi = min(lo + BLOCK, n)
                x = _unit(np.stack([presence(data[off[i]: off[i + 1]]) for i in range(lo, hi)]))
                f = SHARPNESS * (x @ marks.T @ a)
                p = np.exp(f - f.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                some = letters[lo:hi]
                out[lo:hi][some] = np.array(names, object)[best[some]]
                score[lo:hi][some] = p[np.arange(hi - lo), best][some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, held_out: F.Column, per_language: int = PER_LANGUAGE,
             landmarks: int = LANDMARKS) -> DataFrame:
    """Per document: doc_id, lang_pred, score.  ``held_out`` is a boolean over
    doc_id; only rows where it is false, and lang is not null, may train."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    train = docs.filter(F.col("lang").isNotNull() & ~held_out)
    train = train.select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = materialize(train.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "kernel-languages")
    each = max(1, min(per_language, SAMPLE_ROWS // max(sizes.count(), 1)))
    # the same place of the range of hashes for all, so the cut is a share of it
    place = F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))
    near = train.join(sizes, "lang").filter(place <= F.lit(CUT_SHARE * each) / F.col("n")).select("lang", "h").distinct()
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h")
    chosen = materialize(near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= each)
                         .select("lang", "h"), "kernel-sample")
    # at most SAMPLE_ROWS rows of (lang, h), or one a language
    sample = (train.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("lang", "text")
              .mapInArrow(_bits, "lang string, bits binary").distinct().collect())
    sample = sorted(((r["lang"], bytes(r["bits"])) for r in sample), key=lambda r: (r[0], hash_of(r[1])))
    if sample:
        x = np.unpackbits(np.frombuffer(b"".join(b for _, b in sample), np.uint8)).reshape(len(sample), -1)
        model = fit_ridge(x, [lang for lang, _ in sample], landmarks)
    else:
        model = [], None, None
    model = spark.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def hash_of(b: bytes) -> int:
    """An order of the sampled rows that does not depend on how they arrive."""
    return int(tk.mix64(np.frombuffer(b, np.uint64)).sum(dtype=np.uint64))


@query("op5_string_kernel")
def op5(spark, sf_dir: str) -> DataFrame:
    """Contract: rows with crc32(doc_id as text) mod 3 = 1 are held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return identify(table(spark, sf_dir, "documents"), held_out).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")
