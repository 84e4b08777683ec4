"""Projections and filters: rename, pick, null/blank filters, orientation,
naming-scheme harmonisation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import not_blank as _not_blank_expr
from ..functions.text import stringify_null, strip


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns; a missing source column is a silent no-op."""
    for old, new in mapping.items():
        df = df.withColumnRenamed(old, new)
    return df


def pick_or_first(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Column ``name`` if present, else the first column, as ``out``."""
    src = name if name in df.columns else df.columns[0]
    return df.select(F.col(src).alias(out or name))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def drop_null_pairs(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop rows where any of ``columns`` is null."""
    return df.na.drop(subset=list(columns))


def cast_string(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def stringify(df: DataFrame, columns: Iterable[str], literal: str = "None") -> DataFrame:
    """``str(x)`` semantics: a null becomes the text ``literal`` (opt-in)."""
    return df.withColumns({c: stringify_null(c, literal) for c in columns})


def strip_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: strip(c) for c in columns})


def not_blank(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keep rows whose columns are all non-null and non-empty after stripping."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & _not_blank_expr(c)
    return df.where(cond)


def clean_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Strip, then drop rows with a null or blank value in any of ``columns``."""
    cols = list(columns)
    return not_blank(strip_columns(df, cols), cols)


def orient(df: DataFrame, src: str, tgt: str, keep: Iterable[str] = ()) -> DataFrame:
    """Choose source and target columns by direction → ``(keep..., src, tgt)``."""
    return df.select(*keep, F.col(src).alias("src"), F.col(tgt).alias("tgt"))


def orient_direction(df: DataFrame, direction: str, columns: Mapping[str, str],
                     keep: Iterable[str] = ()) -> DataFrame:
    """``direction`` like ``'rin2eng'``: language codes looked up in ``columns``
    (language → column name)."""
    a, b = direction.split("2", 1)
    return orient(df, columns[a], columns[b], keep)


def both_directions(df: DataFrame, a: str, b: str, keep: Iterable[str] = (),
                    names: tuple[str, str] | None = None) -> DataFrame:
    """Bidirectional corpus: union of both orientations with a ``direction``
    column (``names`` = labels of a→b and b→a; default ``a2b``/``b2a``)."""
    keep = list(keep)
    n_ab, n_ba = names or (f"{a}2{b}", f"{b}2{a}")
    fwd = orient(df, a, b, keep).withColumn("direction", F.lit(n_ab))
    bwd = orient(df, b, a, keep).withColumn("direction", F.lit(n_ba))
    return fwd.unionByName(bwd)


def drop_raw(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


# The naming schemes of scored/augmented tables seen in the
# reference's file contracts, mapped to one scheme (src, tgt, similarity).
HARMONISE_SCHEMES = {
    "src": ("sentence", "english", "en", "eng", "src", "tl"),
    "tgt": ("rinconada", "synthetic_rinconada", "rin", "tgt", "tl"),
    "similarity": ("similarity",),
}


def harmonise(df: DataFrame, schemes: Mapping[str, Iterable[str]] = HARMONISE_SCHEMES,
              origin: str | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Map any known naming scheme to ``(keep..., src, tgt, similarity[, origin])``:
    the first present candidate of each target name wins, and a column is used
    once (``tl`` is the target beside ``en`` and the source beside ``rin``);
    absent → null."""
    out, taken = [F.col(k) for k in keep], set()
    for target, candidates in schemes.items():
        present = [c for c in candidates if c in df.columns and c not in taken]
        if present:
            taken.add(present[0])
            out.append(F.col(present[0]).alias(target))
        else:
            out.append(F.lit(None).cast("double" if target == "similarity" else "string").alias(target))
    if origin is not None:
        out.append(F.lit(origin).alias("origin"))
    return df.select(*out)
