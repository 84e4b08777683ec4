"""Imports every operator module, which registers its query."""

from . import (  # noqa: F401
    chat_windows,
    column_bwt,
    es_mixing,
    license_scan,
    line_hash,
    lsa_decontam,
    maglev,
    odd_sketch,
    pairwise_quality,
    phrase_counts,
    risk_rules,
    rns_negatives,
    string_kernel,
)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
