"""Column-expression builders (built-in Spark functions only)."""

from .text import strip, not_blank, tokens, stringify_null, na_to_null
from .vectors import dot, l2_norm, l2_normalise, cosine
from .ids import (mask_labels, mask_out_of_vocab, unmask_labels, truncate, pad_fixed,
                  attention_mask, take_primary, ids_to_text)
from .naming import run_name

__all__ = [
    "strip", "not_blank", "tokens", "stringify_null", "na_to_null",
    "dot", "l2_norm", "l2_normalise", "cosine",
    "mask_labels", "mask_out_of_vocab", "unmask_labels", "truncate", "pad_fixed",
    "attention_mask", "take_primary", "ids_to_text", "run_name",
]
