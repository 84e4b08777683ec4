"""Token-id array expressions: masking, truncation, padding, decoding helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_ID = -100  # fixed value: label id ignored by the loss


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_labels(ids, pad_id: int) -> Column:
    """pad id → -100, per token."""
    return F.transform(_c(ids), lambda x: F.when(x == pad_id, F.lit(IGNORE_ID)).otherwise(x))


def mask_out_of_vocab(ids, pad_id: int, vocab_size: int) -> Column:
    """pad id or id ≥ vocab_size → -100."""
    return F.transform(_c(ids), lambda x: F.when((x == pad_id) | (x >= vocab_size),
                                                 F.lit(IGNORE_ID)).otherwise(x))


def unmask_labels(ids, pad_id: int) -> Column:
    """-100 → pad id (before decoding)."""
    return F.transform(_c(ids), lambda x: F.when(x == IGNORE_ID, F.lit(pad_id)).otherwise(x))


def truncate(ids, n: int) -> Column:
    """First n ids."""
    return F.slice(_c(ids), 1, n)


def pad_fixed(ids, n, pad_id: int) -> Column:
    """Right-pad to length n (a literal or a column)."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    fill = F.greatest(n_col - F.size(_c(ids)), F.lit(0))
    return F.concat(_c(ids), F.array_repeat(F.lit(pad_id), fill))


def attention_mask(ids, pad_id: int) -> Column:
    """1 for real tokens, 0 for padding."""
    return F.transform(_c(ids), lambda x: F.when(x == pad_id, F.lit(0)).otherwise(F.lit(1)))


def take_primary(preds) -> Column:
    """Predictions given as a tuple (array of outputs): use the first."""
    return F.element_at(_c(preds), 1)


def ids_to_text(ids, sep: str = ",") -> Column:
    """Stable text rendering of an id array (for reports and oracle checks)."""
    return F.array_join(F.transform(_c(ids), lambda x: x.cast("string")), sep)
