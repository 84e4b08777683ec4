"""Sub-word ids with a public tokenizer's vocabulary.

The vocabulary file (the ``tokenizers`` JSON format) is a parameter; nothing is
trained and the file is not part of this repository.  It is read once where
the query is built, its size is checked, and it travels with the tasks, so
executors need no copy of their own.  Texts are encoded in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import IGNORE_ID, attention_mask, mask_labels, pad_fixed

#: Default vocabulary file: byte-level, so that every text comes back whole.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: A larger file is refused, since it goes to every task.
MAX_FILE_BYTES = 64 << 20
#: Characters (ids, when decoding) that a task has in work at a time: an encoded
#: text takes over a hundred bytes a character until its ids are taken out.
PIECE = 1 << 18


def read_vocabulary(path: str = VOCABULARY) -> str:
    """The text of a vocabulary file of checked size."""
    size = Path(path).stat().st_size
    if size > MAX_FILE_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_FILE_BYTES} are sent to tasks")
    return Path(path).read_text(encoding="utf-8")


def _tokenizer(content: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(content)
    t.encode_special_tokens = True  # their strings within a text are ordinary text
    t.no_truncation()
    t.no_padding()
    return t


def _pieces(s: pd.Series, most: int) -> Iterator[pd.Series]:
    """A batch in runs of rows of about ``most`` characters or ids (one row at least)."""
    size = np.cumsum([0 if x is None else len(x) for x in s])
    cuts = np.flatnonzero(np.diff(size // most)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(s)]):
        yield s.iloc[lo:hi]


def subword_ids(text, path: str = VOCABULARY):
    """Column of ids (null text: null)."""
    content = read_vocabulary(path)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(content)
        for batch in batches:
            for s in _pieces(batch, PIECE):
                out = [None] * len(s)
                at = s.notna().to_numpy().nonzero()[0]
                for i, e in zip(at, t.encode_batch(s.iloc[at].tolist(), add_special_tokens=False)):
                    out[i] = np.array(e.ids, np.int32)
                yield pd.Series(out, dtype=object)
    return run(text)


def subword_text(ids, path: str = VOCABULARY):
    """Column of texts from ids (null: null); the label mask is skipped."""
    content = read_vocabulary(path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(content)
        for batch in batches:
            for s in _pieces(batch, PIECE):
                yield pd.Series([None if x is None else t.decode([int(i) for i in x if i != IGNORE_ID], skip_special_tokens=False)
                                 for x in s], dtype=object)
    return run(ids)


def encode_subwords(df: DataFrame, text_col: str, out: str = "input_ids", max_length: int | None = None,
                    end_id: int | None = None, prefix_id: int | None = None, path: str = VOCABULARY) -> DataFrame:
    """``df`` with ``out``: ids of the text, a language id in front and an end id
    behind where given, ``max_length`` ids in all.  A null text counts as empty."""
    ids = F.coalesce(subword_ids(F.col(text_col), path), F.array().cast("array<int>"))
    if max_length is not None:
        ids = F.slice(ids, 1, max(max_length - (end_id is not None) - (prefix_id is not None), 0))
    ends = [F.array(F.lit(x)) for x in (prefix_id, end_id) if x is not None]
    if prefix_id is not None:
        ids = F.concat(ends[0], ids)
    if end_id is not None:
        ids = F.concat(ids, ends[-1])
    return df.withColumn(out, ids)


def encode_subword_pairs(pairs: DataFrame, src: str, tgt: str, max_length: int, pad_id: int, end_id: int,
                         path: str = VOCABULARY) -> DataFrame:
    """``pairs`` with input_ids, attention_mask and labels as a trainer wants
    them: ``max_length`` ids, padded places of the labels masked with -100.
    ``pad_id`` must be no id of a text."""
    enc = encode_subwords(encode_subwords(pairs, src, "input_ids", max_length, end_id, path=path),
                          tgt, "labels", max_length, end_id, path=path)
    enc = enc.withColumns({c: pad_fixed(c, max_length, pad_id) for c in ("input_ids", "labels")})
    return enc.withColumns({"labels": mask_labels("labels", pad_id), "attention_mask": attention_mask("input_ids", pad_id)})
