"""Shard placement by a permutation-filled lookup table (operator 8).

Each shard orders the slots of a prime-sized table by its own permutation
(offset + i * skip, from a hash of its name).  Shards take turns; each claims
the first free slot of its order, until the table is full.  Every shard so
gets the same number of slots but one, and when a shard leaves, few slots that
belonged to others change.  A document's slot is a hash of its id, and the
table is broadcast (its size is a parameter, not a function of the data), so
placing a row costs one lookup and no shuffle.

Cases: a null id hashes like the empty string; repeated ids share a shard; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table

N_SHARDS = 64
#: A prime, over a hundred times the number of shards.
TABLE_SIZE = 8191
#: Largest table that is broadcast (12 bytes a slot).
MAX_TABLE = 1 << 20


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def lookup_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard that owns each slot."""
    if not names or len(names) > size:
        raise ValueError("between 1 and `size` shards")
    if size > MAX_TABLE or size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"the table size must be a prime of at most {MAX_TABLE}")
    digests = [hashlib.md5(n.encode()).digest() for n in names]
    slot = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digests]
    owner, filled = [-1] * size, 0
    while True:
        for shard in range(len(names)):
            while owner[slot[shard]] >= 0:
                slot[shard] = (slot[shard] + skip[shard]) % size
            owner[slot[shard]] = shard
            filled += 1
            if filled == size:
                return owner


def place(docs: DataFrame, names: list[str], size: int = TABLE_SIZE, key: str = "doc_id") -> DataFrame:
    """``docs`` with slot and shard (columns of these names are replaced)."""
    owner = lookup_table(names, size)
    slots = docs.sparkSession.createDataFrame(list(enumerate(owner)), "slot long, shard int")
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10)
    rest = [c for c in docs.columns if c not in ("slot", "shard")]
    return (docs.select(*[F.col(f"`{c}`") for c in rest]).withColumn("slot", hashed.cast("long") % size)
            .join(F.broadcast(slots), "slot").select(*[F.col(f"`{c}`") for c in rest], "slot", "shard"))


_SQL = f"""
SELECT doc_id, slot, ({lookup_table(shard_names(N_SHARDS))})[slot + 1] AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot
      FROM documents)
"""


@query("op8_maglev", _SQL)
def op8(spark, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), shard_names(N_SHARDS))
