"""Consistent placement of rows on shards through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table. The shards
take turns, each claiming the first slot of its order that is still free, until the table is
full. A row hashes to a slot and the slot names its shard, so a lookup takes constant time; when
a shard leaves, nearly all other slots keep their owner.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table is broadcast: at most this many slots, about 12 bytes each.
MAX_SLOTS = 1 << 22
#: Production settings of the registered query.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's walk over the slots: a full permutation, as ``slots`` is prime."""
    digest = hashlib.md5(shard.encode()).digest()
    offset = int.from_bytes(digest[:8], "big") % slots
    step = int.from_bytes(digest[8:], "big") % (slots - 1) + 1
    return offset, step


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Index of the owning shard for each slot.

    Shards take turns in sorted order of name, so the table doesn't depend on the order given.
    Raises ``ValueError`` for no or repeated shards, a size that is not prime, fewer slots than
    shards, or more than :data:`MAX_SLOTS`.
    """
    names = sorted(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("shards must be distinct and at least one")
    if slots > MAX_SLOTS or slots < len(names) or not _is_prime(slots):
        raise ValueError(f"slots must be a prime from {len(names)} to {MAX_SLOTS}")
    if slots == 2:
        return [0, len(names) - 1]
    position = [shards.index(n) for n in names]
    walks = [preference(n, slots) for n in names]
    at = [offset for offset, _ in walks]
    owner, claimed = [-1] * slots, 0
    while True:
        for k, (_, step) in enumerate(walks):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step) % slots
            owner[at[k]] = position[k]
            claimed += 1
            if claimed == slots:
                return owner


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """The lookup table as rows ``(_slot, _shard)``, parsed inside the JVM from one literal."""
    owners = json.dumps(lookup_table(list(shards), slots), separators=(",", ":"))
    names = F.from_json(F.lit(json.dumps(list(shards))), "array<string>")
    rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(owners), "array<int>")).alias("_slot", "_at"))
    return rows.select(F.col("_slot").cast("long").alias("_slot"), F.element_at(names, F.col("_at") + 1).alias("_shard"))


def slot_of(key: F.Column, slots: int) -> F.Column:
    """Slot of a string key: the first 60 bits of its MD5 modulo the table's size."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % F.lit(slots)


def place(
    df: DataFrame,
    key: str = "doc_id",
    shards: Sequence[str] = SHARDS,
    slots: int = SLOTS,
    fallback: Sequence[str] = (),
) -> DataFrame:
    """Add ``slot`` (long) and ``shard`` (string) to every row; no shuffle.

    The table is broadcast (its size is a parameter, at most :data:`MAX_SLOTS` rows); the rows
    stay where they are. Equal keys always meet on one shard, so repeated rows stay together.
    A null key is placed by the ``fallback`` columns instead, which spreads such rows; where all
    of these are null too, the row goes to the slot of the empty key. Columns of the input
    already named ``slot`` or ``shard`` are replaced. An empty input gives an empty result.
    """
    names = df.columns
    inner = df.toDF(*[f"c{k}" for k in range(len(names))])  # no name of the input meets one of the table
    at = {c: F.col(f"c{names.index(c)}").cast("string") for c in (key, *fallback)}
    parts = [F.coalesce(at[c], F.lit("")) for c in fallback]
    text = F.coalesce(at[key], F.concat_ws("\x1f", F.lit("null"), *parts))
    keep = [F.col(f"c{k}").alias(c) for k, c in enumerate(names) if c.lower() not in ("slot", "shard")]
    keyed = inner.withColumn("_slot", slot_of(text, slots))
    table = F.broadcast(table_frame(df.sparkSession, shards, slots))
    placed = keyed.join(table, "_slot", "left")
    return placed.select(*keep, F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))
