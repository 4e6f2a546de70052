"""Stable shards by jump consistent hashing (Lamping and Veach, 2014), in column expressions.

A document's shard depends on its id and the number of shards alone: law `key`. Going from n to
n + 1 shards moves a document only into the new shard, and each with probability 1 / (n + 1).

Scale: ids become shards in the scan, no ring table exists, and only narrow rows are shuffled once to
number the slots. A shard that holds most rows is numbered in ranges (`numbering.gapless`).

Defined results: a null id has the key -1; a null text has size 1 and
crc32 0. Repeated rows share a shard and have slots of their own. Slots follow
the order of ids inside a shard. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.numbering import gapless
from pagelathe.runtime import materialize

#: Multiplier of the 64-bit congruential generator in the published algorithm.
_MULTIPLIER = 2862933555777941757
_LIMBS = [(_MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]


def _limb(key: Column, i: int) -> Column:
    return F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _step(key: Column) -> Column:
    """key * _MULTIPLIER + 1 modulo 2**64, in 16-bit limbs: no product overflows under ANSI rules."""
    limbs = [_limb(key, i) for i in range(4)]
    carry: Column = F.lit(1).cast("long")
    out: Column = F.lit(0).cast("long")
    for i in range(4):
        for j in range(i + 1):
            carry = carry + limbs[j] * F.lit(_LIMBS[i - j]).cast("long")
        out = out.bitwiseOR(F.shiftleft(carry.bitwiseAND(F.lit(0xFFFF).cast("long")), 16 * i))
        carry = F.shiftrightunsigned(carry, 16)
    return out


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to `shards` - 1, of a 64-bit key.

    The published loop jumps to a strictly larger bucket each time, so `shards` rounds are enough.
    Rounds after the end change nothing.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(key.alias("key"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("next"))

    def jump(state: Column, _: Column) -> Column:
        moved = _step(state["key"])
        # (b + 1) * 2**31 / ((key >> 33) + 1), in doubles as published
        ahead = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(moved, 33) + 1).cast("double"))).cast("long")
        live = state["next"] < shards
        return F.struct(
            F.when(live, moved).otherwise(state["key"]).alias("key"),
            F.when(live, state["next"]).otherwise(state["bucket"]).alias("bucket"),
            F.when(live, ahead).otherwise(state["next"]).alias("next"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, jump, lambda s: s["bucket"].cast("int"))


def shard_key(id_col: Column) -> Column:
    """The id itself: the generator's first step spreads it. A null id counts as -1."""
    return F.coalesce(id_col.cast("long"), F.lit(-1).cast("long"))


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, law, shard, slot, grown_shard."""
    raw = F.encode(F.col(text_col), "UTF-8")
    key = shard_key(F.col(id_col))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("text_crc32"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    frozen = materialize(narrow, "shards")
    placed = gapless(frozen, ["shard"], ["id", "row"], "slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id") -> None:
    """Write `docs` as Parquet, one folder per shard; a shard is written by many tasks."""
    name = "shard"
    while name in docs.columns:
        name = "_" + name
    docs.withColumn(name, jump_shard(shard_key(F.col(id_col)), shards)).write.partitionBy(name).parquet(path)


_CRC_TABLE = []
for _byte in range(256):
    for _ in range(8):
        _byte = (_byte >> 1) ^ (0xEDB88320 if _byte & 1 else 0)
    _CRC_TABLE.append(_byte)

ORACLE = f"""
WITH RECURSIVE k AS (
  SELECT doc_id, text, row_number() OVER () AS rid,
         (CASE WHEN coalesce(doc_id, -1) < 0 THEN coalesce(doc_id, -1)::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END) AS key
  FROM documents
), jump AS (
  SELECT rid, n, key, 0::BIGINT AS b, 0::BIGINT AS j FROM k, (VALUES (16), (17)) AS sizes(n)
  UNION ALL
  SELECT rid, n, moved, j,
         floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((moved >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT rid, n, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS moved FROM jump WHERE j < n)
), hexed AS (
  SELECT rid, hex(encode(coalesce(text, ''))) AS h FROM k
), crcs AS (
  SELECT rid, xor(4294967295::BIGINT, list_reduce(
           list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
           lambda acc, x: xor(acc >> 8, ({_CRC_TABLE}::BIGINT[])[(xor(acc & 255, x) + 1)::INT]), 4294967295::BIGINT)) AS crc
  FROM hexed
), placed AS (
  SELECT rid, max(CASE WHEN n = 16 THEN b END)::INT AS shard, max(CASE WHEN n = 17 THEN b END)::INT AS grown_shard
  FROM jump GROUP BY rid
)
SELECT k.doc_id,
       (coalesce(strlen(k.text), 0) + 1)::BIGINT AS size,
       c.crc AS text_crc32,
       'key' AS law, p.shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY k.doc_id, k.rid) - 1 AS slot,
       p.grown_shard
FROM k JOIN placed p USING (rid) JOIN crcs c USING (rid)
"""
