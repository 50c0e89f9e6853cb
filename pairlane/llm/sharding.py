"""Sharding by jump consistent hashing (DataFrame functions only).

The jump sequence of a key does not depend on the number of shards: it is a strictly
growing list of shard numbers, and a key lies in the last one below the shard count.
Appending shards therefore moves only the keys whose next jump falls into a new shard,
about ``added / total`` of them, and no ring table is kept or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm.common import named, others, ranged, read, running, saved

SHARDS = 24
_BITS = 52


def _jumps(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among ``shards`` and among ``shards + 1``."""

    def step(state: Column, i: Column) -> Column:
        digest = F.md5(F.concat_ws("|", key, i.cast("string")))
        bits = F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long")
        jump = F.floor((state["next"] + 1) / ((bits + 1) / F.lit(float(1 << _BITS)))).cast("long")
        onward = lambda shard: F.struct(shard.alias("shard"), state["next"].alias("grown"), jump.alias("next"))
        return F.when(state["next"] < shards, onward(state["next"])).when(state["next"] == shards, onward(state["shard"])).otherwise(state)

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("shard"), zero.alias("grown"), zero.alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step)


def assign_shards(df: DataFrame, key: str, shards: int = SHARDS, order: list[str] | None = None) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with one shard more) and ``slot`` to every row.

    Slots are gapless from 0 in each shard, in the order of a digest of the key, then the
    key, then ``order``. NULL keys count as the empty string and share a shard; equal keys
    always share one. Rows that agree in key and ``order`` get their slots in any order: their row
    numbers split them, so a key may hold any share of the table. An empty table gives an empty
    result. Columns called shard, grown_shard or slot are replaced; every other column stays.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    kept = map(named, others(df, "shard", "grown_shard", "slot"))
    by = [key, *(order or [])]
    rows = df.select(F.struct(*kept).alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(by)])
    rows = rows.withColumn("at", _jumps(F.col("text"), shards)).withColumn("digest", F.md5("text"))
    rows = saved(rows.select("*", F.col("at.shard").cast("int").alias("shard"), F.col("at.grown").cast("int").alias("grown_shard"), F.monotonically_increasing_id().alias("row_id")).drop("at", "text"))
    sort = ["digest", *[f"by{i}" for i in range(len(by))], "row_id"]
    slots = running(ranged(rows.select("shard", *sort), sort), ["shard"], "_part", sort, F.lit(1).cast("long"), "upto")
    return rows.join(slots.select("row_id", (F.col("upto") - 1).alias("slot")), "row_id").select("row.*", "shard", "grown_shard", "slot")


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign_shards(slim, "doc_id", SHARDS, ["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: crc32 by its table of 256 remainders, jumps by recursion.
OP3_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS remainders
), d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, ''))) + 8 AS size, xor(list_reduce(
           list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
           lambda c, x: xor(c >> 8, crc.remainders[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32
  FROM documents, crc
), j AS (
  SELECT DISTINCT k, 0 AS i, 0::BIGINT AS shard, 0::BIGINT AS grown, 0::BIGINT AS onward FROM d
  UNION ALL
  SELECT k, i + 1, CASE WHEN onward < {SHARDS} THEN onward ELSE shard END, CASE WHEN onward <= {SHARDS} THEN onward ELSE grown END,
         CASE WHEN onward <= {SHARDS} THEN floor((onward + 1) / ((('0x' || substr(md5(k || '|' || (i + 1)::VARCHAR), 1, {_BITS // 4}))::BIGINT + 1) / {1 << _BITS}.0::DOUBLE))::BIGINT ELSE onward END
  FROM j WHERE i <= {SHARDS}
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(d.k), doc_id, size, text_crc32) - 1 AS slot, grown::INTEGER AS grown_shard
FROM d JOIN j ON j.k = d.k AND j.i = {SHARDS} + 1
"""

QUERIES = {"op3_jump_shards": op3_jump_shards}
ORACLES = {"op3_jump_shards": OP3_SQL}
