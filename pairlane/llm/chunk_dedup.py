"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so, so equal passages give equal chunks. A
document becomes a *recipe*: the ordered list of its chunks' identifiers, 16 bytes for
about 400 characters. Chunk texts move once, to verify that a digest stands for one text
(equal chunks are merged before that shuffle); from then on only recipes move. Documents
are equal exactly when their recipes are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlane.llm.common import cut, read

#: A chunk has 256 to 2048 code points and ends after the first space past its minimum that
#: stands before one of these letters (about every eighth word); else at its maximum.
CHUNK = r"(?s).{256,2048}?(?:(?<= )(?=[bgkmuvyzBGKMUVYZ5])|\z)|.{1,2048}"
#: Texts with a stretch this long without a space (a script without spaces, encoded data) are cut by ``DENSE``.
STRETCH = "[^ ]{512}"
#: A sixteenth of the characters: some letters and digits, and by code point 4 of each 64 below U+3000 and 32 of each 512 above.
_SOME = "kvyKVY57" + "".join(f"\\u{c:04x}-\\u{c + 3:04x}" for c in range(0x00C0, 0x3000, 64)) + "".join(f"\\u{c:04x}-\\u{c + 31:04x}" for c in range(0x3040, 0xD800, 512))
#: As ``CHUNK``, but where no such space comes, a chunk ends between two characters of that sixteenth.
DENSE = CHUNK.removesuffix("|.{1,2048}") + rf"|.{{256,2048}}?(?<=[{_SOME}])(?=[{_SOME}])|.{{1,2048}}"


def normalise(text: Column) -> Column:
    """Each run of white space becomes one space; NULL becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _digest(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk))


def chunks_of(text: Column) -> Column:
    cut_by = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(STRETCH), cut_by(DENSE)).otherwise(cut_by(CHUNK))


def recipes(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """(row_id, key, recipe, text_sha256) per row, with verified chunk identifiers.

    An identifier is the chunk's digest; where one digest stands for several texts, the
    rank of the text among them is appended, so no two texts share an identifier.
    """
    base = docs.select(F.col(key), normalise(F.col(text)).alias("_text"))
    cuts = base.select(key, F.sha2("_text", 256).alias("text_sha256"), chunks_of(F.col("_text")).alias("_chunks"))
    out = cut(cuts.select(F.monotonically_increasing_id().alias("row_id"), key, F.transform("_chunks", digest).alias("recipe"), "text_sha256"))
    pieces = base.select(F.explode(chunks_of(F.col("_text"))).alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk")
    texts = pieces.dropDuplicates(["digest", "chunk"])
    shared = texts.groupBy("digest").count().where("count > 1").select("digest")
    shared = cut(shared)
    if shared.isEmpty():
        return out
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("chunk"))
    named = texts.join(shared, "digest", "left_semi").withColumn("id", F.concat("digest", F.encode(F.format_string("#%d", rank), "utf-8")))
    # the rare texts with a shared digest, by the text itself
    ids = named.select("chunk", "id")
    hit = base.select(F.sha2("_text", 256).alias("text_sha256"), F.posexplode(chunks_of(F.col("_text"))).alias("pos", "chunk")).dropDuplicates(["text_sha256", "pos"])
    fixed = hit.join(ids, "chunk", "left").withColumn("id", F.coalesce("id", digest(F.col("chunk"))))
    lists = fixed.groupBy("text_sha256").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("_ids"))
    out = out.join(lists, "text_sha256", "left").withColumn("recipe", F.coalesce("_ids", "recipe")).drop("_ids")
    return cut(out)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """One row per input row: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Equal texts (after white space normalisation) form a group, of which the row with the
    smallest key stays; NULL keys come last, and of rows with equal keys one stays. NULL
    text is the empty text. Other columns are not carried. An empty table gives no rows.
    """
    table = recipes(docs, key, text, digest)
    rank = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("row_id").alias("r"))
    groups = table.groupBy("recipe").agg(F.min(rank).alias("first"), F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1")  # single documents keep themselves and need no match
    joined = table.join(cut(groups), "recipe", "left")  # on plain exchanges, so that a group of very many copies can be split
    single = F.col("group_size").isNull()
    return joined.select(
        F.col(key),
        F.when(single, F.col(key)).otherwise(F.col("first.k")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("first.r") == F.col("row_id"))).alias("kept"),
        "text_sha256",
    )


def op4_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, (count(*) OVER g)::BIGINT AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

QUERIES = {"op4_chunk_recipes": op4_chunk_recipes}
ORACLES = {"op4_chunk_recipes": OP4_SQL}
