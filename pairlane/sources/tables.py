"""Reading and writing tables, file audits and file indexes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlane.functions.storage import qualified


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, txt_separator: str = "\t") -> DataFrame:
    """A table by its suffix: .parquet, .csv, .tsv or .txt (tab by default). Text tables have a header."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    separators = {"csv": ",", "tsv": "\t", "txt": txt_separator}
    if suffix not in separators:
        raise ValueError(f"unknown table suffix: {suffix}")
    reader = spark.read.option("header", True).option("sep", separators[suffix])
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    """Write by suffix (.csv, .tsv, else Parquet), partitioned by ``by``; gives back the path."""
    writer = df.write.partitionBy(*by) if by else df.write
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        writer.option("header", True).option("sep", "," if suffix == "csv" else "\t").csv(path)
    else:
        writer.parquet(path)
    return path


def read_layer(expr: DataFrame, layer: str | None = None) -> DataFrame:
    """The long matrix of one layer (``X`` if none is named), non-zeros only, as doubles."""
    if "layer" in expr.columns:
        expr = expr.where(F.col("layer") == (layer or "X"))
    return expr.withColumn("value", F.col("value").cast("double")).where("value is not null and value <> 0")


def matrix_to_long(cells: DataFrame, vec: str = "vec", key: str = "cell_id") -> DataFrame:
    """Array rows as (key, gene_pos, value)."""
    return cells.select(key, F.posexplode(vec).alias("gene_pos", "value"))


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length) to (path, length, sha256): each file is read in blocks of 4 MB."""
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
            digest = hashlib.sha256()
            with store.open_input_stream(inner) as stream:
                while block := stream.read(1 << 22):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(digests, pa.string())], ["path", "length", "sha256"])


#: Fixed value: sha256 of no bytes.
_EMPTY = hashlib.sha256().hexdigest()


def _plain(path: Column) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")


def file_checksums(spark: SparkSession, root: str, pattern: str = "*", most_bytes: int = 1 << 26) -> DataFrame:
    """(path, name, bytes, sha256) of every file below ``root``, empty ones too; ``name`` is the path below ``root``.

    Files of up to ``most_bytes`` are rows of Spark's reader, longer ones are streamed in blocks, one
    file in a partition, so that a file of any length takes bounded memory. The filters on the length
    reach the scan: no content of a longer file is read as a row. Spark's listing knows empty files, but its
    scan gives no rows for them; they are those of the listing without a row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    small = files.where(F.col("length") <= most_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > most_bytes).select("path", "length").repartition("path").mapInArrow(_stream_digests, "path string, length long, sha256 string")
    listed = spark.createDataFrame([(unquote(x),) for x in files.inputFiles()], "path string")
    some = files.select(_plain(F.col("path")).alias("plain"))
    empty = listed.withColumn("plain", _plain(F.col("path"))).join(some, "plain", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(_EMPTY).alias("sha256"))
    below = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "", qualified(spark, root)).rstrip("/")
    name = F.substring(_plain(F.col("path")), len(below) + 2, 1 << 30)
    return small.unionByName(large).unionByName(empty).select("path", name.alias("name"), F.col("length").alias("bytes"), "sha256")


def audit_files(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Status of each expected (name, sha256), names as paths below the root: reused, mismatch or missing. An empty or NULL sha256 takes any content."""
    seen = found.select("name", F.col("sha256").alias("found_sha256"))
    wanted = F.nullif(F.trim(F.lower("sha256")), F.lit(""))
    status = F.when(F.col("found_sha256").isNull(), "missing").when(wanted.isNull() | (F.col("found_sha256") == wanted), "reused").otherwise("mismatch")
    return expected.join(seen, "name", "left").withColumn("status", status)


def index_files(spark: SparkSession, root: str, pattern: str, keys: list[str]) -> DataFrame:
    """Files below ``root`` with the ``key=value`` parts of their paths; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.select("path", "length", *[F.regexp_extract("path", rf"/{k}=([^/]+)", 1).alias(k) for k in keys])


def assemble_shards(shards: list[DataFrame], targets: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows of all shards placed at their target; ``covered`` tells a target without a shard row."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
    return targets.join(whole.withColumn("covered", F.lit(True)), key, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def assemble_chunks(chunks: DataFrame, order: str = "prepared_order", vec: str = "vec") -> DataFrame:
    """Chunk embeddings in prepared order; rows whose dimension is not the common one raise an error."""
    sizes = chunks.agg(F.min(F.size(vec)).alias("low"), F.max(F.size(vec)).alias("high"))
    checked = chunks.crossJoin(F.broadcast(sizes))  # one row
    right = F.when(F.col("low") == F.col("high"), F.col(vec)).otherwise(F.raise_error(F.lit("embedding chunks differ in dimension")))
    return checked.withColumn(vec, right).drop("low", "high").orderBy(order)


def attach_embedding(cells: DataFrame, embedding: DataFrame, key: str = "cell_id", vec: str = "vec") -> DataFrame:
    """Cells with their embedding; a cell without one raises an error."""
    joined = cells.join(embedding.select(key, F.col(vec).alias("embedding")), key, "left")
    return joined.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.lit("a cell has no embedding"))).otherwise(F.col("embedding")))
