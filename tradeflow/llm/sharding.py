"""Sharding by extendible hashing: a directory over hash-prefix bits, split where too large."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import other_columns, staged

#: Bytes of text in a shard.
LIMIT_BYTES = 64 << 20
_BITS = 64
#: Bits that a directory is deeper than evenly filled shards need, and bits that a
#: further level adds below cells that are still too large.
_SPARE, _STEP = 4, 8


def hash_bits(columns: list[str]) -> Column:
    """64 bits of a row's hash as text of 0 and 1; nulls count as a value of their own."""
    parts = [
        F.coalesce(F.md5(F.col(c).cast("string")), F.lit("null")) for c in columns
    ]
    first = F.substring(F.md5(F.concat_ws("/", *parts)), 1, _BITS // 4)
    return F.lpad(F.conv(first, 16, 2), _BITS, "0")


def _level(rows: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """Cells of `depth` bits with the shallowest bucket below `above` bits that holds each and fits.

    Where none does, `bucket_depth` is null: the cell must be split further.
    """
    cells = rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("n_bytes").alias("n"))
    levels = F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("bucket_depth")
    buckets = cells.select("cell", "n", levels).withColumn("shard", F.expr("substr(cell, 1, bucket_depth)"))
    sized = buckets.groupBy("bucket_depth", "shard").agg(F.sum("n").alias("shard_bytes"))
    fitting = sized.filter(F.col("shard_bytes") <= limit)
    if depth == _BITS:  # rows alike in all bits stay together, whatever they hold
        fitting = sized.filter((F.col("shard_bytes") <= limit) | (F.col("bucket_depth") == depth))
    chosen = buckets.join(fitting, ["bucket_depth", "shard"]).groupBy("cell").agg(
        F.min(F.struct("bucket_depth", "shard", "shard_bytes")).alias("bucket")
    )
    return cells.select("cell").join(chosen, "cell", "left").select("cell", "bucket.*")


def assign_shards(
    docs: DataFrame,
    limit: int = LIMIT_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_bits: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, shard, shard_depth, shard_bytes, fits) for each row.

    A shard is the shortest prefix of hash bits whose texts fit `limit`, while the
    prefix one bit shorter does not. The hash covers id and text, so that rows with one
    id can still be split; only equal rows cannot, and a row larger than the limit stays
    alone or with its equals: both have fits = false. Null texts have no bytes. Only ids, bits and
    sizes are shuffled, never texts. Cells are summed before the shuffle; what is too
    large at the depth of the directory is split further by itself, level by level.
    """
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rows = staged(
        docs.select(F.col(id_col), size.alias("n_bytes"), hash_bits([id_col, text_col]).alias("bits")), "hashed"
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + _SPARE)
    above, parts, pending = 0, [], rows
    while True:
        directory = staged(_level(pending, above, depth, limit), "directory")
        keyed = pending.withColumn("cell", F.substring("bits", 1, depth))
        parts.append(keyed.join(directory.filter("shard is not null"), "cell"))
        split = directory.filter("shard is null").select("cell")
        if split.isEmpty():
            break
        pending = staged(keyed.join(split, "cell", "left_semi").drop("cell"), "pending")
        above, depth = depth + 1, min(_BITS, depth + _STEP)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        id_col,
        *(["bits"] if with_bits else []),
        "n_bytes",
        "shard",
        F.col("bucket_depth").alias("shard_depth"),
        "shard_bytes",
        (F.col("shard_bytes") <= limit).alias("fits"),
    )


def write_shards(
    docs: DataFrame, path: str, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Writes docs to one folder shard=<bits> for each shard; a shard fits one task by its limit."""
    shards = assign_shards(docs, limit, id_col, text_col, with_bits=True).select("bits", "shard").distinct()
    kept = docs.select(*other_columns(docs, ["shard", "bits"])).withColumn(
        "bits", hash_bits([id_col, text_col])
    )
    placed = kept.join(shards, "bits").drop("bits")
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
