"""Extendible hashing of documents into shards of bounded bytes.

The directory is indexed by the leading bits of a key's hash. It begins with one bucket;
only a bucket beyond the limit is split, on the next bit, until every bucket fits or holds
a single hash. Splits don't move data: bytes are summed by the leading bits, down to cells
much smaller than the limit, and the sums of cells are the sizes of all shallower buckets.
A bucket is in the directory if it fits and the bucket of one bit less doesn't. Only cells
that are still too large are summed again, ``MORE_BITS`` deeper each time.

Rows are hashed by their id and text, so a frequent or null id spreads. Only rows equal in
both can't be told apart by any bit; beyond the limit they are one shard marked oversized,
with its bytes, for a writer to cut into several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

HASH_BITS = 60
MORE_BITS = 6
#: Levels that are summed from the same cells.
LEVELS = 3


def key_hash(key: Column, text: Column) -> Column:
    """The leading 60 bits of the md5 of a key and its text's md5; nulls count as empty texts."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def _sums(n_rows: Column) -> list[Column]:
    return [F.sum("bytes").alias("bytes"), F.sum(n_rows).alias("n_rows"), F.min("low").alias("low"), F.max("high").alias("high")]


def _rolled_up(cells: DataFrame, base: int, depth: int) -> DataFrame:
    """Sums of cells of ``depth`` bits for all their prefixes of base bits on: (depth, prefix, sums), settled.

    A few levels at a time are summed from the shallowest ones so far, of which there are fewer
    and fewer, so a cell isn't copied once for every level.
    """
    out, at, top = None, depth, depth
    while True:
        low = max(base, top - LEVELS + 1)
        rows = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(top)))).withColumn("prefix", F.expr(f"shiftright(cell, {at} - depth)"))
        part = storage.settle(rows.groupBy("depth", "prefix").agg(*_sums(F.col("n_rows"))))
        out = part if out is None else out.unionByName(part)
        if low == base:
            return out
        cells, at, top = part.where(F.col("depth") == low).withColumn("cell", F.col("prefix")).drop("depth", "prefix"), low, low - 1


def _round(rows: DataFrame, limit: int, base: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Buckets of depths base to ``depth`` of settled rows (h, bytes): the leaves among them, and cells still too large."""
    cells = rows.withColumns({"cell": F.shiftright("h", HASH_BITS - depth), "low": F.col("h"), "high": F.col("h")}).groupBy("cell").agg(*_sums(F.lit(1)))
    levels = _rolled_up(cells, base, depth).withColumn("fits", (F.col("bytes") <= limit) | (F.col("low") == F.col("high")))
    parents = levels.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    below = levels.where("fits").withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi").drop("parent")
    # the shallowest level of a later round lies below buckets that were too large
    leaves = below.unionByName(levels.where((F.col("depth") == base) & F.col("fits")))
    return leaves, levels.where((F.col("depth") == depth) & ~F.col("fits"))


def shards(docs: DataFrame, limit: int, id_column: str = "doc_id", text_column: str = "text", first_bits: int | None = None) -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, shard_rows, oversized) of every row.

    shard holds the leading bits of its documents' hashes as 0s and 1s; it is empty if one
    shard holds all. bytes are those of the text in UTF-8, 0 for a null text; null ids and
    texts are placed like empty ones, and only rows equal in id and text must stay together.
    Empty tables stay empty. Other columns are not read.
    """
    key, text = F.col(f"`{id_column}`"), F.col(f"`{text_column}`")
    rows = storage.settle(docs.select(key.alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), key_hash(key, text).alias("h")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    # cells of a 64th of the limit on average
    depth = first_bits if first_bits is not None else min(HASH_BITS, (total // max(limit, 1)).bit_length() + 6)
    done, left, base = [], rows, 0
    while True:
        leaves, large = _round(left, limit, base, depth)
        last = depth == HASH_BITS
        done.append(_placed(left, leaves, base, depth))
        if last or large.isEmpty():
            break
        cell = F.shiftright("h", HASH_BITS - depth)
        left = left.withColumn("_cell", cell).join(large.select(F.col("prefix").alias("_cell")), "_cell", "left_semi").drop("_cell")
        left, base = storage.settle(left), depth + 1
        depth = min(HASH_BITS, depth + MORE_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.expr(f"right(lpad(conv(cast(prefix as string), 10, 2), {HASH_BITS}, '0'), depth)")
    return out.select("doc_id", "bytes", bits.alias("shard"), "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized"))


def _placed(rows: DataFrame, leaves: DataFrame, base: int, depth: int) -> DataFrame:
    """Rows with their leaf; each leaf is looked up by the cells below it."""
    span = F.expr(f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)")
    cells = leaves.select(F.explode(span).alias("_cell"), "depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"))
    return rows.withColumn("_cell", F.shiftright("h", HASH_BITS - depth)).join(cells, "_cell").select("doc_id", "bytes", "depth", "prefix", "shard_bytes", "shard_rows")


def oracle_sql(limit: int) -> str:
    """The same result in DuckDB."""
    return f"""
WITH rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h,
    row_number() OVER () AS i
  FROM documents
), buckets AS (
  SELECT depth, h >> ({HASH_BITS} - depth) AS prefix, sum(bytes) AS shard_bytes, count(*) AS shard_rows, min(h) = max(h) AS single
  FROM rows CROSS JOIN (SELECT unnest(range(0, {HASH_BITS} + 1)) AS depth) GROUP BY ALL
), placed AS (
  SELECT r.doc_id, r.bytes, min(struct_pack(d := b.depth, prefix := b.prefix, b := b.shard_bytes, n := b.shard_rows)) AS x
  FROM rows r JOIN buckets b ON b.prefix = r.h >> ({HASH_BITS} - b.depth)
  WHERE b.shard_bytes <= {limit} OR b.single GROUP BY r.doc_id, r.bytes, r.i
)
SELECT doc_id, bytes, CASE WHEN x.d = 0 THEN '' ELSE right(lpad(bin(x.prefix), {HASH_BITS}, '0'), CAST(x.d AS INT)) END AS shard,
  CAST(x.d AS INT) AS depth, CAST(x.b AS BIGINT) AS shard_bytes, CAST(x.n AS BIGINT) AS shard_rows, x.b > {limit} AS oversized
FROM placed
"""
