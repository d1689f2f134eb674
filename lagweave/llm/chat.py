"""Chat formatting with collapse of cumulative snapshots.

A logging client often stores a conversation again after every turn, so one conversation is
a prefix of another. Each turn gets a hash of its position, role and text; running sums of
these (128 bits in two numbers) are hashes of every prefix. A conversation whose whole hash
is a proper prefix of another one goes by an anti-join, equal ones leave the smallest id,
and the maximal ones are rendered turn by turn.

Running sums are taken in blocks of ``BLOCK`` turns: totals by block, then blocks by
conversation, so one very long conversation is shared by many tasks. Rendered text comes in
parts of ``BLOCK`` turns for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

BLOCK = 512

#: The frame of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hashes() -> list[Column]:
    """Four 32-bit hashes of a turn; their sums stay below 2^63 in any conversation."""
    body = F.sha2(F.concat_ws("\x1f", F.col("position").cast("string"), F.length("role").cast("string"), "role", F.hex("digest")), 256)
    return [F.conv(F.substring(body, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]


def numbered_turns(turns: DataFrame, with_text: bool = False) -> DataFrame:
    """(conv_id, block, position, role, digest and, if asked for, text) of turns in order of turn, role and digest.

    digest is the SHA-256 of the text, as bytes. A null role or text counts as empty, a null turn
    comes first; a row that repeats another in all of these counts once. Rows with a null
    conv_id belong to no conversation and are left out. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), *[text.alias("text")] * with_text)
    rows = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text")) if with_text else rows.distinct()
    # by blocks of the turn number, so that no conversation is sorted in one task
    rows = rows.withColumn("_cut", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    sizes = rows.groupBy("conv_id", "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("conv_id", "_cut").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")) - 1
    placed = rows.withColumn("_inner", inner).join(starts, ["conv_id", "_cut"])
    position = F.col("_start") + F.col("_inner")
    return placed.select("conv_id", F.floor(position / BLOCK).alias("block"), position.alias("position"), "role", "digest", *["text"] * with_text)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, position, prefix): the hash of each conversation's first position + 1 turns."""
    hashed = turns.select("conv_id", "block", "position", *_turn_hashes())
    names = [f"h{i}" for i in range(4)]
    sums = hashed.groupBy("conv_id", "block").agg(*[F.sum(h).alias(f"b{h}") for h in names])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"b{h}").over(before), F.lit(0)).alias(f"s{h}") for h in names])
    within = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.select("conv_id", "block", "position", *[F.sum(h).over(within).alias(h) for h in names]).join(starts, ["conv_id", "block"])
    # a digest of the sums, as 16 bytes
    whole = F.concat_ws("-", *[(F.col(h) + F.col(f"s{h}")).cast("string") for h in names])
    return running.select("conv_id", "position", F.unhex(F.md5(whole.cast("binary"))).alias("prefix"))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_collapsed) of the conversations that prefix no longer one; of equal ones the smallest id.

    n_collapsed counts equal conversations that went for it.
    """
    last = prefixes.groupBy("conv_id").agg(F.max_by("prefix", "position").alias("prefix"), F.max("position").alias("position"))
    whole = last.groupBy("prefix", "position").agg(F.min("conv_id").alias("conv_id"), (F.count(F.lit(1)) - 1).alias("n_collapsed"))
    inner = prefixes.join(last.select("conv_id", F.col("position").alias("end")), "conv_id").where("position < end").select("prefix", "position").distinct()
    kept = whole.join(inner, ["prefix", "position"], "left_anti")
    return kept.select("conv_id", (F.col("position") + 1).cast("long").alias("n_turns"), F.col("n_collapsed").cast("long").alias("n_collapsed"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_collapsed, rendered): the text of maximal conversations in parts of ``BLOCK`` turns."""
    line = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    own = turns.select("conv_id", "block", F.struct("position", line.alias("line")).alias("turn")).join(kept, "conv_id")
    parts = own.groupBy("conv_id", "block", "n_turns", "n_collapsed").agg(F.array_sort(F.collect_list("turn")).alias("lines"))
    return parts.select("conv_id", F.col("block").cast("long").alias("part"), "n_turns", "n_collapsed", F.array_join(F.transform("lines", lambda t: t["line"]), "").alias("rendered"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Collapse cumulative snapshots of (conv_id, turn, role, text) and render what stays (see ``render``).

    Texts take part as digests until it is known which conversations stay.
    """
    kept = storage.settle(maximal_conversations(storage.settle(prefix_hashes(numbered_turns(turns)))))
    return render(numbered_turns(turns.join(kept, "conv_id", "left_semi"), with_text=True), kept)


#: The same result in DuckDB, by comparing whole lists of turns.
ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS position FROM turns
), hashed AS (
  SELECT *, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '|')
    OVER (PARTITION BY conv_id ORDER BY position)) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM placed
), whole AS (
  SELECT prefix, n, min(conv_id) AS conv_id, count(*) - 1 AS n_collapsed FROM hashed WHERE position = n - 1 GROUP BY prefix, n
), kept AS (
  SELECT w.* FROM whole w ANTI JOIN (SELECT DISTINCT prefix FROM hashed WHERE position < n - 1) p USING (prefix)
)
SELECT conv_id, CAST(position // {BLOCK} AS BIGINT) AS part, CAST(k.n AS BIGINT) AS n_turns, CAST(n_collapsed AS BIGINT) AS n_collapsed,
  string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '' ORDER BY position) AS rendered
FROM kept k JOIN placed USING (conv_id) GROUP BY ALL
"""
