"""SimHash fingerprints and their near-duplicate groups by bit-sliced comparison.

Links join fingerprints that differ in at most ``radius`` bits. Copies share a fingerprint,
so only distinct ones are compared. By the pigeonhole principle two linked fingerprints
agree in one of ``radius + 1`` blocks of bits, so each is dealt into one bucket a block, by
as many bits of the block as make buckets of about ``BUCKET`` fingerprints; above that,
blocks of the remaining bits deal buckets further in the same way. A bucket beyond
``TILE`` is cut into tiles, and each pair of tiles is compared on its own: nothing is
dropped, and no task gets more than two tiles.

In a bucket the fingerprints are stored vertically, a plane of 64-lane words for each bit.
Many queries at once are XORed against the planes, a saturating carry-save counter of three
planes holds all distances, and words whose lanes all exceed the radius are abandoned.
A bucket gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow, components, ragged, storage

U64 = np.uint64
SHINGLE = 3
SEED = 42

#: Fingerprints in a bucket that the key bits aim at, and in a tile at most.
BUCKET, TILE = 4096, 16384
QUERIES = 128

#: The five primes of XXH64.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
P1, P2, P3, P4, P5 = map(U64, PRIMES)


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span of bytes, all spans at once."""
    with np.errstate(over="ignore"):
        return _xxh64(buf, starts, ends - starts, U64(seed))


def _xxh64(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: np.uint64) -> np.ndarray:
    at = ragged.lanes(buf)
    out = np.full(len(starts), seed + P5, U64)
    long = np.flatnonzero(sizes >= 32)
    if len(long):
        acc = [np.full(len(long), x, U64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        live, done = np.arange(len(long)), 0
        while len(live):
            for k in range(4):
                acc[k][live] = _rotate(acc[k][live] + at[starts[long[live]] + done + 8 * k] * P2, 31) * P1
            done += 32
            live = live[sizes[long[live]] >= done + 32]
        whole = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
        for x in acc:
            whole = (whole ^ (_rotate(x * P2, 31) * P1)) * P1 + P4
        out[long] = whole
    out += sizes.astype(U64)
    pos, left = starts + (sizes & ~31), sizes & 31
    for _ in range(3):
        own = np.flatnonzero(left >= 8)
        out[own] = _rotate(out[own] ^ (_rotate(at[pos[own]] * P2, 31) * P1), 27) * P1 + P4
        pos[own] += 8
        left[own] -= 8
    own = np.flatnonzero(left >= 4)
    out[own] = _rotate(out[own] ^ ((at[pos[own]] & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    pos[own] += 4
    left[own] -= 4
    for _ in range(3):
        own = np.flatnonzero(left > 0)
        out[own] = _rotate(out[own] ^ (buf[pos[own]].astype(U64) * P5), 11) * P1
        pos[own] += 1
        left[own] -= 1
    out = (out ^ (out >> U64(33))) * P2
    out = (out ^ (out >> U64(29))) * P3
    return out ^ (out >> U64(32))


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)  # sums of counts stay exact


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by spaces, starts and ends of all shingles there, each one's text, and their number a text."""
    buf = buf + np.where((buf >= 65) & (buf <= 90), 32, 0).astype(np.uint8)
    starts, ends, first = ragged.words(buf, offsets)
    sizes = ends - starts + 1
    joined = np.full(int(sizes.sum()), 32, np.uint8)  # all words, a space behind each
    edge = ragged.bounds(sizes)
    inside = np.ones(len(joined), bool)
    inside[edge[1:] - 1] = False
    joined[inside] = ragged.gather(buf, starts, ends - starts)
    n_words = np.diff(first)
    counts = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    word = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc]
    last = np.minimum(word + size, first[doc + 1])
    return joined, edge[word], edge[last] - 1, doc, counts


def majorities(hashes: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 64-bit number of each text whose bits are set in over half of its hashes."""
    out = np.zeros(len(counts), U64)
    for k in range(8):
        byte = ((hashes >> U64(8 * k)) & U64(255)).astype(np.int64)
        ones = np.bincount(doc * 256 + byte, minlength=len(counts) * 256).reshape(-1, 256) @ _BITS
        majority = 2 * ones > counts[:, None]
        out |= (majority.astype(U64) << (U64(8 * k) + np.arange(8, dtype=U64))).sum(1, dtype=U64)
    return out


def fingerprint_texts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text, as an unsigned 64-bit integer."""
    joined, starts, ends, doc, counts = shingles(buf, offsets, SHINGLE)
    return majorities(xxh64(joined, starts, ends), doc, counts)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row's whole text; null and empty texts get 0. One pass without a shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = fingerprint_texts(*ragged.text_bytes(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return arrow.map_texts(docs, run, "doc_id long, fp long", [F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text")])


def planes_of(prints: np.ndarray) -> np.ndarray:
    """64 rows, one a bit, of words whose lanes are the fingerprints; the last word's spare lanes are 0."""
    words = -(-len(prints) // 64)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((words * 64, 64), np.uint8)
    lanes[: len(prints)] = bits
    return np.packbits(lanes.T.copy(), axis=1, bitorder="little").view("<u8")


def close_pairs(queries: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, print) positions within the radius (at most 3), for some queries after another."""
    if not 0 <= radius <= 3:
        raise ValueError("the counter holds distances of 0 to 3")
    planes = planes_of(prints)
    words = planes.shape[1]
    spare = np.zeros(words, U64)
    if len(prints) % 64:
        spare[-1] = ~U64(0) << U64(len(prints) % 64)
    step = max(1, min(QUERIES, (1 << 16) // max(words, 1)))
    for start in range(0, len(queries), step):
        own = queries[start : start + step]
        mask = (U64(0) - ((own[:, None] >> np.arange(64, dtype=U64)) & U64(1)))  # all ones where the bit is set
        row, word = np.repeat(np.arange(len(own)), words), np.tile(np.arange(words), len(own))
        ones, twos, over = np.zeros((3, len(row)), U64)
        over |= spare[word]
        for bit in range(64):
            if bit < 12:  # no block can be abandoned this early: no gathering
                x = (mask[:, bit, None] ^ planes[bit]).ravel()
            else:
                x = mask[row, bit] ^ planes[bit, word]
            carry = ones & x
            ones = ones ^ x
            over = over | (twos & carry)
            twos = twos ^ carry
            if bit >= 11 and bit % 4 == 3:
                live = np.flatnonzero(over != ~U64(0))
                if len(live) < len(row):
                    row, word, ones, twos, over = row[live], word[live], ones[live], twos[live], over[live]
                if not len(live):
                    break
        if not len(row):
            continue
        near = ~over
        for k in range(radius + 1, 4):  # a smaller radius: lanes whose count is k are too far
            near &= ~((ones if k & 1 else ~ones) & (twos if k & 2 else ~twos))
        hit = np.flatnonzero(near)
        lanes = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(lanes)
        yield start + row[hit[i]], word[hit[i]] * 64 + lane


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links between positions below ``n``; each array of first ends is grouped by value."""
    label = np.arange(n)
    for i, j in pairs:
        cut = np.flatnonzero(np.diff(i)) + 1
        for own, near in zip(i[np.concatenate([[0], cut])] if len(i) else [], np.split(j, cut)):
            roots = np.unique(np.append(label[near], label[own]))
            if len(roots) > 1:
                label[np.isin(label, roots[1:])] = roots[0]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``left``, or between left and right."""
    nodes = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    a, b = spanning(((i, j + shift) for i, j in close_pairs(left, nodes[shift:], radius)), len(nodes))
    return nodes[a], nodes[b]


def bucket_keys(fp: Column, radius: int, bits: int) -> list[Column]:
    """Keys of which two fingerprints within the radius share one: of about ``bits`` bits each."""
    blocks = radius + 1
    width = 64 // blocks

    def field(column: Column, low: int, n: int) -> Column:
        return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << n) - 1))

    if bits <= width:
        return [field(fp, i * width, bits) for i in range(blocks)]
    rest = min(bits - width, (64 - width) // blocks)
    inner = (64 - width) // blocks
    out = []
    for i in range(blocks):
        head = field(fp, i * width, width)
        # the other bits, in one number: those above the block over those below it
        low = field(fp, 0, i * width) if i else F.lit(0).cast("long")
        high = F.shiftrightunsigned(fp, (i + 1) * width) if i + 1 < blocks else F.lit(0).cast("long")
        others = F.shiftleft(high, i * width).bitwiseOR(low)
        out += [F.shiftleft(head, rest).bitwiseOR(field(others, j * inner, rest)) for j in range(blocks)]
    return out


def _tiles(dealt: DataFrame, tile: int) -> DataFrame:
    """Rows (fp, block, key) with the pairs of tiles (low, high) they are compared in, and their own tile."""
    tiles = dealt.groupBy("block", "key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")).where("tiles > 1")
    dealt = dealt.join(tiles, ["block", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select("fp", "block", "key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile")


def fingerprint_links(distinct: DataFrame, radius: int = 3, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """Links (a, b) between fingerprints of a settled table of distinct ones that keep all its components."""
    n = distinct.count()
    bits = max(0, (n // bucket).bit_length())
    keys = bucket_keys(F.col("fp"), radius, bits)
    dealt = _tiles(distinct.select("fp", F.posexplode(F.array(*keys)).alias("block", "key")), tile)

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, _, low, high = key
        prints = group["fp"].to_numpy().view(U64)
        mine = (group["tile"] == low).to_numpy()
        a, b = forest(np.sort(prints[mine]), None if low == high else np.sort(prints[~mine]), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("block", "key", "low", "high").applyInPandas(compare, "a long, b long").distinct()


def group_fingerprints(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, group, component_id) of every distinct fingerprint of (doc_id, fp): its group's smallest fingerprint, and the smallest doc_id reachable by links.

    Null ids count in no minimum; a component without any other has a null id.
    """
    distinct = storage.settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components.components(links(distinct.select("fp")))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(whole, "root").select("fp", F.col("root").alias("group"), "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id that links reach from it.

    Texts without words (null ones too) have fingerprint 0 and are linked like any others.
    Repeated rows each give a row. Other columns are not read.
    """
    prints = storage.settle(fingerprints(docs, id_column, text_column))
    groups = group_fingerprints(prints, lambda distinct: fingerprint_links(distinct, radius))
    return prints.join(groups.drop("group"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
