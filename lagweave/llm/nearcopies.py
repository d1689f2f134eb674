"""Near copies: texts whose distinct five-word shingles have a Jaccard similarity of ``least`` or more, without a lost link.

Every text has a wide SimHash fingerprint (256 bits, majorities over its distinct shingles).
Which fingerprints are compared is decided by prefixes: two sets that are alike share one of
the first n - ceil(least n) + 1 shingles of either, in any order of all shingles. Here common
shingles come last, so that a passage of many documents brings none of them together; how
common they are is counted over all documents in a table of fixed size. Only sets that share
such a shingle with another set go on.

Each shingle's sets are compared bit by bit: planes hold one bit of 64 sets a word, a tree of
carry-save adders counts the differing bits of all lanes at once, and words whose lanes are
all beyond the radius are abandoned. The radius is so wide that a pair at the least
similarity lies beyond it with a chance below 1e-11, whatever its sets' sizes. The connected
groups of these candidates then move their whole sets of shingles, and similarities are exact.

In a group, sets that were compared with all others are done, and comparison ends as soon as
the rest are connected: copies of one text take about one comparison each. Groups beyond a
task's memory are dealt into parts, each with a few pivots; what is connected to the main
part then stays where it is, and only the other sets visit the other parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, components, ragged, simhash, storage

U64 = np.uint64

#: 64-bit words of a wide fingerprint, and words in its shingles.
WIDE, SHINGLE = 4, 5

#: Differing bits within which two sets are candidates, by the size of the smaller one. The chance of a differing bit is at
#: most 0.1875 at a similarity of 0.8 (4 shingles against those and one more), and 0.158 from 16 shingles on.
RADIUS, SMALL_SET, LARGE_RADIUS = 95, 16, 84
#: The counter of differing bits begins here and saturates at 128.
_HEAD_START = 128 - RADIUS - 1

#: Rows of the table of counts, and cells in each.
COUNT_ROWS, CELL_BITS = 2, 17

#: Sets of one shingle in a task at most, sets compared at once, and bytes of shingle hashes that aim at one part of a group.
TILE, BLOCK_ROWS, PART_BYTES = 4096, 1 << 14, 8 << 20
#: Sets that are dealt to every part of a large group.
PIVOTS = 4


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each whole text, and each text's first (n + 1).

    Without words a text has none; with fewer than five, all its words are one. A-Z are lower-cased.
    """
    joined, starts, ends, doc, counts = simhash.shingles(buf, offsets, SHINGLE)
    hashes = ragged.span_hashes(joined, starts, ends)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[first], ragged.bounds(np.bincount(doc[first], minlength=len(counts)))


def fingerprints(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(sets, WIDE) words of majorities over the hashes of each set."""
    counts = np.diff(edges)
    doc = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        return np.stack([simhash.majorities(ragged.mix(hashes + U64((k + 1) * simhash.PRIMES[0] & (1 << 64) - 1)), doc, counts) for k in range(WIDE)], axis=1)


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits by which equal sets are found."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _cells(hashes: np.ndarray, row: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (ragged.mix(hashes ^ U64(simhash.PRIMES[row + 1])) >> U64(64 - CELL_BITS)).astype(np.int64)


def commonness(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """(COUNT_ROWS, cells) of bytes: 0 for an ordinary cell, one more for each doubling of its shingles beyond.

    All shingles of all texts are counted; a partition gives at most COUNT_ROWS x 2 ^ CELL_BITS sums.
    """

    def add(state: np.ndarray, texts: pa.Array) -> None:
        hashes, _ = shingle_sets(*ragged.text_bytes(texts))
        for row in range(COUNT_ROWS):
            state[row] += np.bincount(_cells(hashes, row), minlength=1 << CELL_BITS)

    def finish(state: np.ndarray) -> pa.RecordBatch:
        flat = state.ravel()
        own = np.flatnonzero(flat)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(flat[own])], ["cell", "n"])

    sums = arrow.fold_texts(docs, lambda: np.zeros((COUNT_ROWS, 1 << CELL_BITS), np.int64), add, finish, "cell long, n long", text_column, ragged.SMALL_SLICE_BYTES)
    found = sums.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most COUNT_ROWS x 2 ^ CELL_BITS rows
    counts = np.zeros(COUNT_ROWS << CELL_BITS)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape(COUNT_ROWS, -1)
    return np.log2(np.maximum(counts / (2 * counts.mean() + 1), 1)).astype(np.uint8)


def prefixes(hashes: np.ndarray, edges: np.ndarray, common: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the shingles that come first, rare ones before common ones: n - ceil(least n) + 1 of n, and their bounds."""
    sizes = np.diff(edges)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    kind = np.minimum.reduce([common[row][_cells(hashes, row)] for row in range(COUNT_ROWS)])
    order = np.lexsort((hashes, kind, doc))
    take = np.minimum(sizes, sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1)
    rank = np.arange(len(doc)) - edges[doc]
    return hashes[order[rank < take[doc]]], ragged.bounds(take)


def _binary(prints: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in prints.astype("<u8")], pa.binary())


def _words(prints: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(prints.to_pylist()), "<u8").reshape(-1, WIDE)


def distinct_sets(docs: DataFrame, common: np.ndarray, least: float, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Settled (sid, key, least_id, n, fp, prefix) of every distinct set of shingles; least_id is its smallest id other than null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, edges = shingle_sets(*ragged.text_bytes(batch.column(1)))
        first, bounds = prefixes(hashes, edges, common, least)
        keys = [set_key(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        prefix = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(first.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(edges)), _binary(fingerprints(hashes, edges)), prefix], ["id", "key", "n", "fp", "prefix"])

    columns = [F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text")]
    rows = arrow.map_texts(docs, run, "id long, key binary, n long, fp binary, prefix array<long>", columns, ragged.SMALL_SLICE_BYTES)
    sets = rows.groupBy("key").agg(F.min("id").alias("least_id"), *[F.first(c).alias(c) for c in ("n", "fp", "prefix")])
    return storage.settle(sets.withColumn("sid", F.monotonically_increasing_id()))


def _full_add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _near(mask: np.ndarray, planes: np.ndarray, row: np.ndarray, word: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, lanes) of the given rows of ``mask`` and words of the planes, where some lane differs in at most RADIUS bits.

    over: lanes that don't count. A word is abandoned when all its lanes are beyond the radius.
    """
    sums = [np.full(len(row), ~U64(0) if _HEAD_START >> k & 1 else U64(0)) for k in range(7)]

    def count(bit: int, n: int, level: int) -> np.ndarray:
        """Adds n bits from ``bit`` on to the planes below ``level`` and returns the carry out of them."""
        if n == 1:
            return mask[row, bit] ^ planes[bit, word]
        a, b = count(bit, n // 2, level - 1), count(bit + n // 2, n // 2, level - 1)
        sums[level - 1], carry = _full_add(sums[level - 1], a, b)
        return carry

    for bit in range(0, 64 * WIDE, 32):
        carry = count(bit, 32, 5)
        for level in (5, 6):
            sums[level], carry = sums[level] ^ carry, sums[level] & carry
        over = over | carry
        if bit >= 96:
            live = np.flatnonzero(over != ~U64(0))
            if len(live) < len(row):
                row, word, over, sums = row[live], word[live], over[live], [x[live] for x in sums]
            if not len(live):
                break
    return row, word, ~over


def pairs(prints: np.ndarray, low: np.ndarray, high: np.ndarray, queries: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) within RADIUS, for j in low[i] to high[i] of each query i (all rows in turn without ``queries``), some at a time."""
    planes = np.concatenate([simhash.planes_of(np.ascontiguousarray(prints[:, k])) for k in range(WIDE)])
    queries = np.arange(len(prints)) if queries is None else queries
    keep = high > low
    queries, low, high = queries[keep], low[keep], high[keep]
    words = (high - 1) // 64 - low // 64 + 1
    edge = ragged.bounds(words)
    start = 0
    while start < len(queries):
        stop = max(start + 1, int(np.searchsorted(edge, edge[start] + (1 << 14), side="right")) - 1)
        own = prints[queries[start:stop]]
        mask = U64(0) - ((own[:, :, None] >> np.arange(64, dtype=U64)) & U64(1)).reshape(len(own), -1)
        row = np.repeat(np.arange(stop - start), words[start:stop])
        word = np.arange(len(row)) - (edge[start + row] - edge[start]) + low[start + row] // 64
        before, after = np.clip(low[start + row] - word * 64, 0, 63), np.clip(high[start + row] - word * 64, 1, 64)
        outside = ((U64(1) << before.astype(U64)) - U64(1)) | np.where(after < 64, ~U64(0) << (after % 64).astype(U64), U64(0))
        row, word, near = _near(mask, planes, row, word, outside)
        for at in range(0, len(row), 1 << 12):  # a word has 64 lanes: bounded pairs at once
            lanes = np.unpackbits(near[at : at + (1 << 12)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            hit, lane = np.nonzero(lanes)
            if len(hit):
                yield queries[start + row[at + hit]], word[at + hit] * 64 + lane
        start = stop


def _candidates(prints: np.ndarray, size: np.ndarray, least: float, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs within RADIUS those whose sizes allow the similarity, and within the narrower radius if both sets are larger."""
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    ok = (small >= least * large - 1e-9) & (small > 0)
    i, j, small = i[ok], j[ok], small[ok]
    ok = (small < SMALL_SET) | (np.bitwise_count(prints[i] ^ prints[j]).sum(1, dtype=np.int64) <= LARGE_RADIUS)
    return i[ok], j[ok]


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (positions that are their own label) after linking positions i and j; a class has its smallest."""
    label = label.copy()
    while True:
        a, b = label[i], label[j]
        if np.array_equal(a, b):
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]


def resolve(n: int, links: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], label: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Labels of the classes that links connect among n rows (or only between two sides), without comparing all.

    links(picked, rest, label) gives the links between some rows and all that are left. A
    picked row is done then; the end is reached when all rows left have one label (or are on
    one side), as pairs of rows done were compared when the first of the two was picked.
    """
    label = np.arange(n) if label is None else label
    rest, step = np.arange(n), 1
    while len(rest) and (side is None or 0 < side[rest].sum() < len(rest)):
        values, counts = np.unique(label[rest], return_counts=True)
        if len(values) < 2:
            break
        picked = rest[label[rest] != values[counts.argmax()]][:step]
        step = min(64, 4 * step)
        i, j = links(picked, rest, label)
        label = merged(label, i, j)
        rest = rest[~np.isin(rest, picked)]
    return label


def _near_rest(prints: np.ndarray, size: np.ndarray, least: float, side: np.ndarray | None) -> Callable:
    def links(picked: np.ndarray, rest: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        own = np.concatenate([prints[rest], prints[picked]])
        at = np.arange(len(rest), len(own))
        for q, j in pairs(own, np.zeros(len(at), np.int64), np.full(len(at), len(rest)), at):
            i, j = picked[q - len(rest)], rest[j]
            ok = (label[i] != label[j]) & (i != j)
            if side is not None:
                ok &= side[i] != side[j]
            found.append(_candidates(prints, size, least, i[ok], j[ok]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    return links


def _central(prints: np.ndarray) -> np.ndarray:
    """Rows by their distance from the majority of all: the text that others were copied from comes early."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    return np.argsort((bits != (2 * bits.sum(0, dtype=np.int64) > len(bits))).sum(1), kind="stable")


#: Rows of a run up to which all its pairs are compared, many runs at once.
SMALL_RUN = 64


def run_candidates(prints: np.ndarray, size: np.ndarray, edges: np.ndarray, least: float, side: np.ndarray, split: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of candidates that connect each run's classes; ``split`` runs compare between their two sides only."""
    n = np.diff(edges)
    small = (n <= SMALL_RUN) & ~split
    high = np.repeat(np.where(small, edges[1:], 0), n)
    for i, j in pairs(prints, np.arange(len(prints)) + 1, high):
        yield _candidates(prints, size, least, i, j)
    for r in np.flatnonzero(~small & (n > 1)):
        rows = edges[r] + _central(prints[edges[r] : edges[r + 1]])
        own = side[rows] if split[r] else None
        label = resolve(len(rows), _near_rest(prints[rows], size[rows], least, own), side=own)
        yield rows[label], rows


def candidate_links(sets: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) of sids that connect all sets which share a prefix's shingle, have sizes that allow it, and lie within the radius."""
    entries = sets.select("sid", F.explode("prefix").alias("token"))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = entries.join(shared, "token").join(sets.select(F.col("sid").alias("s"), "n", "fp"), F.col("sid") == F.col("s")).drop("s")
    rows = rows.withColumn("tiles", F.ceil(F.col("k") / tile).cast("int")).withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("token", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "sid", "n", "fp")
    keys = ["token", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow.whole_runs(batches, keys, BLOCK_ROWS):
            low, high, own, sid, size = (block.column(c).to_numpy() for c in ("low", "high", "tile", "sid", "n"))
            first = arrow.changes(block, keys)
            nodes, code = np.unique(sid, return_inverse=True)
            label = np.arange(len(nodes))
            for i, j in run_candidates(_words(block.column("fp")), size, np.append(first, len(sid)), least, own == low, (low != high)[first]):
                label = merged(label, code[i], code[j])
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])

    arrow.bound_batches(sets.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


class _Sets:
    """Sets of hashes, for counts of common ones of many pairs at once."""

    def __init__(self, raw: list[bytes]):
        values = np.frombuffer(b"".join(raw), U64)
        self.edges = ragged.bounds(np.array([len(x) // 8 for x in raw], np.int64))
        codes = np.unique(values, return_inverse=True)[1]
        self.width = int(codes.max(initial=0)) + 1
        self.size = np.diff(self.edges)
        self.codes, self.keyed = codes, codes + np.repeat(np.arange(len(raw)), self.size) * self.width

    def alike(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Which pairs have a Jaccard similarity of ``least`` or more."""
        out = np.zeros(len(i), bool)
        swap = self.size[i] > self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        edge = ragged.bounds(self.size[i])
        start = 0
        while start < len(i):
            stop = max(start + 1, int(np.searchsorted(edge, edge[start] + (1 << 20), side="right")) - 1)
            a, b, n = i[start:stop], j[start:stop], self.size[i[start:stop]]
            key = ragged.gather(self.codes, self.edges[a], n) + np.repeat(b, n) * self.width
            at = np.minimum(np.searchsorted(self.keyed, key), len(self.keyed) - 1)
            common = ragged.sums(self.keyed[at] == key, ragged.bounds(n))
            out[start:stop] = common >= least * (n + self.size[b] - common) - 1e-9
            start = stop
        return out


def exact_classes(prints: np.ndarray, sets: _Sets, least: float, label: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Labels of the classes of one group by exact similarity; pairs beyond the radius aren't compared."""
    near = _near_rest(prints, sets.size, least, side)

    def links(picked: np.ndarray, rest: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = near(picked, rest, label)
        ok = sets.alike(i, j, least)
        return i[ok], j[ok]

    return resolve(len(prints), links, label, side)


def _compare_parts(rows: DataFrame, keys: list[str], least: float, part_bytes: int) -> DataFrame:
    """Links (a, b) of rows (keys, home, named, fp, shingles): exact, within runs of equal keys.

    Rows of one name are connected already, and names are what is linked. A run with rows
    that aren't at home compares these with the ones at home.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow.whole_runs(batches, keys, part_bytes, "shingles"):
            edges = np.append(arrow.changes(block, keys), block.num_rows)
            sets, prints = _Sets(block.column("shingles").to_pylist()), _words(block.column("fp"))
            home, named = block.column("home").to_numpy(zero_copy_only=False), block.column("named").to_numpy()
            n, out = np.diff(edges), []
            small = (n <= SMALL_RUN) & np.logical_and.reduceat(home, edges[:-1])
            for i, j in pairs(prints, np.arange(len(prints)) + 1, np.repeat(np.where(small, edges[1:], 0), n)):
                i, j = _candidates(prints, sets.size, least, i, j)
                ok = sets.alike(i, j, least)
                out += [(i[ok], j[ok])]
            for r in np.flatnonzero(~small & (n > 1)):
                rows = edges[r] + _central(prints[edges[r] : edges[r + 1]])
                own = _Sets([block.column("shingles")[int(x)].as_py() for x in rows])
                values, first, code = np.unique(named[rows], return_index=True, return_inverse=True)
                label = exact_classes(prints[rows], own, least, first[code], None if home[rows].all() else home[rows])
                out.append((rows[label], rows))
            a, b = np.concatenate([x for x, _ in out]) if out else np.zeros(0, int), np.concatenate([x for _, x in out]) if out else np.zeros(0, int)
            a, b = named[a], named[b]
            nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = merged(np.arange(len(nodes)), code[: len(a)], code[len(a) :])
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved].astype(np.int64)), pa.array(nodes[label[moved]].astype(np.int64))], ["a", "b"])

    arrow.bound_batches(rows.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def exact_links(sets: DataFrame, least: float, part_bytes: int = PART_BYTES) -> DataFrame:
    """Links (a, b) of sids of settled rows (root, sid, fp, shingles) that keep all classes of exact similarity within each root."""
    firsts = [F.min(F.struct(F.xxhash64("sid", F.lit(k)).alias("h"), "sid")).alias(f"p{k}") for k in range(PIVOTS)]
    groups = sets.groupBy("root").agg(F.ceil(F.sum(F.length("shingles")) / part_bytes).cast("int").alias("parts"), *firsts)
    groups = groups.withColumn("parts", F.greatest("parts", F.lit(1)))
    homes = sets.join(groups.select("root", "parts"), "root").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    large = storage.settle(groups.where("parts > 1"))
    columns = ["root", "part", "home", "named", "fp", "shingles"]
    alone = homes.where("parts = 1").select("root", "part", F.lit(True).alias("home"), F.col("sid").alias("named"), "fp", "shingles")
    links = _compare_parts(alone, ["root", "part"], least, part_bytes)
    if large.isEmpty():
        return links
    homes = storage.settle(homes.where("parts > 1"))
    pivots = large.select("root", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.sid") for k in range(PIVOTS)]))).alias("sid"))
    guests = homes.join(pivots, ["root", "sid"], "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part").drop("part").withColumnRenamed("other", "part")
    both = homes.select("root", "part", "sid", "fp", "shingles").unionByName(guests.select("root", "part", "sid", "fp", "shingles"))
    within = _compare_parts(both.select("root", "part", F.lit(True).alias("home"), F.col("sid").alias("named"), "fp", "shingles"), ["root", "part"], least, part_bytes)
    within = storage.settle(within)
    # what isn't connected to the largest class of its group visits the other parts
    roots = components.components(within)
    named = homes.join(roots.select(F.col("node").alias("s"), F.col("root").alias("class")), F.col("sid") == F.col("s"), "left").drop("s").withColumn("named", F.coalesce("class", "sid"))
    named = storage.settle(named)
    main = named.groupBy("root", "named").agg(F.count(F.lit(1)).alias("k")).groupBy("root").agg(F.max_by("named", F.struct("k", F.col("named"))).alias("main"))
    others = named.join(main, "root").where("named <> main")
    visits = storage.settle(others.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part").drop("part").withColumnRenamed("other", "part"))
    slots = visits.groupBy("root", "part").agg(F.ceil(F.sum(F.length("shingles")) / part_bytes).cast("int").alias("slots"))
    slots = slots.withColumn("slots", F.greatest("slots", F.lit(1)))
    coming = visits.join(slots, ["root", "part"]).withColumn("slot", F.pmod(F.xxhash64("sid"), F.col("slots")).cast("int")).withColumn("home", F.lit(False))
    at_home = named.join(slots, ["root", "part"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).withColumn("home", F.lit(True))
    across = at_home.select("slot", *columns).unionByName(coming.select("slot", *columns))
    return links.unionByName(within).unionByName(_compare_parts(across, ["root", "part", "slot"], least, part_bytes))


def classes(docs: DataFrame, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text", tile: int = TILE, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """The settled distinct sets of ``docs``, and (node, root) of every sid that a link leads away from."""
    sets = distinct_sets(docs, commonness(docs, text_column), least, id_column, text_column)
    groups = storage.settle(components.components(candidate_links(sets, least, tile)).withColumnRenamed("root", "group"))
    some = sets.join(groups, F.col("sid") == F.col("node")).select("sid", F.col("key").alias("k"), "least_id", "group")
    some = storage.settle(some)
    plain, at = storage.plain(docs)
    own = plain.join(some.select("least_id").distinct(), F.col(at(id_column)).cast("long").eqNullSafe(F.col("least_id")), "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, edges = shingle_sets(*ragged.text_bytes(batch.column(0)))
        raw = [hashes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array([set_key(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary()), _binary(fingerprints(hashes, edges)), pa.array(raw, pa.binary())], ["key", "fp", "shingles"])

    whole = arrow.map_texts(own, run, "key binary, fp binary, shingles binary", [F.col(at(text_column)).alias("text")], ragged.SMALL_SLICE_BYTES)
    whole = whole.join(some, F.col("key") == F.col("k")).groupBy(F.col("group").alias("root"), "sid").agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles"))
    return sets, components.components(exact_links(storage.settle(whole), least, part_bytes))


def keep_one_each(docs: DataFrame, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text", tile: int = TILE, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest id stays, with all its columns.

    Links join texts whose distinct five-word shingles have a Jaccard similarity of ``least``
    or more. Texts of fewer than five words have one shingle, all their words; texts without
    words, null and empty ones, are alike. Of rows that share the smallest id the one with
    the smallest set key stays, and of equal ones a single one. A null id counts as the
    largest. Columns may have any names. An empty table stays empty.
    """
    sets, roots = classes(docs, least, id_column, text_column, tile, part_bytes)
    named = sets.join(roots, F.col("sid") == F.col("node"), "left").withColumn("group", F.coalesce("root", "sid"))
    rank = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "key")
    chosen = named.groupBy("group").agg(F.min(rank).alias("x")).select("x.least_id", "x.key")
    plain, at = storage.plain(docs)
    mine = F.col(at(id_column)).cast("long")
    repeats = plain.groupBy(mine.alias("again")).agg(F.count(F.lit(1)).alias("k")).where("k > 1 or again is null")
    chosen = chosen.join(repeats, F.col("least_id").eqNullSafe(F.col("again")), "left")
    chosen = storage.settle(chosen.select("least_id", "key", F.col("k").isNotNull().alias("repeated")))
    once = plain.join(chosen.where("not repeated").select("least_id"), mine == F.col("least_id"), "left_semi")
    some = chosen.where("repeated")
    if not some.isEmpty():
        # ids of several rows: their rows are told apart by their sets, and equal ones are merged
        several = plain.join(some.select("least_id").distinct(), mine.eqNullSafe(F.col("least_id")), "left_semi")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", key binary"
        place, names = docs.columns.index(text_column), plain.columns

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, edges = shingle_sets(*ragged.text_bytes(batch.column(place)))
            keys = pa.array([set_key(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), keys], [*names, "key"])

        marked = arrow.map_texts(several, run, schema, [*plain.columns, F.col(at(text_column)).alias("text")], ragged.SMALL_SLICE_BYTES)
        wanted = some.select(F.col("least_id").alias("l"), F.col("key").alias("k"))
        marked = marked.join(wanted, mine.eqNullSafe(F.col("l")) & (F.col("key") == F.col("k")), "left_semi")
        merged_rows = marked.groupBy(mine.alias("l"), "key").agg(F.first(F.struct(*plain.columns)).alias("row"))
        once = once.unionByName(merged_rows.select("row.*"))
    return once.toDF(*docs.columns)
