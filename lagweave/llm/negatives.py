"""Hard-negative mining by bit-sliced integer products.

A vector's components become integers, stored vertically: one bit plane after another in two's
complement, 64 components to a word. The product of two vectors is a sum of weighted
popcounts over their planes. The candidates' planes are processed from the most significant
one down; what the planes below can still add lies between the sums of the anchor's negative
and of its positive components, so every plane tightens the interval of each score by half,
and candidates go as soon as their interval can't qualify.

Rows are packed into blocks in one scan, and anchors (a stated set of rows) into groups of
bounded size. Each group of anchors meets each block once, by a join on (group, salt), and a
task carries the best scores so far from block to block. It only gives out a few rows for an
anchor, which are ranked in the end. Labels are never a key, so a frequent label only makes
more candidates inside blocks.

Positives come first, as the best rows of the same label; their scores are the bounds between
which the negatives of the second pass must lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrow, ragged, storage

#: Rows in a block, anchors in a group on average, and salts that a group's work is spread over.
BLOCK_ROWS, GROUP_ANCHORS, SALTS = 2000, 1024, 64
#: Anchors and candidates whose planes are compared at once.
TILE = 32
#: Bits of an integer component at most, so that products of 2^15 components stay exact.
MOST_BITS = 24
#: What components are multiplied by before they are rounded down.
FACTOR = 256

BLOCK = "block long, n int, planes int, words int, ids binary, labels binary, bits binary"
_U64 = np.uint64


def integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 x) of every component, shorter vectors filled with 0, and which vectors take part: no null, no null or non-finite component."""
    sizes = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    part = ~np.asarray(vectors.is_null())
    flat = vectors.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    owner = np.repeat(np.arange(len(sizes)), sizes)
    part &= np.bincount(owner[~np.isfinite(values)], minlength=len(sizes)) == 0
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[owner, np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]] = np.where(part[owner], values, 0)
    out = np.floor(FACTOR * out)
    if np.abs(out).max(initial=0) >= 1 << (MOST_BITS - 1):
        raise ValueError(f"an integer component needs more than {MOST_BITS} bits")
    return out.astype(np.int64), part


def slice_bits(values: np.ndarray, planes: int) -> np.ndarray:
    """(planes, rows, words): bit k of each component in two's complement, 64 components to a word."""
    rows, wide = values.shape
    words = max(1, -(-wide // 64))
    out = np.zeros((planes, rows, words), _U64)
    for k in range(planes):
        bits = np.zeros((rows, words * 64), np.uint8)
        bits[:, :wide] = (values >> k) & 1
        out[k] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return out


def planes_of(values: np.ndarray) -> int:
    """Planes that two's complement needs, the sign included."""
    return int(max(values.max(initial=0), -1 - values.min(initial=0))).bit_length() + 1


def widened(bits: np.ndarray, planes: int, words: int) -> np.ndarray:
    """The same integers in more planes (copies of the sign) and words (components of 0)."""
    more = np.repeat(bits[-1:], planes - len(bits), axis=0)
    return np.pad(np.concatenate([bits, more]), ((0, 0), (0, 0), (0, words - bits.shape[2])))


def _weights(planes: int) -> np.ndarray:
    out = 1 << np.arange(planes, dtype=np.int64)
    out[-1] *= -1
    return out


def _products(plane: np.ndarray, anchors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The products of a candidate plane (..., words) with anchors (planes, ..., words): popcounts, weighted by the anchors' planes."""
    out = None
    for j, w in enumerate(weights):
        for word in range(plane.shape[-1]):
            x = np.bitwise_count(plane[..., word] & anchors[j][..., word]).astype(np.int64) * w
            out = x if out is None else out + x
    return out


def reach(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of each anchor's negative and of its positive components: the least and the most that a plane of ones and zeros gives."""
    sign = anchors[-1]
    low, high = np.zeros(anchors.shape[1], np.int64), np.zeros(anchors.shape[1], np.int64)
    for j, w in enumerate(_weights(len(anchors))):
        low += np.bitwise_count(anchors[j] & sign).sum(1).astype(np.int64) * w
        high += np.bitwise_count(anchors[j] & ~sign).sum(1).astype(np.int64) * w
    return low, high


def survivors(candidates: np.ndarray, anchors: np.ndarray, least: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, best: int, allowed: np.ndarray | None, bounds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, candidate, exact score) of all pairs whose score may lie within their anchor's bounds.

    candidates: (planes, m, words), anchors: (planes, a, words). allowed: which pairs count.
    bounds: per anchor the least and the most score. With ``best`` > 0 a pair must also reach
    the best-th largest lower end of its anchor's intervals, as only that many are asked for.
    """
    weights, more = _weights(len(candidates)), _weights(anchors.shape[0])
    low_plane, high_plane = reach(anchors)
    bottom, top = bounds
    m = candidates.shape[1]
    # dense: all pairs while most of them are alive
    total = np.zeros((anchors.shape[1], m), np.int64)
    alive = np.ones(total.shape, bool) if allowed is None else allowed.copy()
    k = len(candidates) - 1
    while k >= 0:
        total += _products(candidates[k][None], anchors[:, :, None], more) * weights[k]
        rest = (1 << k) - 1
        low, high = total + (rest * low_plane)[:, None], total + (rest * high_plane)[:, None]
        floor = bottom
        if best and m >= best:
            certain = np.where(alive, low, np.iinfo(np.int64).min)
            floor = np.maximum(floor, np.partition(certain, m - best, axis=1)[:, m - best])
        alive &= (high >= floor[:, None]) & (low <= top[:, None])
        k -= 1
        if alive.sum() * 4 < alive.size:
            break
    a, c = np.nonzero(alive)
    total = total[a, c]
    # sparse: the pairs that are left
    while k >= 0 and len(a):
        total = total + _products(candidates[k][c], anchors[:, a], more) * weights[k]
        rest = (1 << k) - 1
        keep = (total + rest * high_plane[a] >= bottom[a]) & (total + rest * low_plane[a] <= top[a])
        a, c, total = a[keep], c[keep], total[keep]
        k -= 1
    return a, c, total


class Best:
    """The ``most`` best (score, id) of every slot so far: higher scores first, then smaller ids."""

    def __init__(self, slots: int, most: int):
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.most, self.least = most, np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = place < self.most
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = place[keep] == self.most - 1
        self.least[self.slot[full]] = self.score[full]  # what a further row must reach


def pack(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Blocks (``BLOCK``) of the rows that take part, sorted by label inside. One scan without a shuffle; settled by the caller."""
    arrow.bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                ids, labels, vectors = (batch.column(i).slice(low, BLOCK_ROWS) for i in range(3))
                values, part = integers(vectors)
                chosen = np.flatnonzero(part)
                labels = np.asarray(labels)
                chosen = chosen[np.argsort(labels[chosen], kind="stable")]
                if len(chosen):
                    planes = planes_of(values[chosen])
                    bits = slice_bits(values[chosen], planes)
                    yield _block_row(number, bits, np.asarray(ids)[chosen], labels[chosen])
                    number += 1

    known = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return known.where("id is not null and label is not null and vector is not null").mapInArrow(run, BLOCK)


def _block_row(number: int, bits: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    values = [number, bits.shape[1], bits.shape[0], bits.shape[2], ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), bits.tobytes()]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["block", "n", "planes", "words", "ids", "labels", "bits"])


def _read(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's bits, ids and labels."""
    shape = row[prefix + "planes"], row[prefix + "n"], row[prefix + "words"]
    return np.frombuffer(row[prefix + "bits"], "<u8").reshape(shape), np.frombuffer(row[prefix + "ids"], "<i8"), np.frombuffer(row[prefix + "labels"], "<i8")


ANCHOR = "block long, at long, id long, label long, planes int, words int, bits binary"


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """(block, at, id, label, planes, words, bits) of the rows whose id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bits, ids, labels = _read(row)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    columns = [np.full(len(at), row["block"]), at.astype(np.int64), ids[at], labels[at], np.full(len(at), len(bits), np.int32), np.full(len(at), bits.shape[2], np.int32)]
                    words = pa.array([np.ascontiguousarray(bits[:, i]).tobytes() for i in at], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), words], ["block", "at", "id", "label", "planes", "words", "bits"])

    return blocks.mapInArrow(run, ANCHOR)


GROUP = "grp long, a_n int, a_planes int, a_words int, a_ids binary, a_labels binary, a_bits binary, a_block binary, a_at binary, a_positives binary, a_scores binary"


def grouped(anchors: DataFrame, groups: int) -> DataFrame:
    """Anchors packed by group (``GROUP``), sorted by label. Hashes of places deal them out, about ``GROUP_ANCHORS`` to each."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["label"], r["block"], r["at"]))
        planes, words = max(r["planes"] for r in rows), max(r["words"] for r in rows)
        bits = np.concatenate([widened(np.frombuffer(r["bits"], "<u8").reshape(r["planes"], 1, r["words"]), planes, words) for r in rows], axis=1)
        most = max(len(r["positives"]) for r in rows)
        some = lambda name: np.array([r[name] + [0] * (most - len(r[name])) for r in rows], "<i8").reshape(len(rows), most)
        # where there are fewer positives, a score below 0 has no negatives
        scores = np.array([r["scores"] + [-1] * (most - len(r["scores"])) for r in rows], "<i8").reshape(len(rows), most)
        values = [rows[0]["grp"], len(rows), planes, words, *(np.array([r[c] for r in rows], "<i8").tobytes() for c in ("id", "label")), bits.tobytes(), *(np.array([r[c] for r in rows], "<i8").tobytes() for c in ("block", "at")), some("positives").tobytes(), scores.tobytes()]
        schema = pa.schema([("grp", pa.int64()), ("a_n", pa.int32()), ("a_planes", pa.int32()), ("a_words", pa.int32()), *((f"a_{c}", pa.binary()) for c in ("ids", "labels", "bits", "block", "at", "positives", "scores"))])
        return pa.Table.from_pylist([dict(zip(schema.names, values))], schema)

    return anchors.withColumn("grp", F.pmod(F.xxhash64("block", "at"), F.lit(groups))).groupBy("grp").applyInArrow(run, GROUP)


def meet(blocks: DataFrame, groups: DataFrame, count: int, compare: Callable[[dict, dict], None], schema: str, give: Callable[[dict], pa.RecordBatch | None]) -> DataFrame:
    """Every group of anchors with every block once. ``compare`` changes the state of the group at hand; ``give`` turns it into rows when the next group comes."""
    arrow.bound_batches(blocks.sparkSession)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    pairs = spread.join(salted, ["grp", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if state.get("grp") != row["grp"]:
                    if state and (out := give(state)) is not None:
                        yield out
                    bits, ids, labels = _read(row, "a_")
                    state = {"grp": row["grp"], "bits": bits, "ids": ids, "labels": labels} | {c: np.frombuffer(row[f"a_{c}"], "<i8") for c in ("block", "at", "positives", "scores")}
                compare(state, row)
        if state and (out := give(state)) is not None:
            yield out

    return pairs.mapInArrow(run, schema)


def _compare_positives(most: int) -> Callable[[dict, dict], None]:
    def compare(s: dict, row: dict) -> None:
        bits, ids, labels = _read(row)
        best = s.setdefault("best", Best(len(s["ids"]), most))
        far = np.full(TILE, np.iinfo(np.int64).max)
        words = min(bits.shape[2], s["bits"].shape[2])
        for label in np.intersect1d(labels, s["labels"]):
            c0, c1 = np.searchsorted(labels, [label, label + 1])
            a0, a1 = np.searchsorted(s["labels"], [label, label + 1])
            for low in range(a0, a1, TILE):
                tile = np.arange(low, min(low + TILE, a1))
                # an anchor is no positive of itself
                allowed = (s["block"][tile, None] != row["block"]) | (s["at"][tile, None] != np.arange(c0, c1))
                a, c, score = survivors(bits[:, c0:c1, :words], s["bits"][:, tile, :words], None, most, allowed, (best.least[tile], far[: len(tile)]))
                best.add(tile[a], score, ids[c0 + c])

    return compare


def _give_positives(s: dict) -> pa.RecordBatch | None:
    best = s.get("best")
    if best is None or not len(best.slot):
        return None
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (s["block"][best.slot], s["at"][best.slot], best.id, best.score)], ["block", "at", "positive", "score"])


def _compare_negatives(most: int, share: tuple[int, int]) -> Callable[[dict, dict], None]:
    low_share, high_share = share

    def compare(s: dict, row: dict) -> None:
        bits, ids, labels = _read(row)
        n = len(s["ids"])
        each = len(s["scores"]) // n
        scores = s["scores"].reshape(n, each)
        best = s.setdefault("best", Best(n * each, most))
        words = min(bits.shape[2], s["bits"].shape[2])
        bottom, top = -(-low_share * scores // 100), high_share * scores // 100
        for low in range(0, n, TILE):
            tile = np.arange(low, min(low + TILE, n))
            open_ = (bottom[tile] <= top[tile]) & (scores[tile] >= 0)
            need = np.maximum(bottom[tile], best.least.reshape(n, each)[tile])
            floor = np.where(open_, need, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
            ceiling = np.where(open_, top[tile], np.iinfo(np.int64).min).max(1, initial=np.iinfo(np.int64).min)
            live = tile[open_.any(1)]
            if not len(live):
                continue
            allowed = s["labels"][live, None] != labels
            a, c, score = survivors(bits[:, :, :words], s["bits"][:, live, :words], None, 0, allowed, (floor[live - low], ceiling[live - low]))
            for w in range(each):
                ok = (score >= bottom[live[a], w]) & (score <= top[live[a], w]) & (scores[live[a], w] >= 0)
                best.add(live[a[ok]] * each + w, score[ok], ids[c[ok]])

    return compare


def _give_negatives(s: dict) -> pa.RecordBatch | None:
    best = s.get("best")
    if best is None or not len(best.slot):
        return None
    each = len(s["scores"]) // len(s["ids"])
    anchor = best.slot // each
    columns = [s["block"][anchor], s["at"][anchor], s["ids"][anchor], best.slot % each, s["positives"][best.slot], s["scores"][best.slot], best.id, best.score]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "at", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), relabel: int = 7) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the best rows of another label within a share of each positive's score.

    Anchors are the rows (vec_id, embedding, label) whose id is divisible by ``every``; ids
    divisible by ``relabel`` first get the next label of ten. An anchor's positives are its
    first ``positives`` other rows of the same label, and for each the first ``negatives`` rows
    of another label whose score is between the two percentages of the positive's are returned;
    higher scores come first, then smaller ids. A positive with a score below 0 has none.

    Rows with a null id, label, vector or component, or a component that isn't finite, take no
    part. Shorter vectors are filled with zeros; empty ones have products of 0. Repeated rows
    are rows of their own: each repeated anchor gives its own results, and a row is only no
    positive of itself. Components beyond 24 bits are an error, as products could overflow. An
    empty table gives no row; columns of other names are ignored.
    """
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    spark = rows.sparkSession
    blocks = storage.settle(pack(rows.select("vec_id", "embedding", label.alias("label"))))
    anchors = storage.settle(anchors_of(blocks, every))
    groups = max(1, -(-anchors.count() // GROUP_ANCHORS))
    none = {"positives": F.array().cast("array<long>"), "scores": F.array().cast("array<long>")}
    found = meet(blocks, grouped(anchors.withColumns(none), groups), groups, _compare_positives(positives), "block long, at long, positive long, score long", _give_positives)
    order = Window.partitionBy("block", "at").orderBy(F.col("score").desc(), "positive")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    best = best.groupBy("block", "at").agg(F.array_sort(F.collect_list(F.struct("place", "positive", "score"))).alias("p"))  # at most ``positives`` entries
    chosen = storage.settle(anchors.join(best, ["block", "at"]).withColumns({"positives": F.col("p.positive"), "scores": F.col("p.score")}).drop("p"))
    mined = meet(blocks, grouped(chosen, groups), groups, _compare_negatives(negatives, share), "block long, at long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long", _give_negatives)
    order = Window.partitionBy("block", "at", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Every anchor with every row; integers of this size are exact as doubles.
ORACLE_SQL = """
WITH r AS (SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.place AS anchor, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.place <> b.place WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
