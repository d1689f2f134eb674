"""Best-fit packing of tokenised documents into sequences under several capacities.

Each open sequence has residual capacities of tokens, of documents and of attention cost
(the sum of squared piece lengths, as attention is masked between documents). Pieces come
longest first. Among the sequences that can take a piece under every capacity, the one
chosen has the smallest weighted norm of what would be left (``rule="norm"``) or the
largest weighted dot-product of the piece and the residuals (``rule="dot"``); if none can,
a new one is opened.

Pieces are dealt by hash into groups of about ``GROUP_PIECES``, each packed on its own, so
the work is linear in the input, no task grows with it, and at most the last few sequences
of a group stay open. How often a document or row occurs doesn't matter: a group is dealt
by the row's number in the settled table, not by its id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, ragged, storage, wordbpe

#: Pieces in a group on average.
GROUP_PIECES = 8192

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Cut each document's ids and ``end_id`` into pieces of ``capacity``, of which only the last may be shorter.

    Null texts count as empty and give one piece, the end. Repeated rows each give their
    pieces. with_ids adds an ids column.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = wordbpe.coder(vocabulary).encode(*ragged.text_bytes(batch.column(1)))
        sizes = np.diff(at) + 1
        edges = ragged.bounds(sizes)
        flat = np.full(int(edges[-1]), end_id, "<u4")
        inside = np.ones(len(flat), bool)
        inside[edges[1:] - 1] = False
        flat[inside] = ids
        counts = -(-sizes // capacity)
        doc = np.repeat(np.arange(len(sizes)), counts)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = piece * capacity
        length = np.minimum(sizes[doc] - start, capacity)
        first = edges[doc] + start
        raw = flat.tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
        columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return arrow.map_texts(docs, cut, PIECES + (", ids array<int>" if with_ids else ""), [F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text")])


def best_fit(lengths: np.ndarray, capacity: int, max_documents: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset there of each piece; lengths come longest first."""
    n = len(lengths)
    full = np.array([capacity, max_documents, max_cost], float)
    scale = np.sqrt(np.array(weights)) / full
    left = np.zeros((min(n, 1024), 3))
    open_rows = np.zeros(len(left), np.int64)  # rows of left that can still take a piece
    used, n_open, sequences = np.zeros(len(left), np.int64), 0, 0
    names = np.zeros(len(left), np.int64)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    shortest = float(lengths[-1]) if n else 0.0
    for i, length in enumerate(lengths.tolist()):
        item = np.array([length, 1.0, float(length) * length])
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities of an empty sequence")
        best = -1
        if n_open:
            rest = left[:n_open]
            fits = np.flatnonzero((rest >= item).all(1))
            if len(fits):
                if rule == "norm":
                    best = fits[(((rest[fits] - item) * scale) ** 2).sum(1).argmin()]
                else:
                    best = fits[((rest[fits] * scale) @ (item * scale)).argmax()]
        if best < 0:
            if n_open == len(left):
                left = np.concatenate([left, np.zeros_like(left)])
                used, names = np.concatenate([used, np.zeros_like(used)]), np.concatenate([names, np.zeros_like(names)])
            best, n_open = n_open, n_open + 1
            left[best], used[best], names[best] = full, 0, sequences
            sequences += 1
        where[i], offset[i] = names[best], used[best]
        left[best] -= item
        used[best] += length
        if left[best, 0] < shortest or left[best, 1] < 1:  # no later piece fits: close it
            n_open -= 1
            left[best], used[best], names[best] = left[n_open], used[n_open], names[n_open]
    return where, offset


def pack(pieces: DataFrame, capacity: int, max_documents: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to a table with a length column of 1 to ``capacity``.

    An empty table stays empty. The bounds on documents and cost default to the largest
    that the token capacity allows. Equal rows are packed as separate pieces. Other columns
    are kept, whatever their names.
    """
    max_documents = max_documents or capacity
    max_cost = max_cost or capacity * capacity
    settled = storage.settle(pieces)
    groups = max(1, -(-settled.count() // group_pieces))
    plain, at = storage.plain(settled)
    length = at("length")
    numbered = plain.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", sequence_id long, offset long"

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([length, "row"], ascending=[False, True], kind="stable")
        where, offset = best_fit(group[length].to_numpy(), capacity, max_documents, max_cost, weights, rule)
        return group.drop(columns=["row", "part"]).assign(sequence_id=where + (int(key[0]) << 24), offset=offset)

    return numbered.groupBy("part").applyInPandas(run, schema).toDF(*settled.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, **options) -> DataFrame:
    """Tokenise, cut and pack documents: one row per piece (see ``token_pieces`` and ``pack``)."""
    return pack(token_pieces(docs, vocabulary, capacity, end_id, with_ids), capacity, **options)
