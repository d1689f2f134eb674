"""Quality rules by compressibility.

Repetitive text compresses far better than prose, and noise hardly at all. Every text's
zstandard ratio (compressed bytes over its own) is held against a band for its length, as
short texts compress worse, and so is the ratio of each fixed-size chunk and of the last rest, so that a
repetitive or incompressible stretch in a long text shows. Base counts of words, symbols,
repeated lines and repeated word windows come from the same pass.

These bands are wide and hold for any corpus. Within them a second band follows the corpus:
quartiles of the ratio by length, over all documents that pass the base rules, bound how far
a text may lie from the others of its length. Only ratios and lengths are shuffled for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrow, ragged, storage

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio by length.

    whole: (least bytes, lowest ratio, highest ratio), by rising bytes; the last one that a
    text reaches holds. Chunks of ``chunk_bytes`` and the last rest are held against ``chunk``
    by their own length in the same way, and a text fails if more than ``bad_share`` of its
    bytes are in chunks outside. From 512 bytes on the highest ratios lie below those of
    base64-like noise (0.79 at 1024 bytes, 0.76 at 4096); shorter rests don't tell it from text.
    """

    whole: tuple[tuple[int, float, float], ...] = ((64, 0.30, 1.45), (256, 0.25, 0.95), (1024, 0.22, 0.80), (4096, 0.20, 0.72), (16384, 0.18, 0.68))
    chunk_bytes: int = 4096
    chunk: tuple[tuple[int, float, float], ...] = ((64, 0.30, 1.45), (256, 0.25, 0.95), (512, 0.25, 0.79), (1024, 0.22, 0.74), (2048, 0.20, 0.70), (4096, 0.20, 0.68))
    bad_share: float = 0.3
    level: int = 3
    #: The corpus's band: from least_bytes on, limits for each half of a doubling of the length, interpolated between:
    #: below and above the median so many times the distance of the quartiles, which counts as least_spread of the
    #: median at least. The whole band's limits weigh as prior_texts texts in each, so what few texts say counts in part.
    least_bytes: int = 256
    prior_texts: int = 2
    below: float = 3.0
    above: float = 6.0
    least_spread: float = 0.02


def _windows(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, the words in windows that occur twice or more in it."""
    covered = np.zeros(len(starts) + 1, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(starts) - WINDOW + 1
    if n > 0:
        _, code = ragged.unique_spans(buf, starts, ends)
        at = np.flatnonzero(doc[: n] == doc[WINDOW - 1 :])
        # windows are matched within a text by exact word codes, folded pair by pair
        fold = code[at].astype(np.int64)
        for k in range(1, WINDOW):
            fold = np.unique(fold * (int(code.max()) + 1) + code[at + k], return_inverse=True)[1].astype(np.int64)
        fold = np.unique(fold * len(first) + doc[at], return_inverse=True)[1]
        twice = at[(np.bincount(fold, minlength=1) >= 2)[fold]] if len(at) else at
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    return ragged.sums((np.cumsum(covered)[:-1] > 0).astype(np.int64), first)


def _repeated_lines(text: bytes) -> int:
    seen, out = set(), 0
    for line in text.split(b"\n"):
        if not _blank(line):
            if line in seen:
                out += 1
            seen.add(line)
    return out


def _blank(line: bytes) -> bool:
    return not line.strip(b" \t\n\x0b\x0c\r")


def _limits(bands: tuple[tuple[int, float, float], ...], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest ratio of each length; any below the first band."""
    band = np.searchsorted([b[0] for b in bands], sizes, side="right")
    return np.array([-1.0, *[b[1] for b in bands]])[band], np.array([np.inf, *[b[2] for b in bands]])[band]


def measure(batch: pa.RecordBatch, bands: Bands) -> pa.RecordBatch:
    buf, offsets = ragged.text_bytes(batch.column(1))
    raw = buf.tobytes()
    starts, ends, first = ragged.words(buf, offsets)
    n_words = np.diff(first)
    points = ragged.bounds(((buf & 0xC0) != 0x80).astype(np.int64))
    chars = ragged.sums(points[ends] - points[starts], first)
    symbols = ragged.sums(SYMBOLS[buf].astype(np.int64), offsets)
    repeated = _windows(buf, starts, ends, first)
    compress = zstandard.ZstdCompressor(level=bands.level).compress
    sizes = np.diff(offsets)
    low, high = _limits(bands.whole, sizes)
    ratio, bad_share, lines = np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
    step = bands.chunk_bytes
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        text = raw[a:b]
        lines[i] = _repeated_lines(text)
        if text:
            ratio[i] = len(compress(text)) / len(text)
            chunks = [text[j : j + step] for j in range(0, len(text), step)]
            length = np.array([len(c) for c in chunks])
            # a text of one chunk is compressed already
            own = np.array([len(compress(c)) for c in chunks]) / length if len(chunks) > 1 else ratio[i : i + 1]
            least, most = _limits(bands.chunk, length)
            bad_share[i] = length[(own < least) | (own > most)].sum() / len(text)
    base = (n_words < 10) | (100 * repeated > 20 * n_words)
    verdict = (ratio >= low) & (ratio <= high) & (bad_share <= bands.bad_share)
    columns = [batch.column(0), n_words, chars, symbols, lines, repeated, base, ~base & verdict, ratio, bad_share, sizes]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double, n_bytes long"


#: Cells of the ratio in which the corpus's texts are counted, to a ratio of 1; and halves of doublings of the length, beyond any text.
CELLS, STEPS = 10_000, 82


def corpus_quartiles(measured: DataFrame, bands: Bands) -> dict[int, tuple[int, list[float]]]:
    """By half of a doubling of the length, the different texts and the quartiles of their ratio, over all rows that pass the base rules.

    Texts of one length and ratio count once, so copies weigh nothing. Ratios are counted in
    cells of 1 / ``CELLS``, so the quartiles are those of all rows, however they are dealt.
    Some 60 rows at most.
    """
    rows = measured.where(~F.col("base_failed") & (F.col("n_bytes") >= bands.least_bytes)).select("n_bytes", "ratio").distinct()
    cells = rows.groupBy(F.floor(2 * F.log2("n_bytes")).cast("int").alias("step"), F.floor(F.col("ratio") * CELLS).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("step").orderBy("cell")  # of the cells of a step
    summed = cells.withColumns({"rank": F.sum("n").over(upto), "k": F.sum("n").over(Window.partitionBy("step"))})
    quartile = lambda q: F.min(F.when(F.col("rank") >= F.ceil(q * F.col("k")), F.col("cell")))
    found = summed.groupBy("step").agg(F.first("k").alias("k"), *[quartile(q).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))])
    return {r["step"]: (r["k"], [(r[f"q{i}"] + 0.5) / CELLS for i in range(3)]) for r in found.collect()}


def corpus_limits(quartiles: dict[int, tuple[int, list[float]]], bands: Bands) -> list[tuple[float, float]]:
    """The lowest and highest ratio in the middle of each half of a doubling, from that of ``least_bytes`` on."""
    out = []
    for step in range(_first_step(bands), STEPS + 1):
        (low,), (high,) = _limits(bands.whole, np.array([2 ** ((step + 0.5) / 2)]))
        k, (lower, middle, upper) = quartiles.get(step, (0, (0.0, 0.0, 0.0)))
        spread, weight = max(upper - lower, middle * bands.least_spread), k / (k + bands.prior_texts)
        out.append((low + weight * (middle - bands.below * spread - low), high + weight * (middle + bands.above * spread - high)))
    return out


def _first_step(bands: Bands) -> int:
    return int(2 * np.log2(bands.least_bytes))


def _between(values: list[float], x: Column) -> Column:
    """The line through values at 0, 1, 2, ..., level below 0."""
    knots, x = F.array(*[F.lit(float(v)) for v in values]), F.greatest(x, F.lit(0.0))
    i = F.floor(x).cast("int")
    return knots[i] + (knots[i + 1] - knots[i]) * (x - i)


def compression_rules(docs: DataFrame, bands: Bands = Bands(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, ratios, corpus limits and verdict of each row's whole text.

    Null and empty texts have no words and so fail the base rules; their ratio is 0.
    corpus_low and corpus_high are the corpus's band, null for texts below ``least_bytes``;
    without any other text they are the whole band's limits. band_failed says that some band
    rejects the text. Verdicts don't depend on how rows are dealt to partitions.
    Repeated rows each give a row. Other columns are not read.
    """
    columns = [F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text")]
    measured = storage.settle(arrow.map_texts(docs, lambda batch: measure(batch, bands), SCHEMA, columns))
    limits = corpus_limits(corpus_quartiles(measured, bands), bands)
    x, own = 2 * F.log2("n_bytes") - 0.5 - _first_step(bands), F.col("n_bytes") >= bands.least_bytes
    low, high = (F.when(own, _between([v[i] for v in limits], x)) for i in (0, 1))
    inside = F.coalesce(F.col("ratio").between(low, high), F.lit(True))
    out = measured.withColumns({"corpus_low": low, "corpus_high": high, "kept": F.col("kept") & inside})
    return out.withColumn("band_failed", ~F.col("base_failed") & ~F.col("kept"))
