"""Toxicity by averaged embeddings of subwords and a linear softmax.

A word is a run of letters, digits and characters beyond ASCII, lower-cased. Its vector is the
mean of the vectors of itself and of its character n-grams (with marks at both ends), each
found by a hash in a table of ``BUCKETS``; a text's vector is the mean over its words, and a
linear layer with a softmax gives the probabilities of the two labels. Table and layer are
trained jointly by mini-batches in NumPy, so a misspelling that was never seen shares the
vectors of the n-grams that it keeps.

The model is fitted on the driver from whole texts of a bounded number of labelled documents
(``sample`` of each label, in hash order), of which only the bags of subwords come from the
executors. As everything before the softmax is linear, a trained table is folded into one
number a bucket, and scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, ragged

#: Rows of the embedding table, and the lengths of n-grams in code points, end marks counted.
BUCKETS, SHORTEST, LONGEST = 1 << 18, 3, 6
#: Labelled documents to fit on, of each label at most.
SAMPLE = 2000
#: Share of the sampled documents that a row of the table must be in.
LEAST = 0.01
#: Code points of words whose n-grams are hashed at once.
AT_ONCE = 1 << 18

_U64 = np.uint64
_MARK = np.zeros(256, bool)  # bytes of words
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = _MARK[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """A to Z, and the accented capitals of Latin-1, in lower case; lengths stay."""
    out = _LOWER[buf]
    if len(out) > 1:
        accent = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[accent] += 32
    return out


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = _MARK[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def _letters(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point of words given as spans, with marks around each word, and each word's first (n + 1)."""
    at = ragged.gather(np.arange(len(buf)), starts, ends - starts)
    word = np.repeat(np.arange(len(starts)), ends - starts)
    head = (buf[at] & 0xC0) != 0x80
    at, word = at[head], word[head]
    size = np.ones(256, np.uint64)
    size[0xC0:], size[0xE0:], size[0xF0:] = 2, 3, 4
    value = ragged.lanes(buf)[at] & ((_U64(1) << (size[buf[at]] * _U64(8))) - _U64(1))
    count = np.bincount(word, minlength=len(starts))
    edges = ragged.bounds(count + 2)
    out = np.full(int(edges[-1]), ord("<"), np.uint64)
    out[edges[1:] - 1] = ord(">")
    out[np.arange(len(at)) + 2 * word + 1] = value
    return out, edges


def subwords(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of the subwords of words given as spans, in parts of bounded size: each word itself, then its n-grams."""
    whole = ragged.span_hashes(buf, starts, ends)
    yield np.arange(len(starts)), (ragged.mix(whole) % _U64(BUCKETS)).astype(np.int64)
    for low, high in _parts(ends - starts):
        letters, edges = _letters(buf, starts[low:high], ends[low:high])
        word = np.repeat(np.arange(low, high), np.diff(edges))
        left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(letters))
        for begin in range(0, len(letters), AT_ONCE):
            stop = min(begin + AT_ONCE, len(letters))
            code = np.zeros(stop - begin, np.uint64)
            for n in range(1, LONGEST + 1):
                reach = letters[begin + n - 1 : stop + n - 1]
                code[: len(reach)] = ragged.mix(code[: len(reach)] + reach + _U64(n))
                if n >= SHORTEST:
                    ok = np.flatnonzero(left[begin:stop] >= n)
                    yield word[begin:stop][ok], (code[ok] % _U64(BUCKETS)).astype(np.int64)


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of words of ``AT_ONCE`` bytes together, or one longer word."""
    total, low = ragged.bounds(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(total, total[low] + AT_ONCE, "right")) - 1)
        yield low, high
        low = high


def document_words(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each text's different words, lower-cased, and how often it has each."""
    buf, offsets = ragged.text_bytes(texts)
    buf = lowered(buf)
    starts, ends, first = word_spans(buf, offsets)
    index, inverse = ragged.unique_spans(buf, starts, ends) if len(starts) else (starts, starts)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pair, count = np.unique(text * max(len(index), 1) + inverse, return_counts=True)
    chosen, edges = index[pair % max(len(index), 1)], np.searchsorted(pair, np.arange(len(offsets)) * max(len(index), 1)).astype(np.int32)
    sizes = ends[chosen] - starts[chosen]
    data = ragged.gather(buf, starts[chosen], sizes)
    words = pa.Array.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer(ragged.bounds(sizes).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.ListArray.from_arrays(edges, words), pa.ListArray.from_arrays(edges, pa.array(count.astype(np.int32)))


@dataclass
class Bags:
    """Documents as (word, weight) entries, words as buckets, and labels; weights of a document with words sum to 1."""

    edges: np.ndarray  # of each document's entries
    word: np.ndarray
    weight: np.ndarray
    parts: np.ndarray  # edges of each word's buckets
    bucket: np.ndarray
    labels: np.ndarray


def bags(words: pa.Array, counts: pa.Array, labels: np.ndarray) -> Bags:
    """The lists of ``document_words`` over one table of different words."""
    edges = ragged.bounds(np.asarray(words.value_lengths().fill_null(0)))
    buf, offsets = _bytes(words.flatten())
    starts, ends = offsets[:-1], offsets[1:]
    index, word = ragged.unique_spans(buf, starts, ends) if len(starts) else (starts, starts)
    count = np.asarray(counts.flatten()).astype(np.float64)
    weight = count / np.repeat(np.maximum(np.add.reduceat(np.append(count, 0), edges[:-1]), 1), np.diff(edges)) if len(count) else count
    pairs = list(subwords(buf, starts[index], ends[index])) if len(index) else []
    of, bucket = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(of, kind="stable")
    return Bags(edges, word, weight, ragged.bounds(np.bincount(of, minlength=len(index))), bucket[order], labels.astype(np.int64))


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def document_frequency(b: Bags) -> np.ndarray:
    """In how many documents each bucket is."""
    out = np.zeros(BUCKETS, np.int64)
    for edge in range(len(b.edges) - 1):
        word = b.word[b.edges[edge] : b.edges[edge + 1]]
        own = ragged.gather(b.bucket, b.parts[word], b.parts[word + 1] - b.parts[word])
        out[np.unique(own)] += 1
    return out


@dataclass
class SubwordModel:
    """The embedding table (buckets x width), and the layer (width x 2) with its bias."""

    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """The difference of the two labels' logits that a bucket adds, and that of an empty text."""
        return self.table @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


def scores(texts: pa.Array, folded: tuple[np.ndarray, float]) -> np.ndarray:
    """The probability of label 1 of each whole text."""
    gain, rest = folded
    buf, offsets = ragged.text_bytes(texts)
    buf = lowered(buf)
    starts, ends, first = word_spans(buf, offsets)
    n = np.diff(first)
    if not len(starts):
        return np.full(len(n), 1 / (1 + np.exp(-rest)))
    index, inverse = ragged.unique_spans(buf, starts, ends)
    total, count = np.zeros(len(index)), np.zeros(len(index))
    for word, bucket in subwords(buf, starts[index], ends[index]):
        total += np.bincount(word, gain[bucket], len(index))
        count += np.bincount(word, minlength=len(index))
    text = np.repeat(np.arange(len(n)), n)
    logit = np.bincount(text, (total / count)[inverse], len(n)) / np.maximum(n, 1) + rest
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def loss_and_gradients(parts: dict[str, np.ndarray], b: Bags, chosen: np.ndarray, scale: np.ndarray, importance: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted mean cross-entropy of chosen documents and its gradients by table, layer and bias.

    Buckets of ``b`` are rows of the table, whose vectors count ``scale`` times each; -1 is none.
    The means of vectors and the layer are linear, so both passes go over two numbers a row and
    not over its whole width.
    """
    sizes = np.diff(b.edges)[chosen]
    at = ragged.gather(np.arange(len(b.word)), b.edges[chosen], sizes)
    text = np.repeat(np.arange(len(chosen)), sizes)
    known, word = np.unique(b.word[at], return_inverse=True)
    width = b.parts[known + 1] - b.parts[known]
    row, of = ragged.gather(b.bucket, b.parts[known], width), np.repeat(np.arange(len(known)), width)
    row, of = row[row >= 0], of[row >= 0]
    share = 1 / np.maximum(width, 1)
    each = (parts["table"] @ parts["layer"]) * scale[:, None]
    labels, weight = b.labels[chosen], b.weight[at]
    logits = np.stack([np.bincount(text, weight * (np.bincount(of, each[row, k], len(known)) * share)[word], len(chosen)) for k in (0, 1)], 1) + parts["bias"]
    logits -= logits.max(1, keepdims=True)
    out = np.exp(logits)
    out /= out.sum(1, keepdims=True)
    own, importance = (np.arange(len(labels)), labels), importance / importance.sum()
    loss = -float(importance @ np.log(np.maximum(out[own], 1e-300)))
    out[own] -= 1
    out *= importance[:, None]
    pulled = np.stack([np.bincount(row, (np.bincount(word, weight * out[text, k], len(known)) * share)[of], len(each)) for k in (0, 1)], 1) * scale[:, None]
    return loss, {"table": pulled @ parts["layer"].T, "layer": parts["table"].T @ pulled, "bias": out.sum(0)}


def fit(b: Bags, totals: tuple[int, int], width: int = 10, steps: int = 250, batch: int = 128, rate: float = 0.05, decay: float = 1e-5, least: float = LEAST, power: float = 1.5, seed: int = 11) -> SubwordModel:
    """Train table and layer jointly by Adam on ``steps`` mini-batches of documents, in random order, round after round.

    totals: how many documents of each label there are; where the sample has another share of
    a label, its documents weigh accordingly. Averages weigh a row by its rarity, the logarithm
    of the documents for one that has it, to the given power; rows in less than a share
    ``least`` of the documents stay 0, as they can only learn texts by heart. Without a second label the score
    is the labels' share.
    """
    rng = np.random.default_rng(seed)
    drawn = np.bincount(b.labels, minlength=2)
    model = SubwordModel(np.zeros((BUCKETS, width)), rng.normal(0, 1 / np.sqrt(width), (width, 2)), np.log((np.array(totals) + 1.0) / (sum(totals) + 2.0)))
    seen = document_frequency(b)
    often = np.flatnonzero(seen >= max(1, least * len(b.labels)))
    if not drawn.all() or not len(often):
        return model
    importance = (np.maximum(totals, 1) / drawn)[b.labels]
    scale = np.log((len(b.labels) + 1) / seen[often]) ** power
    place = np.full(BUCKETS, -1)
    place[often] = np.arange(len(often))
    rows = replace(b, bucket=place[b.bucket])
    parts = {"table": rng.normal(0, 1 / width, (len(often), width)), "layer": model.layer, "bias": model.bias}
    first, second = ({k: np.zeros_like(v) for k, v in parts.items()} for _ in range(2))
    queue = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        while len(queue) < min(batch, len(b.labels)):
            queue = np.concatenate([queue, rng.permutation(len(b.labels))])
        chosen, queue = queue[:batch], queue[batch:]
        _, grad = loss_and_gradients(parts, rows, chosen, scale, importance[chosen])
        pace = rate * (1 - (step - 1) / steps)
        for k, value in parts.items():
            g = grad[k] + decay * value
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            value -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.table[often] = parts["table"] * scale[:, None]
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> SubwordModel:
    """A model from labelled rows outside the held-out fold (crc32 of the id in decimal, modulo ``folds``).

    At most ``sample`` documents of each label are read, in hash order of their ids, with their
    whole texts. A repeated id in labels counts by its smallest label, in docs by its smallest
    text; null ids, texts and labels, and labels other than 0 and 1, are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(F.pmod(arrow.crc32_of_id("doc_id"), F.lit(folds)) != held_out).groupBy("doc_id").agg(F.min("label").alias("label"))
    counted = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    order = (F.xxhash64("doc_id"), "doc_id")
    parts = [known.where(F.col("label") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 x sample rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *document_words(batch.column(2))], ["doc_id", "label", "words", "counts"])

    found = arrow.map_texts(rows, encode, "doc_id long, label int, words array<binary>, counts array<int>", ["doc_id", "label", "text"])
    table = found.toArrow().sort_by("doc_id").combine_chunks()  # at most 2 x sample rows
    column = lambda name, kind: table[name].cast(pa.list_(kind)).combine_chunks() if table.num_rows else pa.array([], pa.list_(kind))
    return fit(bags(column("words", pa.binary()), column("counts", pa.int32()), np.asarray(table["label"])), (counted.get(0, 0), counted.get(1, 0)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, over its whole text, by a model that never saw the held-out fold.

    Null and empty texts and texts without words score what the bias says; repeated rows each
    give a row; a null id is in no fold; columns of other names are ignored. An empty table
    gives no row, and without labels every score is 0.5.
    """
    gain, rest = learn(docs, labels).folded()
    shared = docs.sparkSession.sparkContext.broadcast((gain.astype(np.float32), rest))  # one number a bucket

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = scores(batch.column(1), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array((values >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = arrow.map_texts(docs, score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int", ["doc_id", "text"])
    return scored.select("doc_id", F.coalesce(F.pmod(arrow.crc32_of_id("doc_id"), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
