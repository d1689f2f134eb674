"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by a learned
layer over shape statistics (letters, case, digits, symbols, repetition, lines), gated
attention weighs the encoded passages, and the weighted sum is scored. Only documents have
labels; the attention learns which passages decide.

The model is fitted on the driver from all passages of a bounded number of labelled
documents (``sample``, by hash order), of which only the features come from the executors;
scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, ragged

PASSAGE = 64
#: Labelled documents to fit on.
SAMPLE = 3000

_CLASS = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 other mark, 5 white space, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[list(b"#*$%&|<>{}[]\\^~=+@_")] = 3
_CLASS[ragged.IS_SPACE] = 5
_CLASS[128:192], _CLASS[192:] = 7, 6  # continuation bytes count nowhere

N_FEATURES = 20


def passage_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of statistics for each passage, and each text's first passage (n + 1). A text without words has one row of zeros."""
    starts, ends, first = ragged.words(buf, offsets)
    n_words = np.diff(first)
    counts = np.maximum(-(-n_words // PASSAGE), 1)
    edges = ragged.bounds(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = first[doc] + (np.arange(len(doc)) - edges[doc]) * PASSAGE
    end = np.minimum(begin + PASSAGE, first[doc + 1])
    out = np.zeros((len(doc), N_FEATURES), np.float32)
    full = np.flatnonzero(end > begin)
    if not len(full):
        return out, edges
    b, e = begin[full], end[full]
    n = (e - b).astype(float)
    low, high = starts[b], ends[e - 1]
    kind = _CLASS[buf]
    capital = np.zeros(len(buf), bool)  # accented Latin capitals
    capital[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    share = []
    for mask in (kind == 0, (kind == 1) | capital, kind == 2, kind == 3, kind == 4, kind == 6, buf == 10):
        total = ragged.bounds(mask)
        share.append(total[high] - total[low])
    lower, upper, digits, symbols, marks, beyond, lines = (x.astype(float) for x in share)
    visible = np.maximum(lower + upper * 1.0 + digits + symbols + marks + beyond, 1)
    letters = np.maximum(lower + upper + beyond, 1)

    size = (ends - starts).astype(float)
    passage = np.repeat(np.arange(len(b)), e - b)
    hashes = ragged.span_hashes(buf, starts, ends)
    per = lambda x: np.bincount(passage, x, len(b))
    inner = np.ones(len(starts), bool)
    inner[b] = False
    again = np.zeros(len(starts), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    kinds = np.unique(ragged.mix(hashes) ^ ragged.mix(passage.astype(np.uint64)), return_index=True, return_counts=True)
    most = np.zeros(len(b))
    np.maximum.at(most, passage[kinds[1]], kinds[2])
    last = kind[ends - 1]
    head = kind[starts]
    mean = per(size) / n
    columns = (
        np.log1p(n), mean, np.sqrt(np.maximum(per(size * size) / n - mean * mean, 0)), lower / letters, upper / letters, digits / visible,
        symbols / visible, marks / visible, beyond / letters, np.log1p(lines),
        np.bincount(passage[kinds[1]], minlength=len(b)) / n, most / n, per(again & inner) / n,
        per(last == 3) / n, per(last == 4) / n, per(head == 1) / n, per(size <= 3) / n, per(size == 1) / n, per(size > 20) / n,
        per((head == 3) & (size == 1)) / n,
    )
    out[full] = np.stack(columns, 1)
    return out, edges


@dataclass
class AttentionModel:
    """Encoder (W, b), gated attention (V, U, w), scorer (c, d), and the scaling of features."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        h = np.tanh(np.clip((x - self.mean) / self.scale, -5, 5) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        weight = np.exp(raw - np.maximum.reduceat(raw, edges[:-1])[bag])
        weight /= np.add.reduceat(weight, edges[:-1])[bag]
        z = np.add.reduceat(h * weight[:, None], edges[:-1])
        return {"h": h, "t": t, "g": g, "a": weight, "z": z, "bag": bag, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def score(self, x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Each bag's score; every bag has a passage at least."""
        return self._forward(x, edges)["score"] if len(edges) > 1 else np.zeros(0)


def fit(x: np.ndarray, edges: np.ndarray, labels: np.ndarray, hidden: int = 16, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Fit by Adam on the cross-entropy of the bags' scores. Without any label the score is 0.5, with one kind its share."""
    rng = np.random.default_rng(seed)
    wide = x.shape[1]
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    parts = {"W": draw(wide, hidden), "b": np.zeros(hidden), "V": draw(hidden, hidden), "U": draw(hidden, hidden), "w": draw(hidden), "c": draw(hidden), "d": np.zeros(())}
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (n + 2)
        parts["c"] *= 0
        parts["d"] = np.array(np.log(share / (1 - share)))
        return AttentionModel(np.zeros(wide), np.ones(wide), parts)
    mean, scale = x.mean(0).astype(float), np.maximum(x.std(0).astype(float), 1e-3)
    model = AttentionModel(mean, scale, parts)
    unit = np.clip((x - mean) / scale, -5, 5)
    first = {k: np.zeros_like(v) for k, v in parts.items()}
    second = {k: np.zeros_like(v) for k, v in parts.items()}
    for step in range(1, steps + 1):
        f, p = model._forward(x, edges), model.parts
        d_out = (f["score"] - labels) / n
        grad = {"c": f["z"].T @ d_out, "d": d_out.sum()}
        d_z = (d_out[:, None] * p["c"])[f["bag"]]
        d_a = (d_z * f["h"]).sum(1)
        d_raw = f["a"] * (d_a - np.add.reduceat(f["a"] * d_a, edges[:-1])[f["bag"]])
        grad["w"] = (f["t"] * f["g"]).T @ d_raw
        d_gate = d_raw[:, None] * p["w"]
        d_t, d_g = d_gate * f["g"] * (1 - f["t"] ** 2), d_gate * f["t"] * f["g"] * (1 - f["g"])
        grad["V"], grad["U"] = f["h"].T @ d_t, f["h"].T @ d_g
        d_h = (d_z * f["a"][:, None] + d_t @ p["V"].T + d_g @ p["U"].T) * (1 - f["h"] ** 2)
        grad["W"], grad["b"] = unit.T @ d_h, d_h.sum(0)
        for k in parts:
            g = grad[k] + decay * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            parts[k] = parts[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        model.parts = parts
    return model


def sample_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, bag edges and labels of a bounded sample of labelled rows, in hash order of their ids.

    docs: (doc_id, text), labels: (doc_id, label 0 or 1). A repeated id in labels counts by
    its smallest label, in docs by its smallest text; null ids, texts and labels are left out.
    """
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, edges = passage_features(*ragged.text_bytes(batch.column(2)))
        bags = [x[a:b].ravel() for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.float32()))], ["doc_id", "label", "x"])

    found = arrow.map_texts(rows, encode, "doc_id long, label int, x array<float>", ["doc_id", F.col("label").cast("int").alias("label"), "text"], ragged.SMALL_SLICE_BYTES)
    found = found.toPandas().sort_values("doc_id")  # at most ``sample`` rows
    sizes = np.array([len(v) // N_FEATURES for v in found["x"]], np.int64)
    x = np.concatenate([np.zeros(0, np.float32), *found["x"]]).reshape(-1, N_FEATURES)
    return x, ragged.bounds(sizes), found["label"].to_numpy().astype(float)


def score_documents(docs: DataFrame, model: AttentionModel, keep: list[str], threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """Each row's ``keep`` columns, score and predicted (1 from the threshold on), over its whole text.

    Null and empty texts are bags of one passage of zeros, and are scored. Repeated rows each give a row.
    """
    fields = docs.select(*keep).schema.fields
    schema = ", ".join([f"`_keep_{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)] + ["score double", "predicted int"])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = model.score(*passage_features(*ragged.text_bytes(batch.column(len(fields)))))
        columns = [batch.column(i) for i in range(len(fields))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(values), pa.array((values >= threshold).astype(np.int32))], [*(f"_keep_{i}" for i in range(len(fields))), "score", "predicted"])

    columns = [F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)]
    scored = arrow.map_texts(docs, score, schema, [*columns, F.col(f"`{text_column}`").alias("text")], ragged.SMALL_SLICE_BYTES)
    return scored.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> AttentionModel:
    """A model from labelled rows outside the held-out fold (crc32 of the id in decimal, modulo ``folds``)."""
    rows = labels.where(F.pmod(arrow.crc32_of_id("doc_id"), F.lit(folds)) != held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
    return fit(*sample_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, sample))


def keep_good(docs: DataFrame, model: AttentionModel, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts score the threshold or more, with all columns. Null and empty texts are scored like any; repeated rows are each kept or not."""
    return arrow.filter_texts(docs, lambda texts: model.score(*passage_features(*ragged.text_bytes(texts))) >= threshold, text_column, ragged.SMALL_SLICE_BYTES)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by a model that never saw the held-out fold."""
    scored = score_documents(docs, learn(docs, labels), ["doc_id"])
    # a null id is in no fold
    return scored.select("doc_id", F.coalesce(F.pmod(arrow.crc32_of_id("doc_id"), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
