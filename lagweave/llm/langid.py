"""Language of words in code-switched text, by a linear-chain conditional random field.

A word's features are its affixes, its byte n-grams with word boundaries, and itself (the
lexicon), hashed into one table of weights. Learned transitions tie neighbouring words, and
forward-backward gives each word's label probabilities; a document's language is the label
with the largest expected number of words, and the score that label's share.

Documents carry one label, though parts may be in another language. Fitting therefore goes
from a model without transitions on the documents' labels to word labels smoothed along the
text, and then fits emissions and transitions together on these. It uses the whole texts of a
bounded sample, ``sample`` documents a language by hash order. Their words become blocks of
feature slots, settled as a table; each round sums the gradient of all blocks on the
executors, and only ``BLOCKS`` sums of the table's size reach the driver.

Prediction is one pass without a shuffle. Long texts are cut into segments whose transfer
matrices are multiplied, so that the result is exact and the number of steps bounded. Words
are scored once for each different word of a slice; their features are made for some words at
a time and added to the scores at once, and probabilities for some texts at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrow, pretokens, ragged, storage

#: Documents a language to fit on, languages at most, and partitions of the blocks that are fitted on.
SAMPLE, MOST_LANGUAGES, BLOCKS = 200, 64, 4
#: Rounds without and with transitions.
ROUNDS = (20, 15)
#: Texts of so many words set the least evidence of a learned language, of which a text needs this share.
LONG, EVIDENCE = 20, 0.6
TABLE_BITS = 16
SEGMENT = 256
#: Bytes of words whose features are made at once, and scores (words times languages) whose probabilities are, or those of one text.
AT_ONCE, CELLS_AT_ONCE = 1 << 18, 1 << 20
#: Bytes of text in a slice that is labelled: words seen before save time, and fewer take less memory.
SLICE_BYTES = 2 << 20
UNDETERMINED = "und"

_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[65:91] = _LETTER_BYTE[97:123] = _LETTER_BYTE[128:] = True
_ASCII_LETTER = _LETTER_BYTE & (np.arange(256) < 128)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte by byte."""
    out = _LOWER[buf]
    if len(buf) > 1:
        out[1:] += ((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)).view(np.uint8) << np.uint8(5)
    return out


def cores(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word from its first to its last letter; empty if it has none."""
    first, end = starts.copy(), starts.copy()
    for a, b in ragged.runs(ends - starts, AT_ONCE):
        begin = starts[a]
        at = np.flatnonzero(_LETTER_BYTE[buf[begin : ends[b - 1]]]) + begin
        low, high = np.searchsorted(at, starts[a:b]), np.searchsorted(at, ends[a:b]) - 1
        has = np.flatnonzero(low <= high)
        first[a + has], end[a + has] = at[low[has]], at[high[has]] + 1
    return first, end


def with_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter. Characters are looked up only in texts without an ASCII letter."""
    out = np.zeros(len(offsets) - 1, bool)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.logical_or.reduceat(_ASCII_LETTER[buf], offsets[full])
    for i in full[~out[full]].tolist():
        code = pretokens.characters(buf[offsets[i] : offsets[i + 1]])[1]
        out[i] = (pretokens.class_table()[code] == pretokens.LETTER).any()
    return out


def entry_parts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of words, in parts of bounded size: (word, slot) of each entry, by word. Words without letters have none."""
    full = np.flatnonzero(ends > starts)
    slot = lambda value, kind: (ragged.mix(value * ragged.U64(16) + ragged.U64(kind)) >> ragged.U64(64 - TABLE_BITS)).astype(np.int64)
    for a, b in ragged.runs(ends[full] - starts[full] + 2, AT_ONCE):
        own = full[a:b]
        sizes = ends[own] - starts[own]
        edge = ragged.bounds(sizes + 2)  # each word between two spaces
        flat = np.full(int(edge[-1]), 32, np.uint8)
        inside = np.ones(len(flat), bool)
        inside[edge[:-1]] = inside[edge[1:] - 1] = False
        flat[inside] = ragged.gather(buf, starts[own], sizes)
        at = ragged.lanes(flat)
        for begin in range(0, len(flat), AT_ONCE):
            position = np.arange(begin, min(begin + AT_ONCE, len(flat)))
            word = np.searchsorted(edge, position, "right") - 1
            left = edge[word + 1] - position
            for n in (2, 3, 4):
                ok = np.flatnonzero(left >= n)
                yield own[word[ok]], slot(at[position[ok]] & ragged.U64((1 << 8 * n) - 1), n)
        for kind, n in ((5, 3), (6, 4)):
            long = np.flatnonzero(sizes >= n)
            mask = ragged.U64((1 << 8 * n) - 1)
            yield own[long], slot(at[edge[long] + 1] & mask, kind)
            yield own[long], slot(at[edge[long + 1] - 1 - n] & mask, kind + 2)
        yield own, slot(ragged.span_hashes(flat, edge[:-1], edge[1:]), 9)


def word_entries(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of ``entry_parts`` at once."""
    none = np.zeros(0, np.int64)
    parts = [(none, none), *entry_parts(buf, starts, ends)]
    return np.concatenate([word for word, _ in parts]), np.concatenate([slot for _, slot in parts])


def span_scores(weights: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ``emissions`` of words given as spans, without holding the entries of all."""
    total, count = np.zeros((len(starts), weights.shape[1])), np.zeros(len(starts))
    for word, slot in entry_parts(buf, starts, ends):
        if len(word):
            low, high = int(word[0]), int(word[-1]) + 1
            count[low:high] += np.bincount(word - low)
            for k in range(weights.shape[1]):
                total[low:high, k] += np.bincount(word - low, weights[slot, k])
    return total / np.sqrt(np.maximum(count, 1))[:, None]


def emissions(weights: np.ndarray, entries: tuple[np.ndarray, np.ndarray], n_words: int) -> np.ndarray:
    """Each word's score by label: the mean weight of its entries times a fixed gain."""
    word, slot = entries
    count = np.maximum(np.bincount(word, minlength=n_words), 1)
    return np.stack([np.bincount(word, weights[slot, k], n_words) / np.sqrt(count) for k in range(weights.shape[1])], 1)


def posteriors(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and the expected numbers of transitions.

    first: the index of each sequence's first word (n + 1). The label before the first word is free.
    """
    n, k = scores.shape
    step = np.exp(transitions)
    e = np.exp(scores - scores.max(1, keepdims=True)) if n else scores
    sizes = np.diff(first)
    parts = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), parts)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[doc] + rank * SEGMENT
    length = np.minimum(first[doc + 1] - start, SEGMENT)
    order = np.argsort(-length, kind="stable")
    begin, length_o = start[order], length[order]
    live = np.searchsorted(-length_o, -np.arange(SEGMENT), side="left")  # segments longer than t
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)

    heads, tails = np.ones((len(doc), k)), np.ones((len(doc), k))
    if len(parts) and parts.max() > 1:
        m = np.broadcast_to(np.eye(k), (len(doc), k, k)).copy()
        for t in range(int(length_o[0])):
            s = live[t]
            m[:s] = (m[:s] @ step) * e[begin[:s] + t][:, None, :]
            m[:s] /= m[:s].sum((1, 2), keepdims=True)
        matrix = np.empty_like(m)
        matrix[order] = m
        for r in range(1, int(parts.max())):
            own = np.flatnonzero(rank == r)
            heads[own] = norm((heads[own - 1][:, None, :] @ matrix[own - 1])[:, 0], 1)
        for r in range(int(parts.max()) - 2, -1, -1):
            own = np.flatnonzero((rank == r) & (parts[doc] > r + 1))
            tails[own] = norm((matrix[own + 1] @ tails[own + 1][:, :, None])[:, :, 0], 1)
    out = np.empty_like(scores)
    alpha, moved = heads[order], np.zeros((k, k))
    for t in range(int(length_o[0]) if len(order) else 0):
        s = live[t]
        alpha[:s] = norm((alpha[:s] @ step) * e[begin[:s] + t], 1)
        out[begin[:s] + t] = alpha[:s]
    beta = tails[order]
    last = begin + length_o - 1
    for t in range(int(length_o[0]) if len(order) else 0):
        s = live[t]
        at = last[:s] - t
        ahead = e[at] * beta[:s]
        before = np.where((t == length_o[:s] - 1)[:, None], heads[order[:s]], out[at - 1])  # a segment's first word follows its head
        inner = (t < length_o[:s] - 1) | (rank[order[:s]] > 0)
        pair = before[:, :, None] * step * ahead[:, None, :]
        moved += (pair[inner] / pair[inner].sum((1, 2), keepdims=True)).sum(0)
        out[at] = norm(out[at] * beta[:s], 1)
        beta[:s] = norm(ahead @ step.T, 1)
    return out, moved


@dataclass
class ChainModel:
    languages: list[str]
    weights: np.ndarray  # (slots, languages)
    transitions: np.ndarray  # (languages, languages)
    #: The evidence below which a text is in no learned language: ``EVIDENCE`` of the least of the texts fitted on.
    floor: float = 0.0

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected shares of the labels among each text's words with letters, how many such words there are, and their mean evidence.

        A word's evidence is the score of its best label before any transition: words whose
        features were never seen have none.
        """
        k, n = len(self.languages), len(offsets) - 1
        buf = _fold(buf)
        starts, ends, first = ragged.words(buf, offsets)
        starts, ends = cores(buf, starts, ends)
        if not len(starts) or not k:
            return np.zeros((n, k)), np.zeros(n), np.zeros(n)
        index, inverse = ragged.unique_spans(buf, starts, ends)
        of_word = span_scores(self.weights, buf, starts[index], ends[index])
        real = (ends > starts).astype(float)
        counts, totals, evidence = ragged.sums(real, first), np.zeros((n, k)), np.zeros(n)
        for a, b in ragged.runs(np.diff(first), max(CELLS_AT_ONCE // k, 1)):
            own, edges = slice(first[a], first[b]), first[a : b + 1] - first[a]
            scores = of_word[inverse[own]]
            gamma, _ = posteriors(scores, edges, self.transitions)
            for j in range(k):
                totals[a:b, j] = ragged.sums(gamma[:, j] * real[own], edges)
            evidence[a:b] = ragged.sums(scores.max(1) * real[own], edges)
        return totals / np.maximum(counts, 1)[:, None], counts, evidence / np.maximum(counts, 1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Each text's language and its share of the words; ``und`` and 0 without a letter."""
        return self.judge(texts)[:2]

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """As ``predict``, and the mean evidence of each text's words."""
        buf, offsets = ragged.text_bytes(texts)
        shares, counts, evidence = self.documents(buf, offsets)
        known = with_letter(buf, offsets) & bool(self.languages)
        best = shares.argmax(1) if self.languages else np.zeros(len(counts), int)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), known.tolist())]
        return names, np.where(known, np.clip(shares.max(1, initial=0.0), 0, 1), 0.0), evidence


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.state = rate, 0, {}

    def __call__(self, name: str, value: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        m, v = self.state.get(name, (np.zeros_like(value), np.zeros_like(value)))
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        self.state[name] = m, v
        return value + self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


@dataclass
class Block:
    """Words of some whole texts: entries (word kind, slot), each word's kind, each text's first word and label, and word labels if known. Rows hold 32 bits a number."""

    kind: np.ndarray
    slot: np.ndarray
    words: np.ndarray
    first: np.ndarray
    label: np.ndarray
    gold: np.ndarray

    SCHEMA = "kind binary, slot binary, words binary, first binary, label binary, gold binary"

    @classmethod
    def of_texts(cls, buf: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> Block:
        buf = _fold(buf)
        starts, ends, first = ragged.words(buf, offsets)
        starts, ends = cores(buf, starts, ends)
        index, words = ragged.unique_spans(buf, starts, ends) if len(starts) else (starts, starts)
        return cls(*word_entries(buf, starts[index], ends[index]), words, first, label, np.zeros(0, np.int64))

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Iterator[Block]:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            yield cls(*(np.frombuffer(x, np.int32).astype(np.int64) for x in row))

    def row(self) -> pa.RecordBatch:
        parts = (self.kind, self.slot, self.words, self.first, self.label, self.gold)
        return pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in parts], [c.split()[0] for c in self.SCHEMA.split(", ")])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        n = int(self.words.max(initial=-1)) + 1
        return emissions(weights, (self.kind, self.slot), n)[self.words]

    def gradient(self, residual: np.ndarray, by_kind: bool = False) -> np.ndarray:
        """The sum over words of the gradient of the weights, from the gradient of the scores of words, or of kinds of words."""
        n = int(self.words.max(initial=-1)) + 1
        root = np.sqrt(np.maximum(np.bincount(self.kind, minlength=n), 1))
        kinds = [x if by_kind else np.bincount(self.words, x, n) for x in residual.T]
        return np.stack([np.bincount(self.slot, (x / root)[self.kind], 1 << TABLE_BITS) for x in kinds], 1)

    def pairs(self, k: int) -> np.ndarray:
        """Numbers of neighbouring word labels within texts."""
        inner = np.ones(len(self.gold), bool)
        inner[self.first[:-1][np.diff(self.first) > 0]] = False
        at = np.flatnonzero(inner)
        return np.bincount(self.gold[at - 1] * k + self.gold[at], minlength=k * k).reshape(k, k)


def _summed(blocks: DataFrame, k: int, part: Callable[[Block], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The sums of ``part`` (gradients of weights and transitions) and of words over all blocks; a partition gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves, n = np.zeros((1 << TABLE_BITS, k)), np.zeros((k, k)), 0
        for batch in batches:
            for block in Block.read(batch):
                if len(block.words):
                    w, m = part(block)
                    weights, moves, n = weights + w, moves + m, n + len(block.words)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()]), pa.array([moves.tobytes()]), pa.array([n])], ["weights", "moves", "n"])

    rows = blocks.mapInArrow(run, "weights binary, moves binary, n long").toArrow().to_pylist()  # at most BLOCKS rows
    weights = sum((np.frombuffer(r["weights"], np.float32).reshape(-1, k).astype(float) for r in rows), np.zeros((1 << TABLE_BITS, k)))
    return weights, sum((np.frombuffer(r["moves"]).reshape(k, k) for r in rows), np.zeros((k, k))), sum(r["n"] for r in rows)


def fit(rows: DataFrame, languages: list[str], rounds: tuple[int, int] = ROUNDS, rate: float = 0.1, decay: float = 1e-5) -> ChainModel:
    """Fit on the whole texts of (doc_id, lang, text), each of one of the languages."""
    k = len(languages)
    weights, transitions = np.zeros((1 << TABLE_BITS, k), np.float32), np.zeros((k, k))
    if k < 2:
        return ChainModel(languages, weights, transitions)

    def prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
        label = np.array([languages.index(x) for x in batch.column(1).to_pylist()], np.int64)
        return Block.of_texts(*ragged.text_bytes(batch.column(2)), label).row()

    dealt = rows.repartition(BLOCKS).sortWithinPartitions("doc_id", "lang")
    blocks = storage.settle(arrow.map_texts(dealt, prepare, Block.SCHEMA, ["doc_id", "lang", "text"]))

    def by_document(block: Block) -> tuple[np.ndarray, np.ndarray]:
        # without transitions a word counts by its kind and its document's label alone
        n = int(block.words.max()) + 1
        seen = np.bincount(block.words * k + np.repeat(block.label, np.diff(block.first)), minlength=n * k).reshape(n, k)
        s = emissions(weights, (block.kind, block.slot), n)
        p = np.exp(s - s.max(1, keepdims=True))
        return block.gradient(seen - seen.sum(1, keepdims=True) * p / p.sum(1, keepdims=True), by_kind=True), np.zeros((k, k))

    adam = _Adam(rate)
    for _ in range(rounds[0]):
        adam.step += 1
        gradient, _, n = _summed(blocks, k, by_document)
        if not n:
            return ChainModel(languages, weights, transitions)
        weights = adam("weights", weights, gradient / n - decay * weights).astype(np.float32)
    sticky = np.full((k, k), np.log(0.02 / max(k - 1, 1)))
    np.fill_diagonal(sticky, np.log(0.98))

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in Block.read(batch):
                block.gold = posteriors(block.scores(weights), block.first, sticky)[0].argmax(1)
                yield block.row()

    blocks = storage.settle(blocks.mapInArrow(smooth, Block.SCHEMA))
    transitions, adam = sticky.copy(), _Adam(rate)

    def by_word(block: Block) -> tuple[np.ndarray, np.ndarray]:
        p, expected = posteriors(block.scores(weights), block.first, transitions)
        p = -p
        p[np.arange(len(p)), block.gold] += 1
        return block.gradient(p), block.pairs(k) - expected

    for _ in range(rounds[1]):
        adam.step += 1
        gradient, moves, n = _summed(blocks, k, by_word)
        weights = adam("weights", weights, gradient / n - decay * weights).astype(np.float32)
        transitions = np.clip(adam("transitions", transitions, moves / n - 1e-4 * transitions), -12, 12)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.inf]
        for batch in batches:
            for block in Block.read(batch):
                long = np.diff(block.first) >= LONG
                mean = ragged.sums(block.scores(weights).max(1), block.first) / np.maximum(np.diff(block.first), 1)
                found += mean[long].tolist()
        yield pa.RecordBatch.from_arrays([pa.array([min(found)])], ["least"])

    floor = min(r["least"] for r in blocks.mapInArrow(least, "least double").collect())  # at most BLOCKS rows
    return ChainModel(languages, weights, transitions, EVIDENCE * floor if np.isfinite(floor) else 0.0)


def training_rows(docs: DataFrame, sample: int = SAMPLE, most_languages: int = MOST_LANGUAGES) -> tuple[DataFrame, list[str]]:
    """A bounded sample of (doc_id, lang, text), whole texts, and the languages: ``sample`` documents of each by hash order.

    Rows with a null in any of the three are left out; of a repeated id the smallest text
    counts once for a language. Candidates are the ids in so small a range of hashes that
    about four times the sample lie there, so no task ranks more. More than
    ``most_languages`` languages are an error, as the model has a weight table for each.
    """
    known = docs.where("doc_id is not null and lang is not null and text is not null")
    # ids are drawn, so ids are counted: rows of one id, however many, change nothing
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    h = F.xxhash64("doc_id")
    inside = F.lit(False)
    for lang, n in counts.items():
        limit = -(2**63) + int(min(1.0, 4 * sample / n) * (2**64 - 1))
        inside = F.when(F.col("lang") == lang, h <= min(limit, 2**63 - 1)).otherwise(inside)
    order = Window.partitionBy("lang").orderBy(h, "doc_id")
    ids = known.where(inside).select("doc_id", "lang").distinct().withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).drop("_rank")
    # at most sample x most_languages ids
    return known.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")), sorted(counts)


def learn(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, most_languages: int = MOST_LANGUAGES) -> ChainModel:
    """A model from rows with a language outside the held-out fold (crc32 of the id in decimal, modulo ``folds``)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.pmod(arrow.crc32_of_id("doc_id"), F.lit(folds)) != held_out)
    return fit(*training_rows(rows, sample, most_languages))


def label_documents(docs: DataFrame, model: ChainModel, keep: list[str], text_column: str = "text") -> DataFrame:
    """Each row's ``keep`` columns, lang_pred and score over its whole text.

    A null text, or one without a letter, is ``und`` with score 0. Repeated rows each give a row.
    """
    fields = docs.select(*keep).schema.fields
    names = [f"_keep_{i}" for i in range(len(fields))]
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields)] + ["lang_pred string", "score double"])

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, score = model.predict(batch.column(len(fields)))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(languages, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    found = arrow.map_texts(docs, label, schema, [*columns, F.col(f"`{text_column}`").alias("text")], SLICE_BYTES)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "score")


def keep_identified(docs: DataFrame, model: ChainModel, least: float = 0.35, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` in which some language holds at least that share of the words, with all columns.

    Undetermined texts go, null and empty ones too, and so do texts whose words have too little
    evidence for any learned language: other scripts, unlike languages, letter noise.
    Repeated rows are each kept or not.
    """

    def keeps(texts: pa.Array) -> np.ndarray:
        languages, score, evidence = model.judge(texts)
        return (np.array(languages, object) != UNDETERMINED) & (score >= least) & (evidence >= model.floor)

    return arrow.filter_texts(docs, keeps, text_column, SLICE_BYTES)


def document_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by a model that never saw the held-out fold."""
    found = label_documents(docs, learn(docs), ["doc_id"])
    # a null id is in no fold
    return found.select("doc_id", F.coalesce(F.pmod(arrow.crc32_of_id("doc_id"), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
