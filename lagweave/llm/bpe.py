"""BPE encoding and decoding by dynamic programming over prefixes.

Byte-pair encoding has a useful property: the encoding of every prefix of a pre-token is a
path of pairwise compatible tokens, and exactly one token that ends at a position is
compatible with the last token of the prefix before it. So one left-to-right pass finds
the unique last token of each prefix: an Aho-Corasick automaton (the suffix links of all
tokens) lists the tokens that end at a position, longest first, and the first one that is
compatible is kept. Back-pointers then give the ids.

Two neighbours are compatible if encoding their joint bytes gives the two back. That holds
unless a merge across the boundary comes up before the pieces at the boundary have been
merged away from it, which only the right edge of the left token and the left edge of the
right one decide.

Work is done once for each distinct pre-token of a slice and remembered, within a bound,
between slices of a worker.
"""

from __future__ import annotations

import functools
import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, pretokens, ragged

#: Pre-tokens whose ids a worker remembers; beyond that the memory is emptied.
REMEMBERED = 300_000
#: Pair tests a worker remembers.
REMEMBERED_PAIRS = 2_000_000
#: Longer pre-tokens are encoded each time they occur.
LONG = 64

NEVER = 1 << 60


def byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


class PrefixCoder:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        of = byte_characters()
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.token_bytes: dict[int, bytes] = {i: bytes(of[c] for c in t) for t, i in vocabulary.items() if t not in self.special}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.pair_token: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(file["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, token = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            self.pair_rank[pair], self.pair_token[pair] = rank, token
            if token not in self.parts:
                self.parts[token], self.rank[token] = pair, rank
        self.byte_token = {b: vocabulary[c] for c, b in of.items()}
        self.automaton = ahocorasick.Automaton()
        for token, raw in self.token_bytes.items():
            if token in self.parts or len(raw) == 1:
                self.automaton.add_word(raw.decode("latin-1"), (token, len(raw)))
        self.automaton.make_automaton()
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._ids: dict[bytes, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one side of a token, from its byte up, each with the rank of the merge that takes it in."""
        known = self._edges.get((token, side))
        if known is None:
            known, piece, taken = [], token, NEVER
            while True:
                known.append((piece, taken))
                if piece not in self.parts:
                    break
                taken, piece = self.rank[piece], self.parts[piece][side]
            known.reverse()
            self._edges[token, side] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joint bytes of two tokens are encoded as these two."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._no_merge_across(self._edge(a, 1), self._edge(b, 0))
        return known

    def _no_merge_across(self, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> bool:
        i = j = 0
        while True:
            (x, x_gone), (y, y_gone) = left[i], right[j]
            rank = self.pair_rank.get((x, y), NEVER)
            # of equal merges the leftmost comes first: the one inside a precedes, the one inside b follows
            if rank < x_gone and rank <= y_gone and rank != NEVER:
                return False
            if x_gone == y_gone == NEVER:
                return True
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            known = token not in self.parts or self._by_merging(self.token_bytes[token]) == [token]
            self._whole[token] = known
        return known

    def _by_merging(self, raw: bytes) -> list[int]:
        ids = [self.byte_token[b] for b in raw]
        while len(ids) > 1:
            rank, i = min((self.pair_rank.get(p, NEVER), i) for i, p in enumerate(zip(ids, ids[1:])))
            if rank == NEVER:
                break
            ids[i : i + 2] = [self.pair_token[ids[i], ids[i + 1]]]
        return ids

    def encode_piece(self, raw: bytes) -> bytes:
        """The ids of one pre-token, as little-endian unsigned 32-bit integers."""
        n = len(raw)
        last = [(0, 0)] * (n + 1)  # each prefix's last token and where it begins
        done, compatible, whole = 0, self.compatible, self.whole
        for end, (token, size) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if end == done:
                continue
            begin = end - size
            if whole(token) and (not begin or compatible(last[begin][0], token)):
                last[end], done = (token, begin), end
        ids = []
        while n:
            token, n = last[n]
            ids.append(token)
        return np.array(ids[::-1], "<u4").tobytes()

    def _remembered(self, raw: bytes) -> bytes:
        ids = self._ids.get(raw)
        if ids is None:
            ids = self.encode_piece(raw)
            if len(raw) <= LONG:
                if len(self._ids) >= REMEMBERED:
                    self._ids.clear()
                self._ids[raw] = ids
        return ids

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of many texts, and where each text's begin (n + 1)."""
        raw = buf.tobytes()
        odd = pretokens.unknown_texts(buf, offsets)
        marks = [s.encode() for s in self.special]
        if odd.any() or any(m in raw for m in marks):
            found = [self._encode_odd(raw[a:b], lib) for a, b, lib in zip(offsets[:-1].tolist(), offsets[1:].tolist(), odd.tolist())]
            sizes = np.array([len(x) for x in found], np.int64)
            return np.concatenate([np.zeros(0, np.uint32), *found]), ragged.bounds(sizes)
        return self._encode_plain(buf, raw, offsets)

    def _encode_plain(self, buf: np.ndarray, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = pretokens.byte_pretokens(buf, offsets)
        index, inverse = ragged.unique_spans(buf, starts, ends)
        pieces = [self._remembered(raw[a:b]) for a, b in zip(starts[index].tolist(), ends[index].tolist())]
        flat = np.frombuffer(b"".join(pieces), "<u4")
        sizes = np.array([len(p) // 4 for p in pieces], np.int64)
        at = np.cumsum(sizes) - sizes
        return ragged.gather(flat, at[inverse], sizes[inverse]), ragged.bounds(sizes[inverse])[first]

    def _encode_odd(self, raw: bytes, by_library: bool) -> np.ndarray:
        """One text with special tokens, or with characters that only the library's tables may know."""
        out, rest = [], raw.decode()
        while rest:
            at, mark = min(((rest.find(s), s) for s in self.special if s in rest), default=(len(rest), ""))
            part, rest = rest[:at], rest[at + len(mark) :]
            if by_library:
                pieces = [part[a:b].encode() for _, (a, b) in _library(self.path).pre_tokenizer.pre_tokenize_str(part)] if part else []
                out += [np.frombuffer(self._remembered(p), "<u4") for p in pieces]
            elif part:
                own, offsets = ragged.pack_bytes([part.encode()])
                out.append(self._encode_plain(own, own.tobytes(), offsets)[0])
            if mark:
                out.append(np.array([self.special[mark]], "<u4"))
        return np.concatenate([np.zeros(0, "<u4"), *out]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.cache
def coder(path: str) -> PrefixCoder:
    return PrefixCoder(path)


@functools.cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<bigint>) for every row. Null texts count as empty and get no ids; repeated rows stay."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = coder(vocabulary).encode(*ragged.text_bytes(batch.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return arrow.map_texts(docs, encode, "doc_id long, ids array<long>", [F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text")])


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of rows of ``encode_documents``; null ids give an empty text."""

    def decode(batches):
        for batch in batches:
            own = coder(vocabulary)
            texts = [own.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token count and digests of each text's ids and of the text decoded from them, in one pass without a shuffle.

    Null texts count as empty (no ids, digests of nothing); repeated rows each give a row;
    other columns are not read.
    """

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(vocabulary)
        ids, at = own.encode(*ragged.text_bytes(batch.column(1)))
        ids = ids.astype("<u4")
        counts, id_hashes, text_hashes = [], [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            counts.append(b - a)
            id_hashes.append(hashlib.sha256(ids[a:b].tobytes()).hexdigest())
            text_hashes.append(hashlib.sha256(own.decode(ids[a:b]).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow.map_texts(docs, digest, schema, [F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text")])
