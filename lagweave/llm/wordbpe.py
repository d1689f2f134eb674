"""Ids of a lower-casing word BPE vocabulary, for many texts at once.

The ids are those of the tokenizers library. Texts are normalised and split as the file
says, and the distinct pre-tokens of a slice are then merged together: in each round every
pre-token applies its lowest-ranked pair. Texts with special tokens, with characters newer
than this interpreter's tables, and pre-tokens beyond ``LONG`` bytes go through the library
itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

from . import pretokens, ragged
from .bpe import byte_characters

#: Bytes of the longest pre-token that is merged here.
LONG = 48
NEVER = np.int32(2**31 - 1)


class WordCoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.special = [x["content"].encode() for x in file["added_tokens"]]
        self.inner, self.final = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in byte_characters().items():
            self.inner[b], self.final[b] = vocabulary[c], vocabulary[c + end]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self._table(keys, merged)

    def _table(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """A hash table from pairs to (rank, token), probed in steps of one."""
        bits = max(10, int(len(keys) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks, self.tokens = np.full(1 << bits, NEVER, np.int32), np.zeros(1 << bits, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, winners = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = winners[free[winners]]
            self.keys[slot[won]], self.ranks[slot[won]], self.tokens[slot[won]] = keys[left[won]], left[won], merged[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table's slot of each pair; a slot of rank NEVER if it is no merge."""
        keys = (left << 20 | right).ravel()
        slot = self._slot(keys)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return slot.reshape(left.shape)

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids of equal length, merged; the flat ids and their numbers by row."""
        rows, width = ids.shape
        done_ids, done_rows = [], []
        live = np.arange(rows)
        while len(live):
            width = ids.shape[1]
            if width > 1:
                slots = self._find(ids[:, :-1], ids[:, 1:])
                ranks = self.ranks[slots]
                best = ranks.argmin(1)
                here = np.arange(len(live))
                go = ranks[here, best] != NEVER
            else:
                go = np.zeros(len(live), bool)
            if not go.all():
                done_ids.append(ids[~go])
                done_rows.append(live[~go])
            if not go.any():
                break
            ids, live, best = ids[go], live[go], best[go]
            token = self.tokens[slots[go][np.arange(len(live)), best]]
            column = np.arange(width - 1)
            ids = np.take_along_axis(ids, column + (column > best[:, None]), 1)
            ids[np.arange(len(live)), best] = token
        sizes = np.zeros(rows, np.int64)
        for x, r in zip(done_ids, done_rows):
            sizes[r] = x.shape[1]
        at = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.uint32)
        for x, r in zip(done_ids, done_rows):
            flat[at[r][:, None] + np.arange(x.shape[1])] = x
        return flat, sizes

    def _pieces(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens: flat, and how many each has."""
        counts, parts, owners = np.zeros(len(starts), np.int64), [], []
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            if n > LONG:
                found = [self.library.encode(buf[s : s + n].tobytes().decode(), add_special_tokens=False).ids for s in starts[own].tolist()]
                flat, size = np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
            else:
                raw = buf[starts[own][:, None] + np.arange(n)]
                ids = self.inner[raw]
                ids[:, -1] = self.final[raw[:, -1]]
                flat, size = self._merge(ids)
            counts[own] = size
            parts.append(flat)
            owners.append(own)
        flat = np.concatenate([np.zeros(0, np.uint32), *parts])
        order = np.concatenate([np.zeros(0, np.int64), *owners])
        at = np.zeros(len(starts), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return ragged.gather(flat, at, counts), counts

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of many texts, and where each text's begin (n + 1)."""
        raw, given = buf.tobytes(), offsets.tolist()
        odd = pretokens.unknown_texts(buf, offsets)
        if any(m in raw for m in self.special):
            odd |= np.array([any(m in raw[a:b] for m in self.special) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], bool)
        if len(buf) and buf.max() < 0x80:
            normal = buf + np.where((buf >= 65) & (buf <= 90), 32, 0).astype(np.uint8)
        else:
            normal, offsets = ragged.pack_bytes([self._normal(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        starts, ends, first = pretokens.word_pretokens(normal, offsets)
        index, inverse = ragged.unique_spans(normal, starts, ends)
        flat, sizes = self._pieces(normal, starts[index], (ends - starts)[index])
        at = np.cumsum(sizes) - sizes
        ids, edges = ragged.gather(flat, at[inverse], sizes[inverse]), ragged.bounds(sizes[inverse])[first]
        if odd.any():
            own = np.split(ids, edges[1:-1])
            for i in np.flatnonzero(odd).tolist():
                own[i] = np.array(self.library.encode(raw[given[i] : given[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
            ids, edges = np.concatenate(own), ragged.bounds(np.array([len(x) for x in own], np.int64))
        return ids, edges

    @staticmethod
    def _normal(raw: bytes) -> bytes:
        text = raw.decode()
        if text.isascii():
            return raw.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower().encode()  # each character by itself


@functools.cache
def coder(path: str) -> WordCoder:
    return WordCoder(path)
