import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lagweave.llm import bpe, packing, ragged, wordbpe

from .helpers import documents, empty, texts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"abstrevmld'' '  \n\n\t!?.12é漢😀ß  ñ²́\x1c\x85ΣİAQÉ", "<|endoftext|>", "the", "ing", "aaaa", "    ", "ؠ", "͸", "=====", "x" * 70, "Ω", "Å"]


@pytest.mark.parametrize("path, coder", [(BYTE, bpe.coder), (WORD, wordbpe.coder)])
def test_ids_are_the_librarys(path, coder):
    library, own, rng = Tokenizer.from_file(path), coder(path), random.Random(4)
    for _ in range(60):
        docs = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(12)]
        ids, at = own.encode(*ragged.pack_bytes([d.encode() for d in docs]))
        for i, d in enumerate(docs):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(d, add_special_tokens=False).ids, repr(d)


def test_unique_spans_compare_bytes():
    buf, offsets = ragged.pack_bytes([b"ab", b"", b"ab", b"a" * 50, b"a" * 50, b"b" * 50])
    index, inverse = ragged.unique_spans(buf, offsets[:-1], offsets[1:])
    assert len(index) == 4 and inverse[0] == inverse[2] and inverse[3] == inverse[4] != inverse[5]


def test_round_trip_query(spark):
    docs, library = documents(spark), Tokenizer.from_file(BYTE)
    got = Counter(tuple(r) for r in bpe.round_trip_digests(docs, BYTE).collect())
    want = Counter()
    for row in docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip_digests(empty(spark), BYTE).count() == 0
    decoded = {(r.doc_id, r.text) for r in bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE).collect()}
    assert decoded == {(r.doc_id, r.text or "") for r in docs.collect()}


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_holds_every_capacity(spark, rule):
    docs, library = documents(spark), Tokenizer.from_file(WORD)
    rows = packing.pack_documents(docs, WORD, capacity=128, max_documents=5, max_cost=9000 + 128 * 128, rule=rule, group_pieces=64).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= 128 and len(own) <= 5 and sum(r.length**2 for r in own) <= 9000 + 128 * 128
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for row in docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 128)):
            part = ids[start : start + 128]
            want[row.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert got == want
    assert packing.pack_documents(empty(spark), WORD).count() == 0


def test_packing_is_tight():
    lengths = np.sort(np.random.default_rng(1).integers(1, 2049, 3000))[::-1]
    where, _ = packing.best_fit(lengths, 2048, 2048, 2048**2)
    assert where.max() + 1 <= 1.02 * np.ceil(lengths.sum() / 2048)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([3000]), 2048, 2048, 2048**2)


def test_helper_texts_cover_the_cases():
    assert None in texts() and "" in texts()


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("weights", [(1.0, 1.0, 1.0), (1.0, 0.2, 3.0), (0.0, 1.0, 1.0)])
def test_choice_of_sequence_is_brute_force(rule, weights):
    """Each piece's sequence by plain loops over all sequences ever opened, with documents and cost that bind."""
    rng = random.Random(3)
    lengths = sorted((rng.choice([rng.randint(1, 200), rng.randint(1, 20)]) for _ in range(600)), reverse=True)
    full = (200, 7, 200 * 200)
    where, offset = packing.best_fit(np.array(lengths), *full, weights, rule)
    sequences, bound = [], Counter()
    for length, got, at in zip(lengths, where.tolist(), offset.tolist()):
        item = (length, 1, length * length)
        values = {}
        for k, (left, _) in enumerate(sequences):
            if all(a >= b for a, b in zip(left, item)):
                rest = [(a - b) / f for a, b, f in zip(left, item, full)]
                values[k] = sum(w * r * r for w, r in zip(weights, rest)) if rule == "norm" else -sum(w * a * b / f / f for w, a, b, f in zip(weights, left, item, full))
            elif left[0] >= length:
                bound[left[1] < 1] += 1  # tokens would have fitted
        if not values:
            assert got == len(sequences)
            sequences.append((full, 0))
        else:
            assert values[got] <= min(values.values()) + 1e-12
        left, used = sequences[got]
        assert at == used
        sequences[got] = (tuple(a - b for a, b in zip(left, item)), used + length)
    assert bound[True] > 100


def test_packing_keeps_columns_of_any_name(spark):
    pieces = spark.createDataFrame([(i % 3, 5, "x", None) for i in range(40)], "_row long, length long, `a.b` string, part string")
    out = packing.pack(pieces, 12, max_documents=2)
    assert out.columns == ["_row", "length", "a.b", "part", "sequence_id", "offset"] and out.count() == 40
    assert {r.n for r in out.groupBy("sequence_id").count().withColumnRenamed("count", "n").collect()} == {2}
