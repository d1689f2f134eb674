"""Hard negatives, toxicity and fill-in-middle against brute force, and the awkward cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lagweave.llm import fillmiddle, negatives, toxicity
from tests.llm.helpers import documents, empty, texts

VECTORS = "vec_id long, embedding array<double>, label int, grp long, bits string, score double, place int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5, 2) for r in rows], VECTORS).repartition(3)


def some_vectors(seed, n, wide, labels=3, most=1.0):
    """Vectors with ties, repeats, nulls and values that aren't finite; ids from 0 on, some twice, some negative."""
    rng = random.Random(seed)
    rows = [(i - 100, [rng.choice([-1, 1]) * rng.random() ** 2 * most for _ in range(wide)], rng.randrange(labels)) for i in range(n)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(0, 40, 3)]  # copies under other ids
    rows += [rows[0], rows[100], rows[100], (100, [0.0] * wide, 1), (300, [0.25] * wide, None), (400, None, 1), (None, [0.5] * wide, 1), (500, [None] + [0.5] * (wide - 1), 1)]
    rows += [(600, [math.inf] + [0.1] * (wide - 1), 1), (601, [math.nan] + [0.1] * (wide - 1), 1), (700, [0.5], 2), (800, [], 2)]
    return rows


def brute_negatives(rows, every=100, positives=5, most=5):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for b, (j, w, other) in enumerate(kept) if b != a]
        same, rest = sorted(s[:2] for s in scored if s[2] == label)[:positives], sorted(s[:2] for s in scored if s[2] != label)
        for p, j in same:
            found = [(-n, k) for n, k in rest if -80 * p <= -100 * n <= -100 * p][:most]
            out += [(i, j, r + 1, k, -p, n) for r, (n, k) in enumerate(found)]
    return sorted(out)


def mined(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in df.collect())


@pytest.mark.parametrize(("wide", "most"), [(5, 1.0), (70, 0.4), (1, 30.0)])
def test_hard_negatives_are_brute_force(spark, monkeypatch, wide, most):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 3)
    rows = some_vectors(wide, 260, wide, most=most)
    for every in (100, 10):
        want = brute_negatives(rows, every)
        assert want and mined(negatives.hard_negatives(vectors(spark, rows), every)) == want


def test_hard_negatives_of_awkward_tables(spark):
    assert mined(negatives.hard_negatives(vectors(spark, []))) == []
    assert mined(negatives.hard_negatives(vectors(spark, [(0, [1.0], 1)]))) == []
    with pytest.raises(Exception, match="bits"):
        mined(negatives.hard_negatives(vectors(spark, [(0, [1e30], 1), (1, [1.0], 1)])))


def test_intervals_hold_every_score_and_drop_most_candidates():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-150, 150, (4, 64)), rng.integers(-150, 150, (500, 64))
    exact = a @ b.T
    top = np.sort(exact, axis=1)
    bounds = top[:, -20], top[:, -3]
    bits = negatives.slice_bits(b, negatives.planes_of(b)), negatives.slice_bits(a, negatives.planes_of(a))
    x, y, score = negatives.survivors(*bits, None, 0, None, bounds)
    assert np.array_equal(score, exact[x, y]) and {*zip(x, y)} == {*zip(*np.nonzero((exact >= bounds[0][:, None]) & (exact <= bounds[1][:, None])))}
    low, high = negatives.reach(bits[1])
    assert np.array_equal(low, np.minimum(a, 0).sum(1)) and np.array_equal(high, np.maximum(a, 0).sum(1))
    # a plane at a time: with k planes left, each score lies in its interval
    total = np.zeros(exact.shape, np.int64)
    weights, more = negatives._weights(len(bits[0])), negatives._weights(len(bits[1]))
    for k in range(len(bits[0]) - 1, -1, -1):
        total += negatives._products(bits[0][k][None], bits[1][:, :, None], more) * weights[k]
        rest = (1 << k) - 1
        assert (total + (rest * low)[:, None] <= exact).all() and (exact <= total + (rest * high)[:, None]).all()
    assert np.array_equal(total, exact)
    # the best few of each anchor
    wide = np.full(4, np.iinfo(np.int64).min), np.full(4, np.iinfo(np.int64).max)
    x, y, score = negatives.survivors(*bits, None, 5, None, wide)
    assert all({*np.argsort(-exact[i])[:5]} <= {*y[x == i]} for i in range(4)) and len(x) < 400  # of 2,000


def test_fill_in_middle_is_brute_force(spark):
    rows = [*texts(), "x" * 700_000 + " y" * 50_000, "has <P> inside", "<S>", "a<", "S>b<M", "a😀b😀😀c", "\n\n", "a\r\nb"] * 3
    docs = documents(spark, rows)
    want = []
    for r in docs.collect():
        text, doc_id = r.text or "", "" if r.doc_id is None else str(r.doc_id)
        u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        low, high = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = ("".join(x) for x in (u[:low], u[low:high], u[high:]))
        form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((r.doc_id, len(u), form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(output), sha(text)))
    got = [tuple(r) for r in fillmiddle.digests(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fillmiddle.digests(empty(spark)).count() == 0


@pytest.mark.parametrize(("grammar", "match"), [("LETTER_RUNS", "[A-Za-z]+|[^A-Za-z]"), ("CHARACTERS", r"[\s\S]"), ("LINES", r"[^\n]*\n|[^\n]+"), ("WORDS", r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+")])
def test_boundaries_cut_where_matches_end(spark, grammar, match):
    from pyspark.sql import functions as F

    rows = [t for t in texts() if t is not None] + ["a😀b😀😀", "😀", "𝒜b𝒜", "\nab", "é ábcéd"]
    docs = spark.createDataFrame([(t,) for t in rows], "text string").select("text", fillmiddle.units(F.col("text"), getattr(fillmiddle, grammar)).alias("u"))
    for r in docs.collect():
        assert r.u == re.findall(match, r.text)


def brute_logit(model, text):
    """A text's logits by its words, one subword at a time."""
    def bucket(value):
        return int(value % np.uint64(toxicity.BUCKETS))

    data = toxicity.lowered(np.frombuffer(text.encode(), np.uint8)).tobytes().decode()
    means = []
    for word in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", data):
        raw = np.frombuffer(word.encode(), np.uint8)
        rows = [bucket(toxicity.ragged.mix(toxicity.ragged.span_hashes(raw, np.array([0]), np.array([len(raw)])))[0])]
        letters = [int.from_bytes(c.encode(), "little") for c in f"<{word}>"]
        for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
            for i in range(len(letters) - n + 1):
                code = np.zeros(1, np.uint64)
                for k in range(n):
                    code = toxicity.ragged.mix(code + np.uint64(letters[i + k]) + np.uint64(k + 1))
                rows.append(bucket(code[0]))
        means.append(model.table[rows].mean(0))
    return (np.mean(means, 0) if means else np.zeros(model.table.shape[1])) @ model.layer + model.bias


def test_toxicity_scores_are_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "AT_ONCE", 50)  # several parts
    rng = np.random.default_rng(5)
    model = toxicity.SubwordModel(rng.normal(0, 1, (toxicity.BUCKETS, 4)), rng.normal(0, 1, (4, 2)), rng.normal(0, 1, 2))
    rows = [t if t is None else t[:4000] for t in texts(n=12)] + ["ÉTÉ Été", "漢字漢字", "a1b2-c3"]
    got = toxicity.scores(pa.array(rows), model.folded())
    for text, score in zip(rows, got):
        z = brute_logit(model, text or "")
        assert math.isclose(score, 1 / (1 + math.exp(-np.clip(z[1] - z[0], -30, 30))), rel_tol=1e-9)


def test_toxicity_gradients_are_differences():
    rng = np.random.default_rng(6)
    words, counts = toxicity.document_words(pa.array(["bad word bad", "good words here", None, "a bad one"]))
    b = toxicity.bags(words, counts, np.array([1, 0, 0, 1]))
    assert np.allclose([b.weight[s:e].sum() for s, e in zip(b.edges[:-1], b.edges[1:])], [1, 1, 0, 1])
    often = np.unique(b.bucket)[::2]
    place = np.full(toxicity.BUCKETS, -1)
    place[often] = np.arange(len(often))
    rows = toxicity.replace(b, bucket=place[b.bucket])
    parts = {"table": rng.normal(0, 1, (len(often), 3)), "layer": rng.normal(0, 1, (3, 2)), "bias": rng.normal(0, 1, 2)}
    scale, chosen, weight = rng.random(len(often)) + 0.5, np.array([3, 0, 1, 2]), np.array([1.0, 2.0, 0.5, 1.0])
    _, grad = toxicity.loss_and_gradients(parts, rows, chosen, scale, weight)
    for k, value in parts.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            kept, ends = value[at], []
            for d in (1e-6, -1e-6):
                value[at] = kept + d
                ends.append(toxicity.loss_and_gradients(parts, rows, chosen, scale, weight)[0])
            value[at] = kept
            assert math.isclose(grad[k][at], (ends[0] - ends[1]) / 2e-6, rel_tol=1e-4, abs_tol=1e-8)


def labelled(spark, n=700):
    """Texts of made-up words, of which the bad ones share a stem; half of them are labelled."""
    rng = random.Random(8)
    syllables = ["ka", "lo", "mi", "ten", "ru", "so", "ba", "ne"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        body = [word() for _ in range(rng.randint(20, 90))]
        if toxic:
            for _ in range(4):  # a stem with an ending that differs from text to text
                body[rng.randrange(len(body))] = "grobzil" + word()
        rows.append((i, " ".join(body), "en", "s", 1, 0.5, "x", 1, "b"))
        labels.append((i, None if i % 9 == 0 else toxic, 1))
    from tests.llm.helpers import SCHEMA

    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + labels[:20] + [(None, 1, 1), (10**9, 1, 1)], "doc_id long, toxic int, quality int"), {i: t for i, t, _ in labels}


def test_unseen_words_share_their_ngrams(spark):
    docs, labels, truth = labelled(spark)
    rows = toxicity.toxicity_scores(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 700 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [r.predicted == truth[r.doc_id] for r in held if truth[r.doc_id] is not None]
    assert len(right) > 100 and sum(right) >= 0.97 * len(right)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs.repartition(7), labels.repartition(5)).collect()}
    assert all(math.isclose(again[r.doc_id], r.score, rel_tol=1e-6) for r in rows)  # partitions don't matter
    # held-out labels and other columns don't matter either
    from pyspark.sql import functions as F

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    other = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity_scores(docs.withColumn("lang", F.lit("zz")), other).collect()} == {r.doc_id: r.score for r in rows}


def test_toxicity_of_awkward_tables(spark):
    docs, labels, _ = labelled(spark, 60)
    odd = documents(spark)
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and {r.held_out for r in rows if r.doc_id is None} == {False}
    none = labels.where("1 = 0")
    assert {r.score for r in toxicity.toxicity_scores(odd, none).collect()} == {0.5}
    assert toxicity.toxicity_scores(empty(spark), labels).count() == 0
    alike = toxicity.toxicity_scores(docs, labels.where("toxic = 0")).collect()
    assert len({r.score for r in alike}) == 1 and alike[0].predicted == 0
