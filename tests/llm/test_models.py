import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagweave.llm import langid, queries, quality, ragged

from .helpers import SCHEMA, documents, empty, texts

SYLLABLES = {"aa": ["tion", "the", "ing", "and", "er"], "bb": ["ung", "sch", "der", "ich", "en"], "cc": ["eau", "les", "oi", "que", "é"]}


def invented(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def labelled(spark, n=240, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang, good = rng.choice([*SYLLABLES]), rng.random() < 0.7
        text = invented(lang, rng, rng.randint(20, 150))
        if not good:
            text = " ".join(w + rng.choice(["$$$", "***", "&&&"]) for w in text.split()) if i % 2 else (text.split()[0] + " ") * 60
        rows.append((i, text, lang, "s", len(text), 0.1, "ids", 3, "b"))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: (r[2], q[1]) for r, q in zip(rows, labels)}


def test_quality_is_learned(spark):
    docs, labels, truth = labelled(spark)
    rows = quality.quality_scores(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 20
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_takes_awkward_rows(spark):
    docs, labels, _ = labelled(spark, 40)
    odd = documents(spark)
    model = quality.learn(docs, labels)
    assert quality.score_documents(odd, model, ["doc_id"]).count() == odd.count()
    assert quality.keep_good(odd, model).columns == odd.columns
    rows = quality.quality_scores(odd, labels.limit(0)).collect()  # no label: nothing learned
    assert {r.score for r in rows} == {0.5}
    assert quality.quality_scores(empty(spark), labels).count() == 0
    only = labels.withColumn("quality", labels["quality"] * 0 + 1)
    assert all(r.score > 0.5 for r in quality.quality_scores(docs, only).collect())
    nulls = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int"))
    assert quality.quality_scores(docs, nulls).count() == docs.count()


def test_quality_gradient():
    rng = np.random.default_rng(0)
    x, edges = rng.normal(size=(12, 5)), np.array([0, 1, 4, 9, 12])
    y = np.array([1.0, 0, 1, 0])
    model = quality.fit(x, edges, y, hidden=4, steps=400, rate=0.05)
    assert np.abs(model.score(x, edges) - y).max() < 0.2


def test_attention_is_brute_force():
    """Scores by plain loops over passages, and the fitted model's gradient by differences."""
    rng = np.random.default_rng(1)
    x, edges, y = rng.normal(size=(9, 3)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    model = quality.fit(x, edges, y, hidden=4, steps=3)

    def scores(p):
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            h = [np.tanh(np.clip((v - model.mean) / model.scale, -5, 5) @ p["W"] + p["b"]) for v in x[a:b]]
            raw = [sum(np.tanh(u @ p["V"])[k] / (1 + np.exp(-(u @ p["U"])[k])) * p["w"][k] for k in range(4)) for u in h]
            weight = np.exp(raw) / np.exp(raw).sum()
            out.append(1 / (1 + np.exp(-(sum(w * u for w, u in zip(weight, h)) @ p["c"] + p["d"]))))
        return np.array(out)

    assert np.allclose(model.score(x, edges), scores(model.parts))
    loss = lambda p: -np.mean(y * np.log(scores(p)) + (1 - y) * np.log(1 - scores(p)))
    # the first step of Adam moves each part by the rate against its gradient's sign
    before, after = quality.fit(x, edges, y, hidden=4, steps=0, decay=0.0).parts, quality.fit(x, edges, y, hidden=4, steps=1, decay=0.0, rate=1e-3).parts
    for name, value in before.items():
        for at in np.ndindex(value.shape):
            moved = {k: v.copy() for k, v in before.items()}
            moved[name][at] += 1e-5
            slope = (loss(moved) - loss(before)) / 1e-5
            assert abs(slope) < 1e-4 or np.sign(after[name][at] - value[at]) == -np.sign(slope)


def test_bounds_on_samples(spark):
    docs, labels, _ = labelled(spark, 120)
    rows, languages = langid.training_rows(docs, sample=7)
    assert languages == sorted(SYLLABLES) and {r["count"] for r in rows.groupBy("lang").count().collect()} == {7}
    assert {r.text for r in rows.collect()} <= {r.text for r in docs.collect()}
    # rows of one id, however many, change nothing
    often = docs.crossJoin(spark.range(40).select())
    drawn = lambda d: sorted((r.doc_id, r.lang, r.text) for r in langid.training_rows(d, sample=7)[0].collect())
    assert drawn(often) == drawn(docs) and len(drawn(docs)) == 7 * len(SYLLABLES)
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.training_rows(docs, most_languages=2)
    x, edges, y = quality.sample_features(docs, labels.withColumnRenamed("quality", "label"), sample=11)
    assert len(y) == 11 and len(x) == edges[-1]


def test_language_gradient_is_brute_force(spark):
    """The gradient summed over blocks is that of the log-likelihood, by differences."""
    docs, _, _ = labelled(spark, 30)
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()]
    rng, k = np.random.default_rng(2), 3
    weights, moves = rng.normal(0, 0.3, (1 << langid.TABLE_BITS, k)), rng.normal(0, 0.5, (k, k))
    buf, offsets = ragged.pack_bytes([r[2].encode() for r in rows])
    block = langid.Block.of_texts(buf, offsets, np.array([sorted(SYLLABLES).index(r[1]) for r in rows]))
    block.gold = rng.integers(0, k, len(block.words))
    (same,) = langid.Block.read(block.row())
    assert all(np.array_equal(a, b) for a, b in zip(vars(same).values(), vars(block).values()))

    def likelihood(w, m):
        s, total = block.scores(w), 0.0
        for a, b in zip(block.first[:-1], block.first[1:]):
            path = block.gold[a:b]
            alpha = s[a] + np.log(np.exp(m).sum(0))  # the label before the first word is free
            score = s[a, path[0]] + np.log(np.exp(m).sum(0))[path[0]]
            for i in range(a + 1, b):
                alpha = np.log(np.exp(alpha[:, None] + m).sum(0)) + s[i]
                score += m[path[i - a - 1], path[i - a]] + s[i, path[i - a]]
            total += score - np.log(np.exp(alpha).sum())
        return total

    p, expected = langid.posteriors(block.scores(weights), block.first, moves)
    one_hot = np.eye(k)[block.gold]
    gradient = block.gradient(one_hot - p)
    base = likelihood(weights, moves)
    for slot in rng.choice(block.slot, 8):
        for j in range(k):
            moved = weights.copy()
            moved[slot, j] += 1e-4
            assert abs((likelihood(moved, moves) - base) / 1e-4 - gradient[slot, j]) < 0.02


def test_forward_backward_is_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 3)
    rng, k = np.random.default_rng(0), 3
    moves, first, scores = rng.normal(size=(k, k)), np.array([0, 0, 4, 5, 12]), rng.normal(size=(12, k)) * 2
    got, moved = langid.posteriors(scores, first, moves)
    want, pairs = np.zeros_like(scores), np.zeros((k, k))
    start = np.log(np.exp(moves).sum(0))
    for a, b in zip(first[:-1], first[1:]):
        total, g, m = 0.0, np.zeros((b - a, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(b - a)) if b > a else ():
            w = np.exp(start[path[0]] + sum(scores[a + i, p] for i, p in enumerate(path)) + sum(moves[p, q] for p, q in zip(path, path[1:])))
            total += w
            for i, p in enumerate(path):
                g[i, p] += w
            for p, q in zip(path, path[1:]):
                m[p, q] += w
        if b > a:
            want[a:b], pairs = g / total, pairs + m / total
    assert np.allclose(got, want) and np.allclose(moved, pairs)


def test_languages_are_learned(spark):
    docs, _, truth = labelled(spark)
    rows = langid.document_languages(docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(held) > 30
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.95


def test_words_of_switched_text(spark):
    docs, _, _ = labelled(spark)
    rng, model = random.Random(9), langid.learn(docs)
    text = invented("aa", rng, 30) + " " + invented("bb", rng, 90)
    (lang,), (share,) = model.predict(pa.array([text]))
    assert lang == "bb" and abs(share - 0.75) < 0.1


def test_unlearned_languages_go(spark):
    """Other scripts and noise go though some label always has the largest share; clean texts stay."""
    docs, _, _ = labelled(spark, 240)
    clean = docs.where("text not like '%$$$%' and text not like '%***%' and text not like '%&&&%'")
    model, rng = langid.learn(docs), random.Random(4)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(20)] + ["\u044d\u0442\u043e \u043e\u0447\u0435\u043d\u044c \u0445\u043e\u0440\u043e\u0448\u0438\u0439 " * 9, "0Zq9 XkW7 QQx8 " * 30]
    rows = documents(spark, noise).where("doc_id is not null").dropDuplicates(["doc_id"])
    assert langid.keep_identified(rows, model).count() == 0
    assert min(model.predict(pa.array(noise))[1]) >= 1 / 3
    assert langid.keep_identified(clean, model).count() == clean.count()


def _peak(function):
    tracemalloc.start()
    function()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_scoring_takes_bounded_memory():
    """Features of many different words, and of one long word, are made some at a time."""
    rng, k = np.random.default_rng(3), 3
    model = langid.ChainModel(list("abc"), rng.normal(0, 0.3, (1 << langid.TABLE_BITS, k)).astype(np.float32), np.eye(k))
    spread = " ".join("".join(map(chr, rng.integers(97, 123, 20))) for _ in range(50_000))
    for text in (spread, spread.replace(" ", "")):
        assert _peak(lambda: model.judge(pa.array([text]))) < 50 * len(text)
    buf, offsets = ragged.pack_bytes([spread.encode()])
    block = langid.Block.of_texts(buf, offsets, np.zeros(1, np.int64))
    assert block.row().nbytes < 1.1 * 4 * sum(len(x) for x in vars(block).values())


def test_slices_of_stages_are_bounded(spark, monkeypatch):
    """What a stage handles at once is bounded by its slice and not by the batch; rows stay the same."""
    docs, labels, _ = labelled(spark, 60)
    good, chain = quality.learn(docs, labels), langid.learn(docs)
    ids = lambda d: sorted(r.doc_id for r in d.collect())
    want = ids(quality.keep_good(docs, good)), ids(langid.keep_identified(docs, chain))
    monkeypatch.setattr(ragged, "SMALL_SLICE_BYTES", 1000)
    monkeypatch.setattr(langid, "SLICE_BYTES", 1000)
    assert (ids(quality.keep_good(docs, good)), ids(langid.keep_identified(docs, chain))) == want and want[0] and want[1]


@pytest.mark.parametrize("at_once", [1, 7, 50])
def test_words_scored_in_parts(monkeypatch, at_once):
    """Parts of any size give the scores of all features at once, and letters are those of characters."""
    rows = pa.array([*texts(3, 20), "", None, "12 34", "\u6f22\u5b57 12", "---"], pa.string())
    rng, k = np.random.default_rng(4), 3
    model = langid.ChainModel(list("abc"), rng.normal(0, 0.3, (1 << langid.TABLE_BITS, k)), rng.normal(size=(k, k)))
    buf, offsets = ragged.text_bytes(rows)
    starts, ends = langid.cores(buf, *ragged.words(buf, offsets)[:2])
    whole, judged = langid.emissions(model.weights, langid.word_entries(buf, starts, ends), len(starts)), model.judge(rows)
    monkeypatch.setattr(langid, "AT_ONCE", at_once)
    monkeypatch.setattr(langid, "CELLS_AT_ONCE", at_once)
    assert all(np.array_equal(a, b) for a, b in zip(langid.cores(buf, starts, ends), (starts, ends)))
    assert np.allclose(langid.span_scores(model.weights, buf, starts, ends), whole)
    again = model.judge(rows)
    assert again[0] == judged[0] and all(np.allclose(a, b) for a, b in zip(again[1:], judged[1:]))
    assert langid.with_letter(buf, offsets).tolist() == [any(c.isalpha() for c in t or "") for t in rows.to_pylist()]


def test_languages_of_awkward_rows(spark):
    docs, _, _ = labelled(spark, 60)
    model, odd = langid.learn(docs), documents(spark)
    rows = {r.doc_id: r for r in langid.label_documents(odd, model, ["doc_id"]).collect()}
    for i, t in enumerate(texts()):
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), repr(t)
        assert 0 <= rows[i].score <= 1
    assert langid.keep_identified(odd, model).columns == odd.columns
    assert langid.document_languages(empty(spark)).count() == 0
    unknown = langid.document_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_queries_and_stages():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == [*range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5 and {*queries.oracle_sql()} <= {*queries.queries()}


@pytest.mark.parametrize("make", ["documents", "empty"])
def test_pipeline_takes_awkward_rows(spark, tmp_path, make):
    good, labels, _ = labelled(spark, 120)
    docs = good.unionByName(documents(spark)) if make == "documents" else empty(spark)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
    assert (at.count() > 50) == (make == "documents")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()
