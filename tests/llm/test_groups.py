import re

import duckdb
import numpy as np

import pytest
import xxhash

from lagweave.llm import chat, components, ragged, sharding, simhash

from .helpers import WORD, documents, empty, texts


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def grouped(prints, radius=3):
    parent = [*range(len(prints))]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_fingerprints_and_components_are_brute_force(spark):
    rows = texts()
    base = " ".join(f"word{i}" for i in range(300))
    rows += [base, base.replace("word7 ", "other "), base + " tail", base.upper(), *["exact copy of a text"] * 30]
    docs = documents(spark, rows)
    given = [r for r in docs.collect()]
    prints = [fingerprint(r.text) for r in given]
    roots, least = grouped(prints), {}
    for r, x in zip(given, roots):
        if r.doc_id is not None:
            least[x] = min(least.get(x, 1 << 60), r.doc_id)
    want = sorted((str(r.doc_id), f"{p:016x}", least.get(x)) for r, p, x in zip(given, prints, roots))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def family(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    near = [base[:60] ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, d, replace=False))) for d in range(1, 6)]
    return np.unique(np.concatenate([base, *near]))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_close_pairs_are_brute_force(radius):
    prints = family()
    want = {(i, j) for i in range(len(prints)) for j in range(len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= radius}
    assert {(int(i), int(j)) for a, b in simhash.close_pairs(prints, prints, radius) for i, j in zip(a, b)} == want


@pytest.mark.parametrize("bucket, tile", [(4096, 16384), (1, 16384), (400, 20)])
def test_links_keep_components_for_any_bucket_and_tile(spark, bucket, tile):
    prints = family(3)
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(frame, 3, bucket, tile).collect()
    roots = grouped([int(x) for x in prints])
    at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    assert all(roots[at[r.a]] == roots[at[r.b]] for r in links)
    found = {r.node: r.root for r in components.components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).collect()}
    classes = {}
    for x, i in at.items():
        classes.setdefault(found.get(x, x), set()).add(roots[i])
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len({*roots})


def test_deep_keys_share_a_block():
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark, rng = SparkSession.getActiveSession(), np.random.default_rng(5)
    a = rng.integers(0, 2**64, 100, dtype=np.uint64)
    b = np.array([x ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, 3, replace=False))) for x in a])
    rows = [(int(x), int(y)) for x, y in zip(a.view(np.int64), b.view(np.int64))]
    for bits in (0, 7, 16, 20, 28):
        frame = spark.createDataFrame(rows, "a long, b long").select(F.array(*simhash.bucket_keys(F.col("a"), 3, bits)).alias("a"), F.array(*simhash.bucket_keys(F.col("b"), 3, bits)).alias("b"))
        assert all(any(x == y for x, y in zip(r.a, r.b)) for r in frame.collect())


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert components.components(links.limit(0)).count() == 0


def talk(*conversations):
    return [(c, t, "user" if t % 2 == 0 else "assistant", x, "extra") for c, turns in conversations for t, x in enumerate(turns)]


def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    long = [f"turn {i}" for i in range(11)]
    rows = talk((1, long[:3]), (2, long), (3, long[:9]), (4, long[:3] + ["else"]), (5, ["turn 0"]), (6, ["alone"]), (7, ["alone"]), (8, [None]), (9, long))
    rows += [rows[0], rows[0], (None, 0, "user", "lost", "e"), (10, None, None, "no turn", "e"), (10, 1, "user", "then", "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, position string").repartition(3)
    out = chat.format_conversations(turns).collect()
    assert {(r.conv_id, r.n_turns, r.n_collapsed) for r in out} == {(2, 11, 1), (4, 4, 0), (6, 1, 1), (8, 1, 0), (10, 2, 0)}
    joined = {c: "".join(r.rendered for r in sorted((r for r in out if r.conv_id == c), key=lambda r: r.part)) for c in (2, 10)}
    assert joined[2].count(chat.OPEN) == 11 and joined[2].index("turn 2\x3c") < joined[2].index("turn 10")
    assert joined[10].startswith(chat.OPEN + "\nno turn")
    con = duckdb.connect()
    con.register("conversations", turns.toPandas())
    con.execute("create view v as select * from conversations")
    want = sorted(con.sql(chat.ORACLE_SQL.replace("// 512", "// 4")).fetchall())
    assert sorted((r.conv_id, r.part, r.n_turns, r.n_collapsed, r.rendered) for r in out) == want
    assert chat.format_conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("first_bits", [None, 1])
@pytest.mark.parametrize("limit", [3000, 20000, 10**9])
def test_shards_are_the_oracles(spark, limit, first_bits):
    docs = documents(spark)
    got = sorted((str(r.doc_id), r.bytes, r.shard, r.depth, r.shard_bytes, r.shard_rows, r.oversized) for r in sharding.shards(docs, limit, first_bits=first_bits).collect())
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    rows = con.sql("select * from (" + sharding.oracle_sql(limit) + ")").fetchall()
    want = sorted((str(r[0]), *r[1:]) for r in rows)
    assert got == want
    assert all(not r[6] or r[5] >= 1 for r in got)
    assert sharding.shards(empty(spark), limit).count() == 0


def test_rows_of_one_id_are_spread(spark):
    rows = [(key, f"text {i} " * 20) for i in range(200) for key in (None, 7)]
    out = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 3000).collect()
    assert not any(r.oversized for r in out) and max(r.shard_bytes for r in out) <= 3000


def test_word_spans():
    buf, offsets = ragged.pack_bytes([b"a b", b"", b"c", b" \x0bd\x1c "])
    starts, ends, first = ragged.words(buf, offsets)
    assert [bytes(buf[a:b]) for a, b in zip(starts, ends)] == [b"a", b"b", b"c", b"d\x1c"] and first.tolist() == [0, 2, 2, 3, 4]
