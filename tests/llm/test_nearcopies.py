import random
import re

import numpy as np
import pytest

from lagweave.llm import nearcopies

from .helpers import WORD, documents, empty


def test_keep_one_of_each_group(spark):
    rows = ["one two three four five"] * 3 + ["other words in another text", None, "", "x y z"]
    docs = documents(spark, rows)
    kept = nearcopies.keep_one_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect())
    assert got == [(0, rows[0]), (3, rows[3]), (4, None), (6, "x y z")] and kept.where("doc_id is null").count() == 1
    assert nearcopies.keep_one_each(empty(spark)).count() == 0


def shingled(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def copies(seed=4):
    """Texts of 3 to 400 words, each with copies that keep more or less of it, and one that many copies were made from."""
    rng = random.Random(seed)
    out = []
    for k in range(40):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(3, 400))]
        out.append(" ".join(words))
        for share in (0.005, 0.02, 0.04, 0.08) * (8 if k == 0 else 1):
            out.append(" ".join("other" + str(rng.random()) if rng.random() < share else w for w in words))
        out.append(" ".join(words + ["tail"]).upper())
    return [*out, None, "", "a b c d", "A b  c\td", "same same " * 9, "same same " * 20]


def alike(sets, least=0.8):
    return {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


def classes(n, pairs):
    parent = [*range(n)]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]



@pytest.mark.parametrize("tile, part_bytes", [(nearcopies.TILE, nearcopies.PART_BYTES), (2, 3000)])
def test_near_copies_are_brute_force(spark, tile, part_bytes):
    """Whole groups, and groups in many tiles and parts, some of one set."""
    rows = copies()
    want = classes(len(rows), alike([shingled(x) for x in rows]))
    docs = documents(spark, rows).where("doc_id is not null")
    kept = [r.doc_id for r in nearcopies.keep_one_each(docs, tile=tile, part_bytes=part_bytes).collect()]
    assert sorted(kept) == sorted({*want})
    assert 40 < len(kept) < len(rows) - 40


def test_short_texts_and_chains_are_brute_force(spark):
    """Pairs right at the limit: sets of 4 to 40 shingles of which one is missing, and texts that are alike only to the next one."""
    rng = random.Random(8)
    rows = []
    for n in range(8, 44):
        words = [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
        rows += [" ".join(words[:i]) for i in range(5, n + 1, rng.randint(1, 3))]
    chain = [f"c{i}" for i in range(300)]
    rows += [" ".join(chain[i : i + 60]) for i in range(0, 240, 5)]
    passage = " ".join(f"p{i}" for i in range(80))
    rows += [" ".join(f"x{rng.randint(0, 10**6)}" for _ in range(40)) + " " + passage for _ in range(60)]
    want = classes(len(rows), alike([shingled(x) for x in rows]))
    for options in ({}, {"tile": 4, "part_bytes": 3000}):
        kept = [r.doc_id for r in nearcopies.keep_one_each(documents(spark, rows).where("doc_id is not null"), **options).collect()]
        assert sorted(kept) == sorted({*want})


def test_alike_sets_share_a_prefix_and_radius():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 3, (nearcopies.COUNT_ROWS, 1 << nearcopies.CELL_BITS)).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(4, 200))
        base = rng.integers(0, 2**63, n + n // 4, dtype=np.uint64)
        lost = int(rng.integers(0, n // 9 + 1))
        a, b = np.sort(base[:n]), np.sort(base[lost : n + (n // 4 if not lost else 0)])
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        flat, edges = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        prefix, at = nearcopies.prefixes(flat, edges, common, 0.8)
        assert {*prefix[: at[1]].tolist()} & {*prefix[at[1] :].tolist()}
        x, y = nearcopies.fingerprints(flat, edges)
        assert np.bitwise_count(x ^ y).sum(dtype=int) <= (nearcopies.RADIUS if min(len(a), len(b)) < nearcopies.SMALL_SET else nearcopies.LARGE_RADIUS)


def test_wide_pairs_are_brute_force():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, (70, nearcopies.WIDE), dtype=np.uint64)
    flips = (rng.random((700, 64 * nearcopies.WIDE)) < rng.choice([0.02, 0.3, 0.36], (700, 1))).astype(np.uint8)
    prints = np.concatenate([base, base[rng.integers(0, 70, 700)] ^ np.packbits(flips, axis=1, bitorder="little").view("<u8")])
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2, dtype=int)
    near = {(i, j) for i, j in zip(*np.nonzero(far <= nearcopies.RADIUS))}
    cuts = np.array([0, 1, 3, 70, 130, 131, 500, 770])
    high = np.repeat(cuts[1:], np.diff(cuts))
    got = [(int(i), int(j)) for a, b in nearcopies.pairs(prints, np.arange(770) + 1, high) for i, j in zip(a, b)]
    assert sorted(got) == sorted((i, j) for i, j in near if i < j < high[i]) and len(got) > 200
    queries = np.array([5, 700, 100])
    got = {(int(i), int(j)) for a, b in nearcopies.pairs(prints, np.array([0, 64, 300]), np.array([770, 65, 300]), queries) for i, j in zip(a, b)}
    assert got == {(i, j) for i, j in near if i == 5 or (i, j) == (700, 64)}


def test_resolve_finds_all_classes():
    rng = np.random.default_rng(4)
    n = 90
    linked = rng.random((n, n)) < 0.012
    linked |= linked.T
    seen = np.zeros((n, n), int)

    def links(picked, rest, label):
        seen[np.ix_(picked, rest)] += 1
        i, j = np.nonzero(linked[np.ix_(picked, rest)])
        return picked[i], rest[j]

    assert nearcopies.resolve(n, links).tolist() == classes(n, [(i, j) for i, j in zip(*np.nonzero(linked)) if i > j])
    side = rng.random(n) < 0.3

    def across(picked, rest, label):
        i, j = links(picked, rest, label)
        return i[side[i] != side[j]], j[side[i] != side[j]]

    assert nearcopies.resolve(n, across, side=side).tolist() == classes(n, [(i, j) for i, j in zip(*np.nonzero(linked)) if i > j and side[i] != side[j]])
    seen[:] = 0
    linked[:] = True
    nearcopies.resolve(n, links)
    assert seen.sum() == n  # copies of one text: one comparison each


def test_near_copies_with_clashing_columns_and_long_texts(spark):
    """Names that the steps use themselves, names with dots, and a text of some megabytes beside its near copy."""
    rng = random.Random(2)
    long = [f"w{rng.randint(0, 10**5)}" for _ in range(500_000)]
    rows = [" ".join(long), " ".join(long[:-9] + ["end"]), "short text of five words", "short text of five words", None]
    names = ["_id", "a.b", "root", "key", "sid", "fp", "shingles", "c0", "least_id", "repeated", "n"]
    data = [(i, x, *range(len(names))) for i, x in enumerate(rows)] + [(4, None, *range(len(names)))]
    docs = spark.createDataFrame(data, ["doc_id", "text", *names])
    out = nearcopies.keep_one_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 4]
    assert out.where("doc_id = 0").first()["a.b"] == 1
