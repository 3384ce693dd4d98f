"""Near-duplicate groups against all pairs compared on full sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import near_dups


def sets_of(texts, k):
    out = []
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set())
    return out


def brute(ids, texts, k, percent=80):
    sets, top = sets_of(texts, k), list(range(len(ids)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda x: ids[x])
                top[b] = a
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(ids))}


def changed(rng, words, n):
    ws = list(words)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"q{rng.randrange(10**6)}"
    return ws


def corpus(seed):
    """Chains of near copies (neighbours alike, ends not), exact copies in other case, pairs at the threshold, short and empty texts."""
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [None, "", " \n", "one", "One", "one two three", "ONE two  three", "one two"]
    for size in (40, 120, 700):
        for _ in range(4):
            x = new(size)
            for _ in range(12):
                texts.append(" ".join(x).replace("w1", "W1") if rng.random() < 0.2 else " ".join(x))
                x = changed(rng, x, rng.choice([0, 1, size // 60, size // 40]))
    base = new(904)
    # sets of 901 shingles with 801 shared: 801 / 1001 = 0.80 and just below
    texts += [" ".join(base), " ".join(base[:804] + new(100)), " ".join(base[:803] + new(101))]
    texts += [" ".join(new(60)) for _ in range(30)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 5)])
def test_groups(spark, seed, k):
    texts = corpus(seed)
    rng = random.Random(seed)
    ids = rng.sample(range(10**9), len(texts))
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, rep int, key string, n int").repartition(5)
    got = {r.doc_id: r for r in near_dups.near_groups(docs, k).collect()}
    want = brute(ids, texts, k)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    kept = near_dups.one_of_each(docs, k)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in ids if want[i][1] == i)


def test_blocks(spark, monkeypatch):
    # components of one key are compared in blocks: blocks smaller than the groups lose nothing
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    monkeypatch.setattr(near_dups, "BLOCK_BYTES", 5000)
    texts = corpus(7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_groups(docs, 4).collect()} == brute(list(range(len(texts))), texts, 4)


def test_repeats_and_empty(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in near_dups.near_groups(docs).collect()), key=str)
    assert got == sorted([(False, 5, 3, False)] * 2 + [(True, None, None, True), (False, 3, 3, True)] + [(False, 9, 9, True)] * 2, key=str)
    assert sorted(((r.doc_id, r.text) for r in near_dups.one_of_each(docs).collect()), key=str) == sorted([(None, "a b c d e f"), (3, "A b c d e f"), (9, None)], key=str)
    none = docs.limit(0)
    assert near_dups.near_groups(none).count() == 0 and near_dups.one_of_each(none).count() == 0


def test_components(spark, tmp_path):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)]
    got = {r.v: r.root for r in near_dups.components(spark.createDataFrame(path, "a long, b long"), f"file://{tmp_path}/c").collect()}
    assert {got.get(v, v) for v in range(61)} == {0} and {got.get(v, v) for v in (100, 101, 102)} == {100}


def test_registers_and_estimate():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.8):
        errors = []
        for _ in range(20):
            common, a, b = (np.unique(rng.integers(1, 2**63, n, dtype=np.uint64) * 2 + 1) for n in (int(2000 * share), int(2000 * (1 - share)), int(2000 * (1 - share))))
            x, y = np.unique(np.r_[common, a]), np.unique(np.r_[common, b])
            v, _ = near_dups.one_permutation([x, y], near_dups.REGISTERS, near_dups._ORDER)
            r = near_dups.registers(v)
            errors.append(near_dups.estimate(int((r[0] == r[1]).sum()), 2000) - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        assert abs(np.mean(errors)) < 0.03


def test_links_of_block():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(1, 2**62, 3000, dtype=np.int64))
    sets = [np.unique(np.r_[rng.choice(base, n, replace=False), rng.integers(1, 2**62, m, dtype=np.int64)]) for n, m in ((2900, 10), (2850, 50), (2600, 0), (30, 0), (28, 0), (1500, 1500))] + [base, base[:2400]]
    n = len(sets)
    near = {(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    found = near_dups.links_of_block(np.arange(n), np.arange(n), np.ones(n, dtype=bool), sets, 80)
    assert all((j, i) in near for i, j in found)

    def groups(pairs):
        top = list(range(n))
        for i, j in pairs:
            a, b = top[i], top[j]
            top = [min(a, b) if x in (a, b) else x for x in top]
        return top

    assert groups(found) == groups(near) and len(found) < len(near)


def test_one_template(spark):
    """Texts of one template, about 0.7 alike: no links, and a bound on the rows that the blocks get."""
    rng = random.Random(9)
    frame = [f"t{i}" for i in range(110)]
    texts = [" ".join(frame + [f"u{rng.randrange(10**6)}" for _ in range(22)]) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = near_dups.near_groups(docs, 4).agg(F.count("*"), F.count_if("kept")).first()
    assert tuple(got) == (3000, 3000)


def test_queries_of_each_hundredth(spark):
    """Recall on the driver's documents: every document whose id is divisible by 100 against all others, on full sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    group = {r.doc_id: r.component_id for r in near_dups.near_groups(docs, 4).collect()}
    ids = sorted(texts)
    sets = dict(zip(ids, sets_of([texts[i] for i in ids], 4), strict=True))
    for a in (i for i in ids if i % 100 == 0 and sets[i]):
        for b in ids:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert group[a] == group[b]
