"""Quality rules: base counts and Kneser-Ney against plain versions, bands on made-up languages."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmesh.llm import quality

from .test_text_operators import ODD, frame


def counted(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = {}
    for j in range(len(ws) - 2):
        windows.setdefault(tuple(ws[j : j + 3]), []).append(j)
    twice = {j + d for v in windows.values() if len(v) > 1 for j in v for d in range(3)}
    seen, dups = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(twice)


def model_words(t):
    return [w for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") if re.search(r"[0-9A-Za-z]|[^\x00-\x7f]", w)]


def plain_model(texts):
    """Interpolated modified Kneser-Ney of order two, with dictionaries."""
    pairs = Counter(p for t in texts for p in zip(["<s>", *model_words(t)], model_words(t), strict=False))
    before = Counter(b for _, b in pairs)

    def discounts(counts):
        n1, n2, n3, n4 = (max(sum(c == i for c in counts.values()), 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return [0.0, *(min(max(x, lo), hi) for x, lo, hi in zip(raw, (0.05, 0.1, 0.15), (0.95, 1.9, 2.85), strict=True))]

    d1, d2, total = discounts(before), discounts(pairs), sum(before.values())
    spare1 = sum(d1[min(c, 3)] for c in before.values())
    after, spare2 = Counter(), defaultdict(float)
    for (a, _), c in pairs.items():
        after[a] += c
        spare2[a] += d2[min(c, 3)]

    def low(b):
        return 1.0 if not total else (before[b] - d1[min(before[b], 3)] + spare1 / (len(before) + 1)) / total

    def high(a, b):
        return low(b) if not after[a] else (pairs[a, b] - d2[min(pairs[a, b], 3)] + spare2[a] * low(b)) / after[a]

    return low, high


def made_up(rng, letters, n):
    words = ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randint(60, 300))) for _ in range(n)]


@pytest.mark.parametrize("block,span", [(quality.BLOCK, quality.RANGE), (3000, 7000)])
def test_perplexity(spark, monkeypatch, block, span):
    monkeypatch.setattr(quality, "BLOCK", block)
    monkeypatch.setattr(quality, "RANGE", span)
    monkeypatch.setattr(quality, "EXTRA", 30)
    rng = random.Random(2)
    texts = [*ODD, *made_up(rng, "etaoinshr", 60), "| x1 | y2 ## |"]
    langs = ["en"] * len(texts) + ["ru"] * 40 + [None, "", "one"]
    texts += [*made_up(rng, "оеаинтс", 40), "no language here", "none here either", "alone in its language"]
    docs = frame(spark, texts, lang=langs, row=["r"] * len(texts), k=["k"] * len(texts), range=["x"] * len(texts)).repartition(3)
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    assert len(got) == len(texts)
    for k in {x or "" for x in langs}:
        its = [i for i, x in enumerate(langs) if (x or "") == k]
        models = [plain_model([texts[i] for i in its if got[i].half == f]) for f in (0, 1)]
        for i in its:
            r, ws = got[i], model_words(texts[i])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(texts[i]) and r.k == k
            low, high = models[1 - r.half]
            if not ws:
                assert r.log_perplexity is None and r.log_perplexity_1 is None
            else:
                assert math.isclose(r.log_perplexity_1, -sum(math.log(low(b)) for b in ws) / len(ws), rel_tol=1e-6, abs_tol=1e-9)
                assert math.isclose(r.log_perplexity, -sum(math.log(high(a, b)) for a, b in zip(["<s>", *ws], ws, strict=False)) / len(ws), rel_tol=1e-6, abs_tol=1e-9)


@pytest.mark.parametrize("letters,junk", [("etaoinshrdlu", "zqxjvkwyf"), ("оеаинтсрвлкм", "щъыэюяфхцчшж"), ("的一是不了人我在有他这", "龘靐齉爩鱻麤龗灪吁籲癵")])
def test_bands(spark, letters, junk):
    rng = random.Random(3)
    good = made_up(rng, letters, 300)
    # a third of the rows are copies; near copies change a word; all are kept
    copies = [good[0]] * 120 + [good[1] + f" q{i}" for i in range(40)]
    bad = [" ".join("".join(rng.choices(junk, k=6)) for _ in range(150)) for _ in range(4)]
    texts = good + copies + bad + ["a b c a b c d # |", *ODD]
    docs = frame(spark, texts, lang=["xx"] * len(texts), k=["1"] * len(texts), kept=["2"] * len(texts))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    fine = len(good) + len(copies)
    assert set(range(fine)) - set(ids) <= {i for i in range(fine) if counted(texts[i])[0] < 50 or 2 * counted(texts[i])[4] > counted(texts[i])[0]}
    assert not set(ids) & set(range(fine, fine + len(bad) + 1)) and len(ids) == len(set(ids))


def test_repeats_and_empty(spark):
    rng = random.Random(5)
    good = made_up(rng, "etaoinshrdlu", 80)
    docs = frame(spark, good + good[:3], [*range(80), 0, 1, 2], lang=["en"] * 83)
    got = quality.judge(docs).collect()
    assert len(got) == 83 and len({(r.doc_id, r.log_perplexity, r.kept) for r in got}) == 80
    none = frame(spark, [], lang=[])
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (None, good[0], None)], "doc_id long, text string, lang string")
    assert sorted(r.base_failed for r in quality.judge(nulls).collect()) == [counted(good[0])[0] < 50, True]


def test_squeeze():
    rng = np.random.default_rng(0)
    arrays = [rng.integers(0, 2**63, 1000, dtype=np.uint64) * 2 + 1, np.zeros(5, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.arange(300, dtype=np.uint64)]
    assert all((a == b).all() for a, b in zip(arrays, quality.unsqueeze(quality.squeeze(*arrays)), strict=True))


def test_labelled(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op4_quality_rules(spark, sf).collect() if labels.get(r.doc_id) is not None and not r.base_failed]
    bad, good = ([r.kept for r in rows if labels[r.doc_id] == q] for q in (0, 1))
    assert sum(bad) <= 0.2 * len(bad) and sum(good) >= 0.99 * len(good)
