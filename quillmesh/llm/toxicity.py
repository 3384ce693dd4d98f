"""Toxicity: a weighted lexicon found by an Aho-Corasick automaton in folded text, normalised by length, with exception phrases.

Text is folded: compatibility forms and accents removed, homoglyphs of Latin letters and digit substitutions inside words mapped back.
A term counts at word boundaries of the folded text, unless an exception phrase covers it. The lexicon starts from SEED and learns more
terms, words of at least three characters, and all weights, as logarithms of odds, from at most SAMPLE labelled rows that aren't held out
(those with the least hashes of doc_id); a label above 0 is toxic. Two features (total weight, and weight for 100 words, both as log1p) give the score by a logistic curve fitted on the same rows.

Null text is empty and scores what a text without terms does. A null doc_id hashes as the empty text. Without labels the seed weights and a
fixed curve serve. Rows of repeated ids are scored each; of an id's several labels the highest counts. An empty table gives no rows. A very
long text is folded and matched whole. Labels, language, source and doc_id are no inputs of a score. Other columns are ignored by score() and
kept by keep_clean(), whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import begin, pieces, ship, strings, table

#: At most so many labelled rows teach.
SAMPLE = 20_000
SEED = {"idiot": 3, "idiots": 3, "moron": 3, "morons": 3, "stupid": 2.5, "scum": 3, "trash": 2, "loser": 2.5, "losers": 2.5, "pathetic": 2.5, "worthless": 2.5, "disgusting": 2.5, "clown": 2, "imbecile": 3, "dumbass": 3.5, "bastard": 3, "bitch": 3.5, "asshole": 3.5, "retard": 3.5, "vermin": 2.5, "subhuman": 3.5}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "white trash bag", "sore loser", "disgusting smell")
_GLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ⅼ": "l", "α": "a", "ο": "o", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "κ": "k", "ı": "i", "ł": "l", "ø": "o", "​": "", "‌": "", "‍": "", "­": "", "⁠": ""}
_MAP = str.maketrans(_GLYPHS | {c.upper(): g for c, g in _GLYPHS.items() if c.upper() != c and len(c.upper()) == 1})
_DIGIT = str.maketrans("013457@$!|", "oieastasil")
_MIXED = re.compile(r"[a-z]+[013457@$!|][a-z013457@$!|]*[a-z]|[013457@$!|]+[a-z][a-z013457@$!|]*[a-z]")
_RAW_DIGITS = re.compile("[013457@$!|]")


def fold(text: str) -> str:
    """Lower-cased ASCII-like text: accents, homoglyphs and digits inside words mapped to letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_MAP))
        text = "".join(c for c in text if not "̀" <= c <= "ͯ")
    text = text.lower()
    if _RAW_DIGITS.search(text):
        text = _MIXED.sub(lambda m: m.group().translate(_DIGIT), text)
    return text


_WORD = re.compile(r"[^\W_]+")


def automaton(lexicon: dict[str, float]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in EXCEPTIONS:
        a.add_word(p, (p, None))
    for t, w in lexicon.items():
        a.add_word(t, (t, w))
    a.make_automaton()
    return a


def measure(a, text: str) -> tuple[float, float]:
    """The two features of a text."""
    text = fold(text)
    found, safe = [], []
    for end, (t, w) in a.iter(text):
        first = end - len(t) + 1
        if first and text[first - 1].isalnum() or end + 1 < len(text) and text[end + 1].isalnum():
            continue
        (safe if w is None else found).append((first, end, w))
    total = sum(w for s, e, w in found if not any(x <= s and e <= y for x, y, _ in safe))
    if not total:
        return 0.0, 0.0
    return log1p(total), log1p(100 * total / (1 + text.count(" ") + text.count("\n")))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> list[float]:
    """Weights of (1, features) by Newton's steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(x.shape[1]) / 100
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) / 100 * w)
    return w.tolist()


def teachers(labels) -> dict[int, int]:
    """At most SAMPLE labelled rows that aren't held out: those with the least hashes of doc_id."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    got = rows.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    return {int(r.doc_id): int(r.toxic) for r in got}


def _taught(docs, known: dict[int, int]):
    rows = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(known.keys(), pa.int64()), "toxic": pa.array(known.values(), pa.int32())}))
    # at most SAMPLE rows of two numbers: a bounded broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")


def fit(docs, labels) -> tuple[dict[str, float], list[float]]:
    """The lexicon and the curve."""
    ship(docs.sparkSession)
    known = teachers(labels)
    if not known:
        return dict(SEED), [-3.0, 2.5, 0.2]

    def count(batches):
        begin("toxicity")
        n: dict[str, list[int]] = {}
        for whole in batches:
            for batch in pieces(whole):
                for t, y in zip(strings(batch), batch.column(batch.schema.get_field_index("toxic")).to_pylist(), strict=True):
                    for w in set(_WORD.findall(fold(t))):
                        n.setdefault(w, [0, 0])[y] += 1
        items = [(w, *c) for w, c in n.items() if len(w) > 2]
        for at in range(0, len(items), 100_000):
            w, a, b = zip(*items[at : at + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["word", "clean", "toxic"])

    bad = sum(known.values())
    good = len(known) - bad
    counts = _taught(docs, known).mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    sure = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    seeds = F.col("word").isin(list(SEED))
    got = counts.where((F.col("toxic") >= 3) | seeds).withColumns({"odds": odds, "sure": sure})
    # a term must be likely, and sure even among the many words that are tried; as many as SAMPLE rows can teach
    learned = got.where(((F.col("sure") >= 4.5) & (F.col("odds") >= 2.0)) | seeds).collect()
    lexicon = dict(SEED)
    for r in learned:
        prior = SEED.get(r.word)
        n = r.toxic + r.clean
        lexicon[r.word] = round(max(0.0, min(8.0, r.odds if prior is None else (4 * prior + n * r.odds) / (4 + n))), 6)

    def points(batches):
        begin("toxicity")
        a = automaton(lexicon)
        for whole in batches:
            for batch in pieces(whole):
                f = [measure(a, t) for t in strings(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("toxic")), pa.array([x for x, _ in f], pa.float64()), pa.array([y for _, y in f], pa.float64())], names=["doc_id", "toxic", "a", "b"])

    # at most SAMPLE rows of four numbers a known document (more only if its id repeats in docs)
    x = _taught(docs, known).mapInArrow(points, "doc_id long, toxic int, a double, b double").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("a").alias("a"), F.max("b").alias("b")).toPandas().sort_values("doc_id")
    if x["toxic"].nunique() < 2:
        return lexicon, [-3.0, 2.5, 0.2]
    return lexicon, logistic(x[["a", "b"]].to_numpy(), x["toxic"].to_numpy().astype(float))


def probability(curve: list[float], f: tuple[float, float]) -> float:
    return 1 / (1 + exp(-max(-30.0, min(30.0, curve[0] + curve[1] * f[0] + curve[2] * f[1]))))


def score(docs, lexicon: dict[str, float], curve: list[float]):
    """held_out, score and predicted of each row of docs(doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches):
        begin("toxicity")
        a = automaton(lexicon)
        for whole in batches:
            for batch in pieces(whole):
                ids = batch.column(0).cast(pa.int64())
                p = [probability(curve, measure(a, t)) for t in strings(batch)]
                held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs, labels):
    """The rows, with all their columns, that aren't predicted toxic."""
    lexicon, curve = fit(docs, labels)

    def run(batches):
        begin("toxicity")
        a = automaton(lexicon)
        for whole in batches:
            for batch in pieces(whole):
                yield batch.filter(pa.array([probability(curve, measure(a, t)) < 0.5 for t in strings(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, table(spark, sf_dir, "labels")))
