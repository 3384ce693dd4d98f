"""Document fingerprints: one-permutation MinHash of word shingles, optimally densified, packed to low-order bits.

A set's shingle hashes are binned once; each bin keeps its smallest; an empty bin copies the first filled bin of its own fixed random
order; BITS low bits of every bin's value, mixed with the bin's number, are packed to hexadecimal. Two fingerprints agree in a bin by
chance once in 2**BITS, for which the likeness is corrected. As the bin's number is mixed in, bins that copied one value clash one by one.
Shingles have K words (fewer words: one shingle), lower-cased A-Z.

Null text is empty. A text without words has the fingerprint "-": like itself (1) and unlike every other (0). The next document is the
next row by doc_id (null first), then text; repeated rows follow each other. A table of one row has itself as the next, an empty one gives
no rows. Very long texts are hashed block by block. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import begin, mix, one_permutation, parts, permutations, pieces, shingles, ship, table

BINS, BITS, K = 256, 4, 5
_ORDER = permutations(BINS, 11)
_BIN = np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fingerprints(texts: list[bytes], k: int = K) -> list[str]:
    v, some = one_permutation(shingles(texts, k), BINS, _ORDER)
    low = (mix(mix(v) + _BIN) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    packed = low[:, 0::2] << 4 | low[:, 1::2]
    return [p.tobytes().hex() if s else "-" for p, s in zip(packed, some, strict=True)]


def likeness(a: str, b: str) -> float:
    """Jaccard similarity estimated from two fingerprints, corrected for bins equal by chance; 0 to 1."""
    if a == b:
        return 1.0
    if a == "-" or b == "-":
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=np.uint8) for s in (a, b))
    d = x ^ y
    same = int(((d >> 4) == 0).sum() + ((d & 15) == 0).sum()) / BINS
    by_chance = 2.0**-BITS
    return max(0.0, (same - by_chance) / (1 - by_chance))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def in_order(docs):
    """docs(doc_id, text) as (doc_id, text, bucket, tail), sorted within ranges of doc_id: one shuffle of the texts.

    Bounds come from approximate quantiles of doc_id; the first row of each range is sent to the range before it too (and the very first
    to the last), as tail = 1, so that every range knows what follows its last row.
    """
    spark = docs.sparkSession
    n = parts(spark)
    least = F.lit(-(2**63))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts or []})
    bucket = F.lit(0)
    if cuts:
        # binary search: how many cuts aren't above doc_id
        at, steps = F.array(*[F.lit(c) for c in cuts]), [1 << i for i in reversed(range(len(cuts).bit_length()))]
        bucket = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda a, s: F.when((a + s <= len(cuts)) & (F.get(at, a + s - 1) <= F.col("doc_id")), a + s).otherwise(a))
    dealt = docs.withColumn("bucket", bucket)
    first = {r.bucket: r.least for r in dealt.groupBy("bucket").agg(F.min(F.coalesce("doc_id", least)).alias("least")).collect()}
    filled = sorted(first)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    extra = dealt.where(F.coalesce("doc_id", least).isin([first[b] for b in filled]))
    back = F.create_map(*[F.lit(x) for b in filled for x in (b, before[b])])[F.col("bucket")] if filled else F.col("bucket")
    # of rows that share the first doc_id only the least text is needed
    extra = extra.groupBy("doc_id", "bucket").agg(F.min("text").alias("text")).select("doc_id", "text", back.alias("bucket"), F.lit(1).alias("tail"))
    both = dealt.select("doc_id", "text", "bucket", F.lit(0).alias("tail")).unionByName(extra)
    return both.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), "text")


def compare(docs):
    """The fingerprints and likenesses of each row of docs(doc_id, text), in one pass over the rows in order."""
    ship(docs.sparkSession)

    def rows_of(done: list[tuple], following: list[tuple]):
        changed = [edited(a[1], b[1]).encode() for a, b in zip(done, following, strict=True)]
        other = fingerprints(changed)
        own = [a[2] for a in done]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a in done], pa.int64()), pa.array([len(a[1]) for a in done], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()), pa.array(own, pa.string()), pa.array(other, pa.string()),
                pa.array(map(likeness, own, other), pa.float64()), pa.array([likeness(a, b[2]) for a, b in zip(own, following, strict=True)], pa.float64()),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )

    def run(batches):
        begin("fingerprints")
        held = None
        for whole in batches:
            for batch in pieces(whole, rows=1000, size=2 << 20):
                ids, texts, bucket, tail = (batch.column(i).to_pylist() for i in range(4))
                rows = list(zip(ids, texts, fingerprints([t.encode() for t in texts]), bucket, tail, strict=True))
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[3] == b[3] and not a[4]]
                if pairs:
                    yield rows_of(*zip(*pairs, strict=True))

    return in_order(docs).mapInArrow(run, SCHEMA)


def op5_fingerprints(spark, sf_dir):
    return compare(table(spark, sf_dir, "documents"))
