"""Packing along a space-filling curve.

A document's tokens, hashed to random signs, project it to three dimensions; the Hilbert key of that place, then a hash of doc_id, then
doc_id itself order the documents. They are dealt by range to buckets (bounds from a sample of about BOUND_ROWS rows a bucket: they
only balance the buckets and never change the order), sorted, and laid end to end in one pass that also cuts at every multiple of the
sequence length. So neighbours on the curve share sequences, and all sequences but the last of each bucket are full. A bucket has
BUCKET bytes of text at least, so padding is less than a sequence for so much text; a small table is one bucket.

Null text is empty: one token, the end id. Repeated rows are packed once each, equal keys by doc_id, length and tokens. A null doc_id stays
null. A very long text becomes as many pieces as it takes. An empty table gives no rows. Other columns are ignored, whatever their names.
Tokens are moved once, by the shuffle; what the driver gathers is one total for each bucket.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .bpe import _PLAIN
from .common import begin, keep, kept_for, mix, parts, pieces, shared_dir, ship, strings, table

BOUND_ROWS, DIMS, BITS, BUCKET = 40, 3, 10, 4 << 20


def _byte_of() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, the others in turn from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Ids:
    """The ids of the tokenizers library for a JSON file.

    Where the file is a plain byte-level BPE whose merges come in the order of their tokens' ids, merging by rank gives the same ids much
    faster, with no cache. Texts with an added token in them, or with characters for which Unicode versions may differ, go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.fast, self.added = path, None, ()
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.size = max([*data["model"]["vocab"].values(), *(t["id"] for t in data["added_tokens"])]) + 1
        pre, model = data.get("pre_tokenizer") or {}, data["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [model["vocab"].get("".join(m)) for m in merges]
        by_rank = None not in made and made == sorted(set(made))
        plain = not data.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if model.get("type") == "BPE" and plain and by_rank and not model.get("ignore_merges"):
            import public_tokenizers
            import tiktoken

            self.added = tuple(t["content"] for t in data["added_tokens"])
            byte = _byte_of()
            ranks = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if w not in self.added}
            self.fast = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def library(self):
        return _library(self.path)

    def encode(self, text: str) -> list[int]:
        if self.fast and not _PLAIN.search(text) and not any(a in text for a in self.added):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [self.encode(t) for t in texts]


@lru_cache(1)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def worker_ids(path: str) -> Ids:
    return Ids(path)


def _empty() -> None:
    worker_ids.cache_clear()
    _library.cache_clear()


kept_for("packing", _empty)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of points; x: (n, dims) integers below 2**bits. After J. Skilling's transform (2004)."""
    x = x.astype(np.int64).copy()
    dims, top = x.shape[1], 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[:, i] & q) > 0
            t = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(hit, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t, q = np.zeros(len(x), dtype=np.int64), top
    while q > 1:
        t = np.where(x[:, dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[:, i] >> b & 1
    return key


def curve_keys(ids: list[np.ndarray], doc_ids: np.ndarray) -> np.ndarray:
    """63-bit sort keys: the Hilbert key of the document's projected token vector, then a hash of doc_id that spreads equal texts. No list is empty."""
    n = np.array([len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.int64)
    first, grid = np.cumsum(n) - n, np.zeros((len(ids), DIMS), dtype=np.int64)
    for d in range(DIMS):
        mean = np.add.reduceat(_signs(d)[flat & 0xFFFFF], first, dtype=np.float64) / n
        grid[:, d] = np.clip((np.tanh(mean * 3) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(grid, BITS) << 32 | (mix(doc_ids.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


@lru_cache(DIMS)
def _signs(d: int) -> np.ndarray:
    """The hashed sign of every token in dimension d."""
    return 1 - 2 * (mix(np.arange(1 << 20, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(7 + d) & np.uint64(1)).astype(np.int8)


def _ids(batch) -> np.ndarray:
    return batch.column(0).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs, path: str, length: int = 2048, end_id: int = 1, with_ids: bool = False):
    """The pieces of docs(doc_id, text); see the module's text and the query. with_ids: their ids too, as array<int>."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = max(1, min(parts(spark), (size or 0) // BUCKET))

    def ids_of(tok, batch):
        return [np.array([*x, end_id], dtype="<u2" if tok.size <= 65536 else "<u4") for x in tok.encode_all(strings(batch))]

    def sample_keys(batches):
        begin("packing")
        tok = worker_ids(path)
        for whole in batches:
            for batch in pieces(whole, size=2 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(curve_keys(ids_of(tok, batch), _ids(batch)), pa.int64())], names=["key"])

    wanted, bounds = BOUND_ROWS * buckets, np.zeros(0, dtype=np.int64)
    if buckets > 1:
        sample = docs if rows <= wanted else docs.sample(wanted / rows, seed=7)
        keys = np.sort(np.array([r.key for r in sample.mapInArrow(sample_keys, "key long").collect()], dtype=np.int64))
        bounds = np.unique(keys[np.linspace(0, len(keys), buckets + 1).astype(int)[1:-1]]) if len(keys) else keys

    def tokens(batches):
        begin("packing")
        tok = worker_ids(path)
        for whole in batches:
            for batch in pieces(whole, size=2 << 20):
                ids = ids_of(tok, batch)
                key = curve_keys(ids, _ids(batch))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.searchsorted(bounds, key, side="right"), pa.int32()), pa.array(key, pa.int64()), batch.column(0).cast(pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()), pa.array([x.itemsize for x in ids], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    names=["bucket", "key", "doc_id", "n", "wide", "ids"],
                )

    names = ["bucket", *(c.split()[0] for c in PIECES.split(", ")), "ids"]

    def lay(batches):
        begin("packing-lay")
        at: dict[int, int] = {}

        def out(rows: list[tuple]):
            cols = list(zip(*rows, strict=True)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), *[pa.int64()] * 7, pa.list_(pa.int32())], strict=True)], names=names)

        for b in batches:
            done, held = [], 0
            for k, doc, n, wide, raw in zip(b.column(0), b.column(2), b.column(3), b.column(4), b.column(5), strict=True):
                k, doc, n = k.as_py(), doc.as_py(), n.as_py()
                ids = np.frombuffer(raw.as_buffer(), dtype=f"<u{wide.as_py()}")
                i, first = 0, at.get(k, 0)
                while i < n:
                    seq, off = divmod(first + i, length)
                    m = min(n - i, length - off)
                    part = ids[i : i + m].astype("<u4")
                    done.append((k, doc, i, m, zlib.crc32(part.tobytes()), n, seq, off, part.astype(np.int32) if with_ids else None))
                    i += m
                at[k], held = first + n, held + n
                if held > 1 << 20:
                    yield out(done)
                    done, held = [], 0
            yield out(done)

    laid = (
        docs.mapInArrow(tokens, "bucket int, key long, doc_id long, n long, wide int, ids binary")
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", "key", "doc_id", "n", "ids")
        .mapInArrow(lay, f"bucket int, {PIECES}, ids array<int>")
    )
    laid = keep(laid, f"{shared_dir(spark)}/pieces")
    used = dict(laid.groupBy("bucket").agg(F.max("sequence_id") + 1).collect())
    base, at = {}, 0
    for k in sorted(used):
        base[k], at = at, at + used[k]
    # one number a bucket
    first = spark.createDataFrame(list(base.items()), "bucket int, base long")
    got = laid.join(F.broadcast(first), "bucket").withColumn("sequence_id", F.col("sequence_id") + F.col("base"))
    return got.select(*names[1:8], *["ids"] * with_ids)


def op3_hilbert_packing(spark, sf_dir, path: str | None = None):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
