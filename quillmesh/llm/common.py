"""What the operators of this folder share: shipping code, reading tables, shared storage, vectorised words."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..ship import ship

#: White space of the contracts: \x20 and \x09-\x0D, as bytes.split() has it.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at a time: bounds memory whatever the length of a text.
BLOCK = 1 << 18


def table(spark, sf_dir: str, name: str):
    """A table of the data folder, read through Spark so that any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker keeps from task to task: (owner, what empties it).
_KEPT: list[tuple[str, object]] = []
_last = [""]


def kept_for(owner: str, empty) -> None:
    _KEPT.append((owner, empty))


def begin(owner: str) -> None:
    """Called where a task starts: workers outlive stages, so what other operators keep in this one goes before it takes memory of its own."""
    if _last[0] == owner:
        return
    _last[0] = owner
    for other, empty in _KEPT:
        if other != owner:
            empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Only where that is unset (tests) a local one is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quillmesh-shared")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/quillmesh-{uuid.uuid4().hex}"


#: Spark's own settings while a table is written: shuffle files go when the query that wrote them ends, and not when the driver happens to
#: collect its garbage; batches for Python are bounded by bytes, as long texts would make them large on both sides.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def _settings(spark):
    """The session's own values come back after it."""
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def keep(df, path: str, codec: str = "zstd"):
    """Write df to path and return it read again: cuts the lineage by a table that survives lost executors."""
    with _settings(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark, *paths: str) -> None:
    """Remove tables written by keep(), through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class bucketed:
    """df as a table below path, bucketed by a column: later joins and groups by that column don't move its rows. The catalogue entry has a name of its own."""

    def __init__(self, df, path: str, by: str, buckets: int):
        self.spark, self.path, self.name = df.sparkSession, path, "quillmesh_" + uuid.uuid4().hex
        with _settings(self.spark):
            df.write.format("parquet").option("compression", "uncompressed").option("path", path).bucketBy(buckets, by).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop(self.spark, self.path)


def parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blobs(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null gives b''."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [b or b"" for b in col.to_pylist()]


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [s or "" for s in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def pieces(batch: pa.RecordBatch, rows: int = 2000, size: int = 2 << 20):
    """Slices of a batch with at most so many rows and about so many bytes of text (a longer text is alone)."""
    at = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, base + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words(texts: list[bytes], lower: bool = False, marks: np.ndarray | None = None):
    """64-bit hashes of all white-space separated words of the texts, one after another, and the number of words of each text.

    marks: 256 flags; then a third array tells which words hold any byte that is flagged. Bytes are weighted by their place in the word
    and summed; memory is bounded by BLOCK and the longest word.
    """
    whole = b"\n".join(texts) + b"\n"
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    buf, out, firsts, marked, at = np.frombuffer(whole, dtype=np.uint8), [], [], [], 0
    while at < len(buf):
        to = min(len(buf), at + BLOCK)
        while to < len(buf) and not SPACE[buf[to - 1]]:
            to = min(len(buf), to + 4096)
            gaps = np.flatnonzero(SPACE[buf[to - 4096 : to]])
            if len(gaps):
                to = to - 4096 + int(gaps[-1]) + 1
                break
        b = buf[at:to]
        inside = ~SPACE[b]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        s, e = edge[::2], edge[1::2]
        if len(s):
            if lower:
                b = LOWER[b]
            idx = np.flatnonzero(inside)
            n = e - s
            base = np.cumsum(n) - n
            off = np.arange(len(idx)) - np.repeat(base, n)
            v = _BYTE[b[idx]] * _POWER[off & 4095]
            if n.max() > 4096:
                v += (off >> 12).astype(np.uint64) * _M1 * _BYTE[b[idx]]
            h = np.add.reduceat(v, base)
            out.append(mix(h + n.astype(np.uint64) * _M2))
            firsts.append(s + at)
            if marks is not None:
                marked.append(np.logical_or.reduceat(marks[b[idx]], base))
        at = to
    if not out:
        got = np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    else:
        got = np.concatenate(out), np.diff(np.searchsorted(np.concatenate(firsts), ends), prepend=0)
    return got if marks is None else (*got, np.concatenate(marked) if marked else np.zeros(0, dtype=bool))


def shingles(texts: list[bytes], k: int, lower: bool = True) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; fewer words count as one shingle, no word gives none."""
    h, counts = words(texts, lower)
    if len(h) >= k:
        x = mix(h[: len(h) - k + 1] + np.uint64(k))
        for i in range(1, k):
            x = mix(x * np.uint64(3) + h[i : len(h) - k + 1 + i])
    else:
        x = np.zeros(0, dtype=np.uint64)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(x[at : at + n - k + 1]))
        elif n:
            y = np.array([n * 7919], dtype=np.uint64)
            for w in h[at : at + n]:
                y = mix(y * np.uint64(3) + w)
            out.append(y)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def permutations(bins: int, seed: int) -> np.ndarray:
    """For each bin a fixed random order of all bins: where optimal densification looks for a filled one."""
    r = np.random.default_rng(seed)
    return np.stack([r.permutation(bins) for _ in range(bins)]).astype(np.int32)


def one_permutation(sets: list[np.ndarray], bins: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's smallest hash in every bin (the hash's high bits name the bin; they are cut off), empty bins filled from the first
    filled bin of their own order. Returns (values, whether the set has any element)."""
    shift = 64 - (bins.bit_length() - 1)
    edges = np.arange(bins, dtype=np.uint64) << np.uint64(shift)
    mask = np.uint64((1 << shift) - 1)
    out, some = np.zeros((len(sets), bins), dtype=np.uint64), np.zeros(len(sets), dtype=bool)
    for i, s in enumerate(sets):
        if not len(s):
            continue
        some[i] = True
        at = np.searchsorted(s, edges)
        got = np.diff(at, append=len(s)) > 0
        v = s[np.minimum(at, len(s) - 1)] & mask
        if not got.all():
            gap = np.flatnonzero(~got)
            o = order[gap]
            v[gap] = v[o[np.arange(len(gap)), got[o].argmax(axis=1)]]
        out[i] = v
    return out, some


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


#: Bits of an id filter: a broadcast of at most 4 MB whatever the number of ids. A fuller filter passes more rows that a later join drops.
FILTER_BITS = 25


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids):
    """A bitmap of the hashed ids of a one-column DataFrame of longs, for may_hold(); nulls are left out."""

    def run(batches):
        held: dict[int, int] = {}
        for b in batches:
            at = _slots(b.column(0).drop_null().to_numpy(zero_copy_only=False))
            for w, bit in zip((at >> 5).tolist(), (at & 31).tolist(), strict=True):
                held[w] = held.get(w, 0) | 1 << bit
        items = sorted(held.items())
        for i in range(0, len(items), 100_000):
            w, v = zip(*items[i : i + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(v, pa.int64())], names=["w", "v"])

    got = ids.mapInArrow(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    bits[got["w"].to_numpy()] = got["v"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(bits)


def may_hold(bits: np.ndarray, ids: pa.Array) -> pa.Array:
    """Whether each id may be in the filter; null ids are not."""
    at = _slots(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
    return pc.and_(pa.array((bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)), ids.is_valid())
