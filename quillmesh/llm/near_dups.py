"""Near-duplicate groups by HyperMinHash: banded compressed registers, collision-corrected estimates, confirmation on full sets.

1. Each text's distinct word shingles are hashed once; of every one of REGISTERS buckets the smallest hash is kept as a leading-zero count
   and MANTISSA bits (empty buckets are densified). Texts with equal sets form a class, kept as its smallest doc_id.
2. Bands of four registers are keys. Each key's smallest class is its hub; every class is paired with the hub that it resembles most by the
   corrected estimate, and the pair is confirmed on full sets. Confirmed links form components.
3. A key whose classes are all in one component is done. In the others the classes outside the key's commonest component are compared with
   all, in blocks of at most BLOCK classes and about BLOCK_BYTES of sets, on their full sets; of the links found in a block those leave the
   task that join components not joined by others before. So a group of near copies costs one pair a member, no task holds a whole group,
   and no link between different components of a key is left out.
4. Components of the links of 2 and 3 (large-star, small-star), each with its smallest doc_id.

A pair at similarity 0.8 shares none of the 32 bands with probability 5e-8, the only way to miss a link; estimates below SLACK under the
threshold (seven standard deviations) are no hubs' pairs, but such classes are compared in 3 if they share a key.
Comparing the classes of an open key costs time with the product of their numbers, and moves each class once for every BLOCK others: they are
texts that share all of a band, so they resemble each other.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. A null doc_id is linked with nothing and
kept. Repeated rows share a set and so a component; rows that repeat a doc_id with other texts may share a component. A very long text is hashed
block by block and compared by its set. An empty table gives no rows. Other columns are ignored by near_groups() and kept by one_of_each(),
whatever their names.
"""

from __future__ import annotations

import hashlib
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .common import begin, blobs, drop, id_filter, keep, may_hold, mix, one_permutation, permutations, pieces, shared_dir, shingles, ship, table

REGISTERS, MANTISSA, SLACK = 128, 10, 0.25
BLOCK, BLOCK_BYTES = 1024, 16 << 20
_ORDER = permutations(REGISTERS, 23)
_WIDE = 64 - (REGISTERS.bit_length() - 1)


def registers(values: np.ndarray) -> np.ndarray:
    """Bucket minima (numbers below 2**_WIDE) as 16-bit registers: leading zeros, then the bits after the leading one."""
    length = np.frexp(values.astype(np.float64))[1].astype(np.int64)  # bits; rounding is alike for equal values
    zeros = np.clip(_WIDE - length, 0, 63)
    rest = values.astype(np.uint64) << (zeros + 1 + 64 - _WIDE).astype(np.uint64)
    rest = np.where(zeros + 1 + 64 - _WIDE >= 64, np.uint64(0), rest)
    return (zeros.astype(np.uint64) << np.uint64(MANTISSA) | rest >> np.uint64(64 - MANTISSA)).astype(np.uint16)


def by_chance(n: float) -> float:
    """Share of registers in which unlike sets of n elements agree."""
    m = max(1.0, n / REGISTERS)
    p = [(1 - 2.0 ** -(z + 1)) ** m - (1 - 2.0**-z) ** m for z in range(_WIDE)]
    return 2.0**-MANTISSA * sum(x * x for x in p)


_CHANCE = [by_chance(REGISTERS * 2.0**i) for i in range(40)]


def estimate(same: int, n: float) -> float:
    """Jaccard similarity from the number of equal registers of sets of about n elements."""
    e = _CHANCE[min(39, int(max(0.0, log2(max(1.0, n / REGISTERS)))))]
    return max(0.0, (same / REGISTERS - e) / (1 - e))


def sketch(docs, k: int):
    """(doc_id, n, digest, sig): the size of each row's set, its hash, and its registers, four to a number."""

    def run(batches):
        begin("near_dups")
        for whole in batches:
            for batch in pieces(whole):
                sets = shingles(blobs(batch), k)
                values, some = one_permutation(sets, REGISTERS, _ORDER)
                sig = registers(values).view(np.uint64).view(np.int64) if len(sets) else np.zeros((0, REGISTERS // 4), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([list(s) if y else None for s, y in zip(sig, some, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "digest", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, sig array<long>")


def full_sets(docs, k: int, bits):
    """(id, set): the hashed shingles of each row whose id the filter may hold."""

    def run(batches):
        begin("near_dups")
        for whole in batches:
            for batch in pieces(whole.filter(may_hold(bits.value, whole.column(0)))):
                sets = [s.view(np.int64) for s in shingles(blobs(batch), k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, set array<long>")


def links_of_block(ids: np.ndarray, comps: np.ndarray, left: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a left row with any row that join components which the links before haven't joined; sets are sorted and whole."""
    rows = np.flatnonzero(left)
    size = np.array([len(x) for x in sets])
    which = np.repeat(np.arange(len(sets)), size)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at) > 1
    place = np.cumsum(often) - 1
    keep_ = often[at]
    which, at = which[keep_], place[at[keep_]]
    order = np.argsort(at, kind="stable")
    which, at = which[order], at[order]
    common = np.zeros((len(rows), len(sets)), dtype=np.float32)
    for first in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(at, [first, first + 4096])
        x = np.zeros((len(sets), 4096), dtype=np.float32)
        x[which[lo:hi], at[lo:hi] - first] = 1
        common += x[rows] @ x.T
    same = common.astype(np.int64)
    near = (100 * same >= percent * (size[rows][:, None] + size[None, :] - same)) & (comps[rows][:, None] != comps[None, :])
    top: dict[int, int] = {}

    def find(c: int) -> int:
        while top.get(c, c) != c:
            c = top[c]
        return c

    out = set()
    for i, j in zip(*np.nonzero(near), strict=True):
        r = rows[i]
        a, b = find(int(comps[r])), find(int(comps[j]))
        if a != b:
            top[max(a, b)] = min(a, b)
            out.add((min(int(ids[r]), int(ids[j])), max(int(ids[r]), int(ids[j]))))
    return sorted(out)


def _across(left, docs, k: int, percent: int):
    """Links (a, b) between classes of different components of a key; left(key, rep, comp, minor, minors, minor_n, majors, major_n)."""
    sets = full_sets(docs, k, id_filter(left.select("rep")))
    count = lambda c, n: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK), F.ceil(8 * F.col(n) / BLOCK_BYTES)).cast("int")
    mine = left.withColumns({"few": count("minors", "minor_n"), "many": count("majors", "major_n")}).withColumn("at", F.pmod(F.xxhash64("rep"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    at = F.col("at")
    meet = F.when(F.col("minor"), F.concat(
        F.transform(upto("many"), lambda j: F.struct(F.lit(0).alias("what"), at.alias("i"), j.alias("j"))),
        F.transform(upto("few"), lambda j: F.struct(F.lit(1).alias("what"), F.least(at, j).alias("i"), F.greatest(at, j).alias("j"))),
    )).otherwise(F.transform(upto("few"), lambda i: F.struct(F.lit(0).alias("what"), i.alias("i"), at.alias("j"))))
    rows = (
        mine.join(sets, mine.rep == sets.id).select("key", F.explode(meet).alias("m"), "rep", "comp", "minor", "set")
        .select("key", "m.what", "m.i", "m.j", "rep", "comp", "minor", "set")
        .repartition("key", "what", "i", "j").sortWithinPartitions("key", "what", "i", "j")
    )

    def run(batches):
        begin("near_dups")
        held, rows = None, []

        def done():
            if held is None or not any(r[2] for r in rows) or len(rows) < 2:
                return []
            ids, comps, minor, sets = zip(*rows, strict=True)
            return links_of_block(np.array(ids), np.array(comps), np.array(minor), list(sets), percent)

        def batch(found):
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            whole = b.column(7)
            ends = whole.offsets.to_numpy()
            flat = whole.values.to_numpy()
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(7)), strict=True)):
                if row[:4] != held:
                    if found := done():
                        yield batch(found)
                    held, rows = row[:4], []
                rows.append((*row[4:], flat[ends[i] : ends[i + 1]].copy()))
        yield batch(done())

    return rows.mapInArrow(run, "a long, b long").distinct()


def _alike(pairs, sigs, threshold: float):
    """pairs(a, b) whose sizes and registers allow the similarity, with the estimate; sigs(rep, n, sig)."""
    x = sigs.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = sigs.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    lane = lambda v, i: (F.shiftrightunsigned(v, 16 * i).bitwiseAND(F.lit(65535)) == 0).cast("int")
    same = F.aggregate(F.zip_with("sa", "sb", lambda p, q: p.bitwiseXOR(q)), F.lit(0), lambda t, v: t + lane(v, 0) + lane(v, 1) + lane(v, 2) + lane(v, 3))
    chance = F.element_at(F.array(*[F.lit(c) for c in _CHANCE]), F.least(F.lit(40), F.greatest(F.lit(0), F.log2(F.greatest("na", "nb") / REGISTERS).cast("int")) + 1))
    return (
        pairs.join(y, "b").where(F.col("b").isNotNull()).join(x, "a")
        .where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
        .withColumn("near", (same / REGISTERS - chance) / (1 - chance))
        .where(F.col("near") >= threshold - SLACK).select("a", "b", "near")
    )


def _confirm(pairs, docs, k: int, percent: int):
    """Of pairs(a, b) those with 100 * intersection >= percent * union, on the texts' full sets."""
    sets = full_sets(docs, k, id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id"))))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.select("a", "b")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        .where(100 * common >= percent * (F.size("sa") + F.size("sb") - common))
        .select("a", "b")
    )


def components(edges, top: str):
    """(v, root) of all vertices of edges(a, b), root the least vertex of the component. Alternates large-star and small-star; each round is a table below top."""
    spark = edges.sparkSession
    now = keep(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), f"{top}/0")
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
    before, i = sign(now), 0
    while before[0]:
        i += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        # small-star: every vertex with its smaller neighbours
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        new = keep(small, f"{top}/{i}")
        after = sign(new)
        drop(spark, f"{top}/{i - 1}")
        now = new
        if after == before:
            break
        before = after
    return now.select("v", F.col("u").alias("root"))


def near_groups(docs, k: int = 5, percent: int = 80):
    """Each row's doc_id, n_shingles, component_id and kept: a table in the shared folder."""
    ship(docs.sparkSession)
    spark, top, threshold = docs.sparkSession, shared_dir(docs.sparkSession), percent / 100
    sigs = keep(sketch(docs, k), f"{top}/sketches")
    whole = sigs.where("n > 0 and doc_id is not null")
    reps = keep(whole.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig")), f"{top}/classes")
    rows = reps.select("rep", "n", F.posexplode("sig")).select("rep", "n", F.xxhash64("pos", "col").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("most")).where("hub < most").select("key", "hub")
    live = keep(rows.join(hubs, "key"), f"{top}/keys")
    first = live.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    best = _alike(first, reps, threshold).groupBy("b").agg(F.max_by("a", F.struct("near", -F.col("a"))).alias("a"))
    best = keep(best, f"{top}/best")
    links = keep(_confirm(best, docs, k, percent), f"{top}/links1")
    roots = components(links, f"{top}/roots1")

    of = live.join(roots, live.rep == roots.v, "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("comp"))
    sums = of.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    open_ = sums.groupBy("key").agg(F.max_by(F.struct("comp", "c", "n"), F.struct("c", -F.col("comp"))).alias("m"), F.count("*").alias("parts"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("parts > 1")
    open_ = open_.select("key", F.col("m.comp").alias("major"), (F.col("c") - F.col("m.c")).alias("minors"), (F.col("n") - F.col("m.n")).alias("minor_n"), F.col("m.c").alias("majors"), F.col("m.n").alias("major_n"))
    left = of.drop("n").join(open_, "key").select("key", "rep", "comp", (F.col("comp") != F.col("major")).alias("minor"), "minors", "minor_n", "majors", "major_n")
    left = keep(left, f"{top}/open")
    more = keep(_across(left, docs, k, percent), f"{top}/across")
    root_of = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias(f"r{c}"))
    joined = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    over = components(joined, f"{top}/roots2")
    # a vertex's root by the first links, and that root's by the second
    vertices = reps.select("digest", "rep").join(roots, reps.rep == roots.v, "left").select("digest", F.coalesce("root", "rep").alias("root1"))
    final = vertices.join(over, vertices.root1 == over.v, "left").select("digest", F.coalesce("root", "root1").alias("comp"))
    # rows that are linked with nothing don't take part in the join: many may share one digest
    alone = sigs.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = whole.select("doc_id", "n", "digest").join(final, "digest").select("doc_id", "n", F.col("comp").alias("component_id")).unionByName(alone)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = keep(out, f"{top}-groups")
    drop(spark, top)
    return out


def one_of_each(docs, k: int = 5, percent: int = 80):
    """The rows, with all their columns, of one document of each group: that of the least doc_id; of rows that repeat its id and text one. Rows with a null doc_id stay."""
    spark = docs.sparkSession
    groups = near_groups(docs, k, percent).select("doc_id", "kept")
    gone = groups.where("not kept").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    again = groups.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1").select("doc_id")
    bits = id_filter(gone.unionByName(again))
    at = docs.columns.index("doc_id")

    def rows(held: bool):
        def run(batches):
            begin("near_dups")
            for b in batches:
                mask = may_hold(bits.value, b.column(at))
                yield b.filter(mask if held else pc.invert(mask))

        return docs.mapInArrow(run, docs.schema)

    # only rows that the filter holds go through a shuffle
    return rows(False).unionByName(rows(True).join(gone, "doc_id", "left_anti").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def op7_near_dups(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), k=4, percent=80)
