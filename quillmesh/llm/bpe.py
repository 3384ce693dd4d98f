"""Byte-level BPE by recursive DuckDB queries in every partition, and decoding by an ordered aggregation.

Encoding: the pattern splits a text; each distinct piece that is no token itself becomes token-position rows, which join the table of
merges; a recursive query contracts each piece's leftmost pair of least rank until none is left. Pieces are first cut between bytes that
stand together in no token, where no pair can ever meet. Of parts over LONG bytes each step contracts all pairs of the least rank from left
to right, where none of them can make a pair of lower rank (a token whose merges all rank above it); the order of merges stays the same.
Pieces already encoded are kept in a bounded cache of the Python worker. Decoding: ids join the vocabulary and are put together in order of place.

Null text is empty: no ids, and the hash of the empty string. A null doc_id stays null. Repeated rows give repeated rows, an empty table
none. A long text is encoded by its pieces, of which equal ones are encoded once. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .common import begin, kept_for, pieces, ship, strings, table

#: Bytes from which a step contracts all pairs of the least rank: one by one, steps and rows would both grow with the length.
LONG = 128
#: Pieces in one recursive query, and in the cache of a worker.
QUERY_PIECES, CACHE_PIECES = 40_000, 1_500_000
#: A full cache starts anew when more than this share of a batch's pieces isn't in it.
STALE = 0.1

_ENCODE = """
WITH RECURSIVE s(it, w, p, t, n, np) AS (
  SELECT 0, w, p, t, lead(t) OVER x, lead(p) OVER x FROM toks WINDOW x AS (PARTITION BY w ORDER BY p)
  UNION ALL
  SELECT it + 1, w, p, t, lead(t) OVER x, lead(p) OVER x FROM (
    SELECT s.it, s.w, s.p, CASE WHEN s.p = b.k % 1024 THEN (b.k // 1024)::INT ELSE s.t END t
    FROM s JOIN (
      SELECT s.w, min(m.t * 1024::BIGINT + s.p) k, arg_min(s.np, m.t * 1024::BIGINT + s.p) gone
      FROM s JOIN merges m ON m.l = s.t AND m.r = s.n GROUP BY s.w
    ) b ON b.w = s.w
    WHERE s.p <> b.gone
  ) WINDOW x AS (PARTITION BY w ORDER BY p)
)
SELECT w, p, t FROM (SELECT w, p, t, it, max(it) OVER (PARTITION BY w) last FROM s) WHERE it = last ORDER BY w, p
"""
_ENCODE_LONG = """
WITH RECURSIVE s(it, w, i, t, n) AS (
  SELECT 0, w, p, t, lead(t) OVER x FROM toks WINDOW x AS (PARTITION BY w ORDER BY p)
  UNION ALL
  SELECT it, w, (row_number() OVER x - 1)::INT, t, lead(t) OVER x FROM (
    WITH c AS (SELECT s.w, s.i, m.t, m.safe, min(m.t) OVER (PARTITION BY s.w) low FROM s JOIN merges m ON m.l = s.t AND m.r = s.n),
    -- pairs that share a token stand in a run: every other one of it is contracted
    d AS (SELECT w, i, t, safe, min(i) OVER (PARTITION BY w) least, i - row_number() OVER (PARTITION BY w ORDER BY i) run FROM c WHERE t = low),
    g AS (SELECT w, i, t FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY i) k FROM d) WHERE i = least OR safe AND k % 2 = 1)
    SELECT s.it + 1 it, s.w, s.i, coalesce(g.t, s.t) t
    FROM s LEFT JOIN g ON g.w = s.w AND g.i = s.i
    WHERE s.w IN (SELECT w FROM g) AND (s.w, s.i) NOT IN (SELECT w, i + 1 FROM g)
  ) WINDOW x AS (PARTITION BY w ORDER BY i)
)
SELECT w, i AS p, t FROM (SELECT w, i, t, it, max(it) OVER (PARTITION BY w) last FROM s) WHERE it = last ORDER BY w, i
"""
_DECODE = "SELECT d, string_agg(b, '' ORDER BY p) AS text FROM toks JOIN vocab USING (t) GROUP BY d ORDER BY d"


@lru_cache(1)
def fast_pattern() -> re.Pattern:
    """The tokenizers' pattern for texts without characters above U+FFFF, with the letter and number classes written out."""

    def ranges(kind: str) -> str:
        out, start = [], None
        for c in range(0x10001):
            has = c < 0x10000 and unicodedata.category(chr(c))[0] == kind
            if has and start is None:
                start = c
            elif not has and start is not None:
                out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
                start = None
        return "".join(out)

    letters, numbers = ranges("L"), ranges("N")
    space = r"\t-\r \x85\xa0  -     　"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


@lru_cache(1)
def full_pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), regex.V0)


#: Fast only where both regex engines and Unicode versions surely agree: up to the last European letters, and common punctuation.
_PLAIN = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]")


def split(text: str) -> list[str]:
    """The pattern's matches; they cover the text."""
    return (full_pattern() if _PLAIN.search(text) else fast_pattern()).findall(text)


class PieceCache:
    """Ids of pieces that were encoded before; learn() encodes new ones. A full cache keeps what it has, mostly the frequent pieces, and
    forgets others after each batch; so memory is bounded."""

    limit = CACHE_PIECES

    def __init__(self):
        self.empty()

    def empty(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.start = np.zeros(1 << 20, dtype=np.int32), np.zeros((1 << 18) + 1, dtype=np.int64)

    def store(self, new: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        """Put pieces into the cache; ids: all their ids in turn, n: how many each has."""
        at, used = len(self.code), int(self.start[len(self.code)])
        while at + len(new) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.start[at + 1 : at + 1 + len(new)] = used + np.cumsum(n)
        self.code.update(zip(new, range(at, at + len(new)), strict=True))

    def learn(self, new: list[str]) -> None:
        raise NotImplementedError

    def encode(self, texts: list[str], cut=None) -> list[np.ndarray]:
        """The ids of each text; cut: what splits a text, if all texts are known to suit it."""
        found = list(map(cut or split, texts))
        flat = list(chain.from_iterable(found))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        codes = np.fromiter(map(self.code.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        gaps, extra = np.flatnonzero(codes < 0), []
        if len(self.code) >= self.limit and len(gaps) > STALE * len(flat):
            self.empty()
            codes[:], gaps = -1, np.arange(len(flat))
        if len(gaps):
            missing = [flat[i] for i in gaps.tolist()]
            new = list(dict.fromkeys(missing))
            extra = new if len(self.code) >= self.limit else []
            self.learn(new)
            codes[gaps] = np.fromiter(map(self.code.__getitem__, missing), dtype=np.int64, count=len(missing))
        first, n = self.start[codes], self.start[codes + 1] - self.start[codes]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        for x in extra:  # theirs are the last codes
            del self.code[x]
        cuts = np.r_[0, ends][np.cumsum(sizes)]
        return np.split(ids, cuts[:-1]) if len(cuts) else []


class Bpe(PieceCache):
    """Ranks of a tiktoken file, with a DuckDB database of merges and vocabulary and a cache of encoded pieces."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.single = np.zeros(256, dtype=np.int32)
        left, right, made = [], [], []
        #: Which bytes stand next to each other in any token.
        self.meet = np.zeros((256, 256), dtype=bool)
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
            self.meet[list(token[:-1]), list(token[1:])] = True
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB"})
        # tokens of which some merge ranks below them
        low = {x for l, r, t in zip(left, right, made, strict=True) for x in (l, r) if t < x}
        self.db.register("m", pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "t": pa.array(made, pa.int32()), "safe": [t not in low for t in made]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        # a byte as the character of the same number, so that any bytes can be aggregated as text
        self.db.register("v", pa.table({"t": pa.array(self.ranks.values(), pa.int32()), "b": [k.decode("latin-1") for k in self.ranks]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v")
        super().__init__()

    def merge_rows(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces by the recursive queries: all ids in turn, and how many each piece has."""
        n = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws))
        raw = np.frombuffer(b"".join(ws), dtype=np.uint8)
        apart = np.r_[True, ~self.meet[raw[:-1], raw[1:]]]
        apart[np.cumsum(n)[:-1]] = True
        first = np.flatnonzero(apart)
        size = np.diff(np.append(first, len(raw)))
        part = np.repeat(np.arange(len(first), dtype=np.int32), size)
        p = (np.arange(len(raw)) - np.repeat(first, size)).astype(np.int32)
        toks = pa.table({"w": part, "p": p, "t": self.single[raw]})
        long = np.repeat(size > LONG, size)
        ids, at = [], []
        for rows, query in ((~long, _ENCODE), (long, _ENCODE_LONG)):
            if rows.any():
                self.db.register("toks", toks.filter(pa.array(rows)))
                got = self.db.sql(query).to_arrow_table()
                self.db.unregister("toks")
                ids.append(got["t"].to_numpy())
                at.append(got["w"].to_numpy())
        ids, at = np.concatenate(ids), np.concatenate(at)
        order = np.argsort(at, kind="stable")
        of = np.repeat(np.arange(len(ws)), n)[first]
        return ids[order], np.bincount(of[at], minlength=len(ws))

    def learn(self, new: list[str]) -> None:
        """Encode pieces that the cache lacks."""
        alone, rows = [], []
        for x in new:
            b = x.encode()
            if (r := self.ranks.get(b)) is not None:
                alone.append((x, np.array([r], dtype=np.int32)))
            else:
                rows.append((x, b))
        if alone:
            self.store([x for x, _ in alone], np.concatenate([y for _, y in alone]), np.array([len(y) for _, y in alone]))
        for at in range(0, len(rows), QUERY_PIECES):
            part = rows[at : at + QUERY_PIECES]
            self.store([x for x, _ in part], *self.merge_rows([b for _, b in part]))

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        n = np.array([len(x) for x in ids], dtype=np.int64)
        out = [b""] * len(ids)
        if n.sum():
            toks = pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), n), "p": np.arange(n.sum(), dtype=np.int32), "t": np.concatenate(ids)})
            self.db.register("toks", toks)
            got = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("toks")
            for d, x in zip(got["d"].to_pylist(), got["text"].to_pylist(), strict=True):
                out[d] = x.encode("latin-1")
        return out


@lru_cache(1)
def worker_bpe(path: str) -> Bpe:
    """One for the life of a Python worker, which serves many tasks."""
    return Bpe(path)


kept_for("bpe", worker_bpe.cache_clear)


def digests(docs, path: str):
    """Each row's number of ids, the hash of its ids and of the bytes that they decode to."""
    ship(docs.sparkSession)

    def run(batches):
        begin("bpe")
        bpe = worker_bpe(path)
        number = np.array([str(i) for i in range(max(bpe.ranks.values()) + 1)], dtype=object)
        for whole in batches:
            for batch in pieces(whole, size=1 << 21):
                ids = bpe.encode(strings(batch))
                back = bpe.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(",".join(number[x]).encode()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs, path: str):
    """Each row's doc_id and ids (array<int>)."""
    ship(docs.sparkSession)

    def run(batches):
        begin("bpe")
        bpe = worker_bpe(path)
        for whole in batches:
            for batch in pieces(whole, size=1 << 21):
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(bpe.encode(strings(batch)), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens, path: str):
    """Each row's doc_id and the bytes of its ids; null ids give none."""

    def run(batches):
        begin("bpe")
        bpe = worker_bpe(path)
        for batch in batches:
            ids = [np.array(x or [], dtype=np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(bpe.decode(ids), pa.binary())], names=["doc_id", "bytes"])

    ship(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def op2_bpe_round_trip(spark, sf_dir, path: str | None = None):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
