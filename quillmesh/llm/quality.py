"""Quality rules: base counts, and perplexity bands of a modified Kneser-Ney model of word bigrams.

Words without any letter or digit are no words of the model. Each language's documents fall into two halves by their least bigram hash, so
that equal texts always and near copies mostly share a half, and a half is scored by the model of the other one: no document teaches the
model that judges it. Nothing is folded or cut: every word and bigram is a hashed key, and what is gathered grows with the corpus.

1. Texts become blocks of about BLOCK bytes of one language: sorted arrays of the different words' keys, and the words in turn as numbers
   in them. Blocks are a table bucketed by block, so that later joins by block don't move it.
2. Each block sends its different bigrams, as sorted hash arrays with counts, to ranges of keys. A range merges them into the model's sorted
   array and answers each block with the counts over all documents; one block of those that hold a bigram is told to be its owner.
3. Blocks sum over the bigrams they own what Kneser-Ney needs of a word: occurrences as context, continuations by count, contexts before
   it. Ranges of word keys merge these sums and answer in the same way.
4. A block has all it needs to score its documents. Discounts come from counts of counts, one row a range and language.

No key is hot: a block sends a bigram or word at most once. Keys have at least LEAST_BITS bits, and EXTRA more than the number of words has,
so an unseen bigram is taken for a seen one once in 2**EXTRA or less often. Ranges are for about RANGE bytes of text; both sizes bound the memory of a task, not what it covers.

A document is rejected if its mean log perplexity a word of either order lies above its language's and half's band, or that of order one
(continuations, which copies don't change) below it. A band is the median plus so many scaled median absolute deviations over families
(documents of equal least hash), wider for few words or families. Copies that fall into the other half are very predictable by bigrams but
not bad, so order two has no lower band.

Null or empty text has no words, fails the base rules and has log perplexity null, as has a text without letters or digits; such a text is
judged by the base rules alone. Every value of lang has its own model, null is "". A language with one half empty has log perplexity 0.
Repeated rows count as often as they come and get equal results. An empty table gives no rows. A very long text is a block of its own.
Other columns are ignored by score() and kept by keep_good(), whatever their names.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from .common import SPACE, begin, blobs, bucketed, drop, id_filter, keep, may_hold, mix, parts, pieces, shared_dir, ship, strings, table, words

#: Deviations: of order one and two above the median, of order one below; words and families that widen a band by the square root of two.
UPPER, LOWER, SHORT, FEW = (5.0, 4.0), 8.0, 20.0, 50.0
#: Bytes of text in a block, and for which a range of keys serves; bytes of text that are looked at together.
BLOCK, RANGE, PIECE = 12 << 20, 32 << 20, 1 << 20
EXTRA, LEAST_BITS = 8, 40
_STEP, _LEAST_STEPS = 0.005, 20
_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
#: Bytes of letters and digits; those above 0x7F belong to other letters and signs.
_LETTER = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, compressed: each number's length in bits, then the bits below its first, length by length."""
    out = []
    for a in arrays:
        a = np.asarray(a, dtype="<u8")
        if len(a) and int(a.max()) >> 52:
            body = b"\1" + a.tobytes()
        else:
            size = np.frexp(a.astype(np.float64))[1].astype(np.uint8)
            body = b"\0" + size.tobytes()
            for k in range(2, int(size.max(initial=0)) + 1):
                x = a[size == k]
                wide = 4 if k <= 32 else 8
                bits = np.unpackbits(x.astype(f">u{wide}").view(np.uint8).reshape(-1, wide), axis=1)[:, 8 * wide - k + 1 :]
                body += np.packbits(bits).tobytes()
        out.append(len(a).to_bytes(7, "little") + body)
    return zstandard.compress(b"".join(out), 1)


def unsqueeze(b: bytes) -> list[np.ndarray]:
    """The arrays again, as 64-bit numbers."""
    raw, out, at = zstandard.decompress(b), [], 0
    while at < len(raw):
        n, plain = int.from_bytes(raw[at : at + 7], "little"), raw[at + 7]
        at += 8
        if plain:
            out.append(np.frombuffer(raw, dtype="<u8", count=n, offset=at))
            at += 8 * n
            continue
        size = np.frombuffer(raw, dtype=np.uint8, count=n, offset=at)
        a = (size > 0).astype("<u8")
        at += n
        for k in range(2, int(size.max(initial=0)) + 1):
            its = np.flatnonzero(size == k)
            many = len(its) * (k - 1)
            bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=-(-many // 8), offset=at), count=many).reshape(-1, k - 1)
            at += -(-many // 8)
            wide = 4 if k <= 32 else 8
            whole = np.zeros((len(its), 8 * wide), dtype=np.uint8)
            whole[:, 8 * wide - k] = 1
            whole[:, 8 * wide - k + 1 :] = bits
            a[its] = np.packbits(whole, axis=1).view(f">u{wide}")[:, 0]
        out.append(a)
    return out


def squeeze_rows(*columns: np.ndarray) -> bytes:
    """Columns of which many rows are alike: the different rows, the commonest first, and each row's number among them."""
    table = np.stack(columns).astype(np.uint64)
    h = np.zeros(table.shape[1], dtype=np.uint64)
    for c in table:
        h = mix(h * np.uint64(3) + c + np.uint64(1))
    _, first, at, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return squeeze(rank[at], *table[:, first[order]])


def unsqueeze_rows(b: bytes) -> np.ndarray:
    at, *table = unsqueeze(b)
    table = np.stack(table)
    return table.astype(np.int32 if table.size == 0 or int(table.max()) < 1 << 31 else np.int64)[:, at.astype(np.int32)]


def gaps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def features(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text; hashes of all words, and which of them have letters or digits."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    first = np.cumsum(size + 1) - size - 1
    chars = np.add.reduceat(((buf & 0xC0) != 0x80) & ~SPACE[buf], first, dtype=np.int64)
    symbols = np.add.reduceat(_SYMBOL[buf], first, dtype=np.int64)
    h, n, real = words(texts, marks=_LETTER)
    x = mix(mix(mix(h[:-2]) * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:]) if len(h) > 2 else h[:0]
    lines, repeats, at = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), 0
    for i, (t, m) in enumerate(zip(texts, n.tolist(), strict=True)):
        ls = [s for s in t.split(b"\n") if s and not s.isspace()]
        lines[i] = len(ls) - len(set(ls))
        if m >= 3:
            w = x[at : at + m - 2]
            s = np.sort(w)
            if (twice := s[1:] == s[:-1]).any():
                hit = np.flatnonzero(np.isin(w, s[1:][twice]))
                covered = np.zeros(m, dtype=bool)
                covered[hit] = covered[hit + 1] = covered[hit + 2] = True
                repeats[i] = covered.sum()
        at += m
    return [n, chars, symbols, lines, repeats], h, real


def seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def families(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The least hash of each text's bigrams; of its word, if there is but one; 0 if there is none. n: words of each text."""
    first, out = np.cumsum(n) - n, np.zeros(len(n), dtype=np.uint64)
    one, two = np.flatnonzero(n == 1), np.flatnonzero(n > 1)
    out[one] = mix(h[first[one]])
    if len(two):
        pair = mix(h[:-1] * np.uint64(3) + h[1:])
        # from a text's first bigram to its last, and what lies between texts, in turn
        ends = np.stack([first[two], first[two] + n[two] - 1], axis=1).reshape(-1)
        out[two] = np.minimum.reduceat(np.append(pair, np.uint64(2**64 - 1)), ends)[::2]
    return out


def halves(family: np.ndarray) -> np.ndarray:
    return (mix(family + np.uint64(1)) >> np.uint64(63)).astype(np.int64)


BLOCKS = "block long, lang string, ids array<long>, rows binary, counts binary, words binary, seen binary, numbers binary"


class Block:
    """Documents of one language."""

    def __init__(self, lang: str, bits: int):
        self.lang, self.cut = lang, np.uint64(64 - bits)
        self.size, self.held = 0, []

    def add(self, size: int, *columns: np.ndarray) -> None:
        self.size += size
        self.held.append(columns)

    def row(self) -> tuple:
        ids, rows, *f, family, n, h = (np.concatenate(x) for x in zip(*self.held, strict=True))
        s = seed(self.lang)
        key = mix(h ^ s) >> self.cut
        # the sign before a text's first word is a word, too
        start = mix(np.array([s]))[0] >> self.cut
        vocab, at = np.unique(np.append(key, start), return_inverse=True)
        seen = np.bincount(at, minlength=len(vocab))
        rank = np.empty(len(vocab), dtype=np.int64)
        rank[np.argsort(-seen, kind="stable")] = np.arange(len(vocab))
        counts = [x.astype(np.uint64) for x in f]
        ids = [None if x == -(2**63) else x for x in ids.tolist()]
        return int.from_bytes(os.urandom(8), "little") >> 1, self.lang, ids, squeeze(rows.view(np.uint64)), squeeze(*counts, family, n), squeeze(gaps(vocab), [start]), squeeze(seen), squeeze(rank[at[:-1]])


def blocks(docs, bits: int):
    """docs(doc_id, text, lang, row) as blocks; row: what tells equal rows."""

    def run(batches):
        begin("quality-blocks")
        held: dict[str, Block] = {}

        def out(*done: Block):
            cols = list(zip(*(b.row() for b in done), strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for whole in batches:
            for batch in pieces(whole, size=PIECE):
                texts, lang = blobs(batch), np.array(strings(batch, "lang"), dtype=object)
                f, h, real = features(texts)
                doc = np.repeat(np.arange(len(texts)), f[0])[real]
                h, n = h[real], np.bincount(doc, minlength=len(texts))
                family = families(h, n)
                ids = batch.column(0).cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                rows = batch.column(3).to_numpy(zero_copy_only=False)
                size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
                for k in dict.fromkeys(lang.tolist()):
                    its = lang == k
                    b = held.setdefault(k, Block(k, bits))
                    b.add(int(size[its].sum()), ids[its], rows[its], *(x[its] for x in f), family[its], n[its], h[its[doc]])
                    if b.size >= BLOCK:
                        yield out(held.pop(k))
                if sum(b.size for b in held.values()) >= 2 * BLOCK:
                    yield out(held.pop(max(held, key=lambda k: held[k].size)))
        for k in list(held):
            yield out(held.pop(k))

    return docs.mapInArrow(run, BLOCKS)


class Bigrams:
    """What a block's row says: its words, its bigrams in the order of their keys, and which of them each word of the texts ends."""

    def __init__(self, row: dict, bits: int):
        self.lang, self.block = row["lang"], row["block"]
        self.counts = unsqueeze(row["counts"])
        self.family, self.n = self.counts[5], self.counts[6].astype(np.int64)
        steps, (start,) = unsqueeze(row["words"])
        self.words = np.cumsum(steps, dtype=np.uint64)
        (seen,) = unsqueeze(row["seen"])
        by_rank = np.argsort(-seen.astype(np.int64), kind="stable")
        (ranks,) = unsqueeze(row["numbers"])
        word = by_rank[ranks.astype(np.int64)]
        del ranks, by_rank, seen
        first = np.cumsum(self.n) - self.n
        pairs = np.empty_like(word)
        pairs[1:] = word[:-1]
        pairs[first[self.n > 0]] = np.searchsorted(self.words, start)
        pairs *= len(self.words)
        pairs += word
        del word
        self.half = halves(self.family)
        half = np.repeat(self.half.astype(np.int8), self.n)
        pairs, at = np.unique(pairs, return_inverse=True)
        at = at.astype(np.int32)
        a, b = (pairs // len(self.words)).astype(np.int32), (pairs % len(self.words)).astype(np.int32)
        del pairs
        keys = mix(mix(self.words[a] + np.uint64(1)) * np.uint64(3) + self.words[b]) >> np.uint64(64 - bits)
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.keys, self.a, self.b, self.at = keys[order], a[order], b[order], place[at]
        self.own = [np.bincount(self.at[half == f], minlength=len(keys)).astype(np.int32) for f in (0, 1)]

    def cuts(self, keys: np.ndarray, ranges: int, bits: int) -> list[slice]:
        """The part of sorted keys of each range."""
        edges = [0, *np.searchsorted(keys, (np.arange(1, ranges, dtype=object) * (1 << bits) // ranges).astype(np.uint64)).tolist(), len(keys)]
        return [slice(x, y) for x, y in zip(edges, edges[1:], strict=False)]


ASKED = "range int, lang string, block long, keys binary, sums binary"
#: kind 0: answers about bigrams, 1: about words, 2 and 3: counts of counts of both, with block -1.
ANSWERS = "kind int, lang string, block long, range int, sums binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    cols = list(zip(*rows, strict=True)) or [()] * len(schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(cols, schema.split(", "), strict=True)], names=[f.split()[0] for f in schema.split(", ")])


def _merge(rows: list[dict]):
    """The sorted different keys of several blocks, where each block's keys are among them, the sums of their numbers, and the blocks' sizes."""
    keys = [np.cumsum(unsqueeze(r["keys"])[0], dtype=np.uint64) for r in rows]
    sizes = [len(k) for k in keys]
    keys = np.concatenate(keys)
    whole, at = np.unique(keys, return_inverse=True)
    del keys
    at = at.astype(np.int32)
    own = np.concatenate([unsqueeze_rows(r["sums"]) for r in rows], axis=1)
    return whole, at, own, np.stack([np.bincount(at, weights=s, minlength=len(whole)).astype(np.int64) for s in own]), sizes


def _by_lang(t: pa.Table) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in t.to_pylist():
        out.setdefault(r["lang"], []).append(r)
    return out


def _of_counts(n: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, any; their sum."""
    return [*(int((n == i).sum()) for i in (1, 2, 3, 4)), int((n > 0).sum()), int(n.sum())]


class Counts(dict):
    """Each language's and half's counts of counts of bigrams (2) and continuations (3), and the discounts that follow."""

    def discounts(self, kind: int, lang: str, half: int) -> np.ndarray:
        """By count: 0, 1, 2, 3 and more."""
        n1, n2, n3, n4 = (max(x, 1) for x in self.get((kind, lang), [0] * 12)[6 * half : 6 * half + 4])
        y = n1 / (n1 + 2 * n2)
        return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])

    def low(self, lang: str, half: int, cont: np.ndarray) -> np.ndarray:
        """Probabilities of words by their numbers of contexts."""
        n1, n2, _, _, types, total = self.get((3, lang), [0] * 12)[6 * half : 6 * half + 6]
        if not total:
            return np.ones(len(cont))
        d = self.discounts(3, lang, half)
        spare = d[1] * n1 + d[2] * n2 + d[3] * (types - n1 - n2)
        # one more than the words seen stands for all others
        return (cont - d[np.minimum(cont, 3)]) / total + spare / total / (types + 1)

    def spare(self, lang: str, half: int, once: np.ndarray, twice: np.ndarray, oftener: np.ndarray) -> np.ndarray:
        """What discounting takes from the bigrams after each word, of which so many occur once, twice, oftener."""
        d = self.discounts(2, lang, half)
        # a word whose only bigram shares its key with another's may seem to have none
        return np.maximum(d[1] * once + d[2] * twice + d[3] * oftener, d[1])

    def high(self, lang: str, half: int, count: np.ndarray, context: np.ndarray, spare: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Probabilities of bigrams; context, spare: of the word before."""
        p = count - self.discounts(2, lang, half)[np.minimum(count, 3)]
        p += spare * low
        p /= np.maximum(context, 1)
        return np.where(context > 0, p, low)


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, k string, half int, row long, family long, log_perplexity_1 double, log_perplexity double"


def score(docs):
    """The base counts and the mean log perplexities of each row of docs(doc_id, text, lang), with what names its band, its family and the row.

    Returns a table in the shared folder.
    """
    ship(docs.sparkSession)
    spark, top = docs.sparkSession, shared_dir(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(64, max(LEAST_BITS, (size // 8 + 1).bit_length() + EXTRA))
    # a block has fewer words than bigrams: half as many ranges serve them
    ranges = max(1, -(-size // RANGE))
    word_ranges = -(-ranges // 2)
    docs = docs.select("doc_id", "text", "lang", row_key().alias("row"))
    held = bucketed(blocks(docs, bits), f"{top}/blocks", "block", max(1, parts(spark)))
    by_block = lambda df: held.df.groupBy("block").cogroup(df.groupBy("block"))

    def ask(batches):
        begin("quality-ask")
        for b in batches:
            for row in b.to_pylist():
                x = Bigrams(row, bits)
                for i, s in enumerate(x.cuts(x.keys, ranges, bits)):
                    if s.start < s.stop:
                        yield _batch([(i, x.lang, x.block, squeeze(gaps(x.keys[s])), squeeze_rows(*(c[s] for c in x.own)))], ASKED)

    def count(t):
        begin("quality-count")
        out, at_range = [], t.column("range")[0].as_py()
        for lang, rows in _by_lang(t).items():
            _, at, own, total, n = _merge(rows)
            first = np.zeros(len(at), dtype=np.int64)
            first[np.unique(at, return_index=True)[1]] = 1
            stop = np.cumsum(n)
            for r, i, j in zip(rows, stop - n, stop, strict=True):
                # of a block's counts only those that its other half asks for, or that its owner needs
                c0, c1 = (np.where((own[1 - f, i:j] > 0) | (first[i:j] > 0), total[f, at[i:j]], 0) for f in (0, 1))
                out.append((0, lang, r["block"], at_range, squeeze_rows(c0, c1, first[i:j])))
            out.append((2, lang, -1, at_range, squeeze(_of_counts(total[0]) + _of_counts(total[1]))))
        return pa.Table.from_batches([_batch(out, ANSWERS)])

    def joined(t, kind: int) -> list[np.ndarray]:
        """A block's answers of a kind, range after range."""
        got = sorted((r["range"], r["sums"]) for r in t.to_pylist() if r["kind"] == kind)
        return list(np.concatenate([unsqueeze_rows(s) for _, s in got], axis=1))

    def sum_words(block, answers):
        begin("quality-sum")
        out = []
        for row in block.to_pylist():
            x = Bigrams(row, bits)
            if not len(x.keys):
                continue
            c0, c1, owner = joined(answers, 0)
            mine, size = owner > 0, len(x.words)
            sums = [np.bincount(x.a, weights=c, minlength=size).astype(np.int64) for c in x.own]
            for c in (c0, c1):
                sums += [np.bincount(x.a[mine & w], minlength=size) for w in (c == 1, c == 2, c > 2)]
                sums.append(np.bincount(x.b[mine & (c > 0)], minlength=size))
            # which words stand in either half: as a context or at the end of a bigram
            sums += [(np.bincount(x.a[c > 0], minlength=size) + np.bincount(x.b[c > 0], minlength=size) > 0).astype(np.int64) for c in x.own]
            for i, s in enumerate(x.cuts(x.words, word_ranges, bits)):
                if s.start < s.stop:
                    out.append((i, x.lang, x.block, squeeze(gaps(x.words[s])), squeeze_rows(*(c[s] for c in sums))))
        return pa.Table.from_batches([_batch(out, ASKED)])

    def count_words(t):
        begin("quality-count-words")
        out, at_range = [], t.column("range")[0].as_py()
        for lang, rows in _by_lang(t).items():
            _, at, own, total, n = _merge(rows)
            stop = np.cumsum(n)
            for r, i, j in zip(rows, stop - n, stop, strict=True):
                # the numbers of a half are asked for by words that stand in the other one
                need = [own[10 + f, i:j] > 0 for f in (1, 0)]
                out.append((1, lang, r["block"], at_range, squeeze_rows(*(np.where(need[c in (1, 6, 7, 8, 9)], total[c, at[i:j]], 0) for c in range(10)))))
            out.append((3, lang, -1, at_range, squeeze(_of_counts(total[5]) + _of_counts(total[9]))))
        return pa.Table.from_batches([_batch(out, ANSWERS)])

    asked = held.df.mapInArrow(ask, ASKED)
    first = keep(asked.groupBy("range").applyInArrow(count, ANSWERS), f"{top}/bigrams")
    asked = by_block(first.where("kind = 0")).applyInArrow(sum_words, ASKED)
    second = keep(asked.groupBy("range").applyInArrow(count_words, ANSWERS), f"{top}/words")
    counts = Counts()
    # a row for each language and range: two times six numbers
    for r in first.unionByName(second).where("kind > 1").select("kind", "lang", "sums").toLocalIterator():
        k = (r.kind, r.lang)
        counts[k] = [x + y for x, y in zip(counts.get(k, [0] * 12), unsqueeze(bytes(r.sums))[0].tolist(), strict=True)]

    def give(block, answers):
        begin("quality-give")
        out = []
        for row in block.to_pylist():
            x = Bigrams(row, bits)
            one, two = np.full((2, len(x.n)), np.nan)
            if len(x.keys):
                c, w = joined(answers, 0), joined(answers, 1)
                half, first = np.repeat(x.half.astype(np.int8), x.n), np.cumsum(x.n) - x.n
                lows, highs = np.zeros(len(half)), np.zeros(len(half))
                for f in (0, 1):
                    # the other half's numbers
                    o, mine = 1 - f, half == f
                    its = x.at[mine]
                    low = counts.low(x.lang, o, w[5 + 4 * o])
                    lows[mine] = np.log(low)[x.b[its]]
                    p = counts.high(x.lang, o, c[o], w[o][x.a], counts.spare(x.lang, o, *w[2 + 4 * o : 5 + 4 * o])[x.a], low[x.b])
                    highs[mine] = np.log(p)[its]
                    del p, its, low
                del c, w
                some = x.n > 0
                one[some], two[some] = (-np.add.reduceat(v, first[some]) / x.n[some] for v in (lows, highs))
            (rows,) = unsqueeze(row["rows"])
            cols = [pa.array(row["ids"], pa.int64()), *(pa.array(v.astype(np.int64)) for v in x.counts[:5]), pa.array([x.lang] * len(x.n), pa.string()), pa.array(x.half.astype(np.int32)), pa.array(rows.view(np.int64)), pa.array(x.family.view(np.int64))]
            cols += [pa.array(v, pa.float64(), from_pandas=True) for v in (one, two)]
            out.append(pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCORED.split(", ")]))
        return pa.Table.from_batches(out, out[0].schema if out else pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[f.split()[1]]) for f in SCORED.split(", ")]))

    scored = keep(by_block(first.unionByName(second).where("kind < 2")).applyInArrow(give, SCORED), f"{top}/scored")
    held.drop()
    drop(spark, f"{top}/bigrams", f"{top}/words")
    return scored


def row_key():
    """What tells a row of docs by all that a verdict depends on."""
    return F.xxhash64("doc_id", "text", "lang")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(scored) -> list[tuple]:
    """(language, half, order, median log perplexity, scaled deviation) over families that pass the base rules; from histograms in steps of _STEP,
    so at most some thousand rows a language reach the driver."""
    names = ("log_perplexity_1", "log_perplexity")
    mean = scored.where(~base_failed() & F.col("log_perplexity").isNotNull()).groupBy("k", "half", "family").agg(*[F.avg(c).alias(c) for c in names])
    rows = mean.select("k", "half", F.posexplode(F.array(*[F.floor(F.col(c) / _STEP).cast("int") for c in names])).alias("order", "b")).groupBy("k", "half", "order", "b").count().collect()
    held: dict[tuple, list[tuple[int, int]]] = {}
    for r in rows:
        held.setdefault((r.k, r.half, r.order), []).append((r.b, r["count"]))

    def median(v, w):
        o = np.argsort(v, kind="stable")
        return v[o][np.searchsorted(np.cumsum(w[o]), w.sum() / 2)]

    out = []
    for k, x in held.items():
        b, n = (np.array(v) for v in zip(*sorted(x), strict=True))
        mid = median(b, n)
        dev = max(1.4826 * median(np.abs(b - mid), n), _LEAST_STEPS) * np.sqrt(1 + FEW / n.sum())
        out.append((*k, float((mid + 0.5) * _STEP), float(dev * _STEP)))
    return out


def judge(docs):
    """score(docs) with base_failed and kept."""
    spark = docs.sparkSession
    scored = score(docs)
    limits: dict[tuple, dict] = {}
    for k, h, o, mid, dev in bands(scored):
        limits.setdefault((k, h), {})[o] = (mid, dev)
    # a row for each language and half
    of = spark.createDataFrame([(k, h, *v[0], *v[1]) for (k, h), v in limits.items()], "bk string, bh int, m1 double, d1 double, m2 double, d2 double")
    x = scored.join(F.broadcast(of), (F.col("k") == F.col("bk")) & (F.col("half") == F.col("bh")), "left")
    wide = F.sqrt(1 + SHORT / F.greatest("n_words", F.lit(1)))
    far = [(F.col(c) - F.col(m)) / (F.col(d) * wide) for c, m, d in (("log_perplexity_1", "m1", "d1"), ("log_perplexity", "m2", "d2"))]
    out = (far[0] > UPPER[0]) | (far[0] < -LOWER) | (far[1] > UPPER[1])
    return x.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~F.coalesce(out, F.lit(False))}).drop("bk", "bh", "m1", "d1", "m2", "d2")


def keep_good(docs):
    """The rows, with all their columns, that pass the base rules and their language's bands. Only rows that may be rejected go through a shuffle."""
    spark = docs.sparkSession
    gone = keep(judge(docs).where("not kept").select("row").distinct(), f"{shared_dir(spark)}/rejected")
    bits, name = id_filter(gone), "_quality_row"
    keyed = docs.withColumn(name, row_key())

    def rows(held: bool):
        def run(batches):
            begin("quality")
            for b in batches:
                mask = may_hold(bits.value, b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(mask if held else ~mask))

        return keyed.mapInArrow(run, keyed.schema)

    return rows(False).unionByName(rows(True).join(gone.withColumnRenamed("row", name), name, "left_anti").select(keyed.columns)).drop(name)


def op4_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).drop("k", "half", "row", "family")
