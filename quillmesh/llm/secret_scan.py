"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions only at its hits, then embedded checksums.

Base kinds are the contract's: assign, access, hex. The method adds tokens that carry a checksum (a base-62 CRC32 in their last six
characters) or a structure that can be decoded (JSON web tokens, private key blocks), which counts only if it holds.

Hexadecimal runs have no keyword and are found by one scan. Null text is empty: no spans, and the hash of the empty string. Spans of several
kinds that start together come in the order of KINDS. Repeated rows give repeated rows, an empty table none; a very long text is scanned whole.
Other columns are ignored by scan() and kept by without_secrets(), whatever their names. Places are code points.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import pyarrow as pa

from .common import begin, pieces, ship, strings, table

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: prefix: (kind, whole pattern)
_CHECKED = {p: ("checked", re.compile(re.escape(p) + "[A-Za-z0-9]{36}(?![A-Za-z0-9])")) for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")}
_OTHER = {
    "eyJ": ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")),
    "-----BEGIN ": ("key", re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----\s+([A-Za-z0-9+/=\s]{40,}?)-----END \1-----")),
}
KINDS = ("assign", "access", "hex", "checked", "jwt", "key")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n or len(out) < width:
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out


def checksum_holds(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC32 of those between the prefix and them."""
    body = token[4:]
    return base62(zlib.crc32(body[:-6].encode())) == body[-6:]


def decodes(kind: str, m: re.Match) -> bool:
    try:
        if kind == "jwt":
            head = m.group().split(".")[0]
            return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))).get("alg"), str)
        raw = base64.b64decode("".join(m.group(2).split()), validate=True)
        return raw[:1] == b"\x30" or raw[:14] == b"openssh-key-v1"
    except (ValueError, binascii.Error, AttributeError):
        return False


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in _WORDS:
        a.add_word(w, ("assign", len(w)))
    for p in ("akia", *_CHECKED, *(k.lower() for k in _OTHER)):
        a.add_word(p, (p, len(p)))
    a.make_automaton()
    return a


_LOWER = {c: c + 32 for c in range(65, 91)}


def fold_case(text: str) -> str:
    """A-Z lower-cased, at the same places; str.lower() may lengthen a text, so it serves only where it can't."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def find(text: str, a=None) -> list[tuple[int, int, int]]:
    """(start, index of its kind in KINDS, end) of all spans, in order."""
    out = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    hits: dict[str, list[int]] = {}
    for end, (what, n) in (a or automaton()).iter(fold_case(text)):
        hits.setdefault(what, []).append(end - n + 1)
    done = 0
    for at in sorted(hits.get("assign", ())):
        if at >= done and (m := _ASSIGN.match(text, at)):
            done = m.end()
            if len(m.group(2)) >= 6:
                out.append((at, 0, done))
    done = 0
    for at in hits.get("akia", ()):
        if at >= done and (m := _ACCESS.match(text, at)):
            done = m.end()
            if done - at >= 20:
                out.append((at, 1, done))
    for p, (kind, pattern) in (*_CHECKED.items(), *_OTHER.items()):
        for at in hits.get(p.lower(), ()):
            if (m := pattern.match(text, at)) and (checksum_holds(m.group()) if kind == "checked" else decodes(kind, m)):
                out.append((at, KINDS.index(kind), m.end()))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans) -> str:
    """The text with each span (overlapping ones as one) replaced by a mark of its first kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        s, k, e = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < e:
            i += 1
            e = max(e, spans[i][2])
        out += [text[at:s], f"[secret:{KINDS[k]}]"]
        at, i = e, i + 1
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def scan(docs):
    """Counts of the base kinds, their hash, and all spans of each row of docs(doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches):
        begin("secret_scan")
        a = automaton()
        for whole in batches:
            for batch in pieces(whole):
                rows = []
                for t in strings(batch):
                    s = find(t, a)
                    base = [x for x in s if x[1] < 3]
                    rows.append((*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(s), len(s)))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def without_secrets(docs):
    """The rows, with all their columns, with secrets redacted; n_chars, if it is there, follows the new text. Null texts stay null."""
    ship(docs.sparkSession)

    def run(batches):
        begin("secret_scan")
        a = automaton()
        for whole in batches:
            for batch in pieces(whole):
                at = batch.schema.get_field_index("text")
                texts = [t and redact(t, find(t, a)) for t in batch.column(at).to_pylist()]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if (n := batch.schema.get_field_index("n_chars")) >= 0:
                    batch = batch.set_column(n, batch.schema.field(n), pa.array([None if t is None else len(t) for t in texts], batch.schema.field(n).type))
                yield batch

    return docs.mapInArrow(run, docs.schema)


def op9_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
