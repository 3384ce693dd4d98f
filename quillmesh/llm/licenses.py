"""License scans: a generalised suffix automaton of licence tokens, matching statistics, chained template spans.

Templates are short public licence notices and headings, each a sequence of words. A document's words stream through the
automaton; at each word the length of the longest suffix that occurs in some template is known (the matching statistic).
Matches that can't be extended to the right in their template and have at least ``min_match`` words (or are a whole template) are kept, and for each template they
are chained in order of both places; a template whose chain covers ``min_cover`` of its words is a span.

Null text is empty; empty texts have no words, no spans and score 0. Equally long chains are taken in order of place, then label. Repeated
rows give repeated rows, an empty table none; a very long text is scanned whole, by runs of words that occur in templates. Other columns are
ignored, whatever their names. Templates are a parameter: {label: notices}.
"""

from __future__ import annotations

import re
from bisect import bisect

import numpy as np
import pyarrow as pa

from .common import begin, blobs, pieces, ship, table

#: Contract: phrases whose places are counted, and their labels.
BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}

#: The default templates: fixed values, public licence notices and paragraphs in the words that word_list() gives.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "either version 2 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gnu general public license version 3",
        "gnu general public license version 2",
    ],
    "lgpl": ["gnu lesser general public license"],
    "agpl": ["gnu affero general public license"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "mozilla public license version 2.0"],
    "isc": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "zlib": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    ],
    "bsl-1.0": ["boost software license version 1.0"],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"],
    "unlicense": ["anyone is free to copy modify publish use compile sell or distribute this software", "this is free and unencumbered software released into the public domain"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"],
    "cc-by-nd": ["licensed under cc by nd 4.0"],
    "cc0": ["cc0 1.0 universal public domain dedication"],
    "reserved": ["all rights reserved", "may not be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"],
}

#: A-Z becomes a-z, every other ASCII character that isn't a letter or digit becomes a space; bytes above \x7F stay in words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def word_list(text: bytes) -> list[bytes]:
    """The contract's words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return text.translate(_TABLE).split()


class Automaton:
    """A generalised suffix automaton over template words (numbered), with the templates and end places of every state."""

    def __init__(self, templates: dict[str, list[str]]):
        self.vocab: dict[bytes, int] = {}
        self.templates: list[tuple[str, int]] = []
        self.words: list[list[int]] = []
        nxt: list[dict[int, int]] = [{}]
        link, length, ends = [-1], [0], [set()]

        def state(n: int, like: int | None = None) -> int:
            nxt.append(dict(nxt[like]) if like is not None else {})
            link.append(link[like] if like is not None else 0)
            length.append(n)
            ends.append(set())
            return len(nxt) - 1

        for label, texts in sorted(templates.items()):
            for text in texts:
                t, last = len(self.templates), 0
                ws = word_list(text.encode())
                self.templates.append((label, len(ws)))
                self.words.append([])
                for i, w in enumerate(ws):
                    c = self.vocab.setdefault(w, len(self.vocab))
                    self.words[t].append(c)
                    if (q := nxt[last].get(c)) is not None:
                        if length[q] == length[last] + 1:
                            cur = q
                        else:
                            cur = state(length[last] + 1, q)
                            link[q] = cur
                            p = last
                            while p >= 0 and nxt[p].get(c) == q:
                                nxt[p][c] = cur
                                p = link[p]
                    else:
                        cur, p = state(length[last] + 1), last
                        while p >= 0 and c not in nxt[p]:
                            nxt[p][c] = cur
                            p = link[p]
                        if p >= 0:
                            q = nxt[p][c]
                            if length[q] == length[p] + 1:
                                link[cur] = q
                            else:
                                clone = state(length[p] + 1, q)
                                link[q] = link[cur] = clone
                                while p >= 0 and nxt[p].get(c) == q:
                                    nxt[p][c] = clone
                                    p = link[p]
                    ends[cur].add((t, i))
                    last = cur
        for v in sorted(range(1, len(nxt)), key=lambda v: -length[v]):
            if link[v] > 0:
                ends[link[v]] |= ends[v]
        self.next, self.link, self.length, self.ends = nxt, link, length, [sorted(e) for e in ends]
        #: For each state (template, end place, length of the suffix that stands there, 0: the whole match), shorter suffixes' templates too.
        self.suffixes: list[list[tuple[int, int, int]]] = []
        for v in range(len(nxt)):
            got, p, seen = [(t, at, 0) for t, at in self.ends[v]], link[v], ends[v]
            while p > 0:
                got += [(t, at, length[p]) for t, at in sorted(ends[p] - seen)]
                p, seen = link[p], ends[p]
            self.suffixes.append(got)

    def statistics(self, ids: list[int | None]) -> list[tuple[int, int]]:
        """For each word (state, length of the longest suffix of the words so far that some template holds)."""
        s, n, out = 0, 0, []
        for c in ids:
            if c is None:
                s, n = 0, 0
            else:
                while s and c not in self.next[s]:
                    s = self.link[s]
                    n = self.length[s]
                if (to := self.next[s].get(c)) is not None:
                    s, n = to, n + 1
                else:
                    s, n = 0, 0
            out.append((s, n))
        return out


def spans(auto: Automaton, ws: list[bytes], min_match: int = 4, min_cover: float = 0.8, slack: int = 12) -> list[tuple[str, int, int, float]]:
    """Template spans (label, first word, end word, covered share), longest chains first and each label's spans disjoint.

    min_match: words of a match that is chained (whole templates count at any length); slack: words that may lie between matches of a chain.
    """
    ids = list(map(auto.vocab.get, ws))
    known = np.fromiter((i is not None for i in ids), dtype=bool, count=len(ids))
    edge = np.flatnonzero(np.diff(known, prepend=False, append=False))
    matches: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a < 3:
            continue
        stats = auto.statistics(ids[a:b])
        for i, (s, n) in enumerate(stats):
            if n < 3:
                continue
            for t, at, k in auto.suffixes[s]:
                k, size = k or n, auto.templates[t][1]
                # the template's own next word decides whether its match can be extended
                if (k >= min_match or k == size) and (at + 1 == size or ids[a + i + 1 : a + i + 2] != [auto.words[t][at + 1]]):
                    matches.setdefault(t, []).append((a + i - k + 1, at - k + 1, k))
    found = []
    for t, ms in matches.items():
        label, size = auto.templates[t]
        ms.sort()
        best: list[tuple[int, int, int]] = []  # covered words, first word of the chain, words that the chain spans
        for k, (d, q, n) in enumerate(ms):
            covered, first = n, d
            for i in range(k - 1, -1, -1):
                d2, q2, n2 = ms[i]
                if d - d2 > slack + size:  # no match is longer than its template: all before end too early
                    break
                c2, f2, _ = best[i]
                over = max(0, d2 + n2 - d, q2 + n2 - q)
                if q2 < q and d2 < d <= d2 + n2 + slack and n > over and c2 + n - over > covered:
                    covered, first = c2 + n - over, f2
            best.append((covered, first, d + n))
        found += [(covered / size, covered, label, first, end) for covered, first, end in best if covered >= min_cover * size]
    out: list[tuple[str, int, int, float]] = []
    taken: dict[str, list[tuple[int, int]]] = {}  # each label's spans, in order and disjoint
    for share, _, label, first, end in sorted(found, key=lambda x: (-x[1], -x[0], x[3], x[2])):
        held = taken.setdefault(label, [])
        i = bisect(held, (first, end))
        if (not i or held[i - 1][1] <= first) and (i == len(held) or end <= held[i][0]):
            held.insert(i, (first, end))
            out.append((label, first, end, min(1.0, share)))
    return out


def base_places(text: bytes) -> list[tuple[int, str]]:
    """Each place (word number, label) where a base phrase's words stand consecutively; text: a document's words, joined and edged by one space."""
    out = []
    for phrase, label in BASE.items():
        if b" " + phrase + b" " in text:
            out += [(text.count(b" ", 0, m.start()), label) for m in re.finditer(rb" (?=" + phrase + rb" )", text)]
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_spans long, spans string"


def scan(docs, min_match: int = 4, min_cover: float = 0.8, templates: dict[str, list[str]] | None = None):
    """Licence labels and spans of each row of docs(doc_id, text); see the module's text. One pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        begin("licenses")
        auto = Automaton(templates or TEMPLATES)
        for whole in batches:
            for batch in pieces(whole):
                rows = []
                for text in blobs(batch):
                    ws = word_list(text)
                    at = base_places(b" " + b" ".join(ws) + b" ")
                    found = spans(auto, ws, min_match, min_cover)
                    base = sorted({label for _, label in at})
                    rows.append((
                        len(ws), len(at), min((p for p, _ in at), default=None), max((p for p, _ in at), default=None), ",".join(base),
                        ",".join(sorted({*base, *(f[0] for f in found)})), max([float(bool(at)), *(f[3] for f in found)]), len(found),
                        ",".join(f"{a}:{f}:{e}" for a, f, e, _ in sorted(found, key=lambda x: (x[1], x[0]))),
                    ))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.string()]
                names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", ")[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op1_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
