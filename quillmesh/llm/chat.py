"""Chat formatting: a hidden Markov model over speaker markers and line features recovers roles by Viterbi; turns are rendered canonically.

States are roles, observations are lines. A line may hold a speaker's marker: a word of the transcript's own set of role words ("User:" and
"Assistant:", "Q:" and "A:", ...), or an unknown name that recurs in the same form. Of several sets the one with most markers counts, and
of several forms ("Name:", "### Name", "<|name|>", ...) the commonest; other lines that look like markers are content. A line emits its
marker's role, its length and whether it asks. At a marker the role moves from turn to turn; without one it mostly stays, and moves with the
share MISSING of turns that have lost their marker. Start, moves, lengths, questions and lines a turn are counted on conversations with known
roles (fit()), with one more of each. Lines inside code fences have no markers. A turn starts where a marker stands or the role changes.

Null text is empty; a transcript without lines has no turns. Turns with a null role are taken for "user", a null turn number comes first.
Repeated rows are turns of their own. A conversation is read whole and in order by one task, of any number of turns, since each line's role
depends on those before: time is linear in it, memory holds one conversation. An empty table gives no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import functions as F

from .common import begin, ship, table

ROLES = ("system", "user", "assistant")
#: Words for system, user and assistant that are used together.
SETS = (
    {"system": 0, "user": 1, "assistant": 2, "prompter": 1, "context": 0},
    {"system": 0, "human": 1, "assistant": 2, "ai": 2, "instructions": 0},
    {"context": 0, "q": 1, "a": 2},
    {"context": 0, "question": 1, "answer": 2},
    {"system": 0, "customer": 1, "agent": 2, "operator": 2},
    {"system": 0, "user": 1, "bot": 2, "model": 2, "gpt": 2, "chatgpt": 2},
    {"system": 0, "you": 1, "bot": 2, "ai": 2, "gpt": 2, "chatgpt": 2},
)
_MARKER = re.compile(r"^[^\S\n]*(#{1,6}[^\S\n]*|\*\*|\[|<\|?)?([^\W\d_][\w .'-]{0,30}?)[^\S\n]*(?:(\*\*:|:\*\*|\|>|\]:?|>|:)(?:[^\S\n]+|$)|$)")
#: Share of turns without a marker; chance that a marker names another role; length classes by powers of two up to 2**CLASSES.
MISSING, MISNAMED, CLASSES = 0.05, 0.02, 12


class Model:
    """Logarithms of the probabilities, from counts."""

    def __init__(self, start: list[float] | None = None, move: list[list[float]] | None = None, lines: list[float] | None = None, turns: list[float] | None = None, size: list[list[float]] | None = None, asks: list[float] | None = None):
        share = lambda row: [log((x + 1) / (sum(row) + len(row))) for x in row]
        self.start = share(start or [2, 6, 0])
        self.move = [share(r) for r in move or [[0, 8, 1], [0, 1, 8], [0, 8, 1]]]
        lines, turns, asks = lines or [10.0] * 3, turns or [5.0] * 3, asks or [0.0] * 3
        # a line is its turn's last
        self.last = [(t + 1) / (n + 2) for t, n in zip(turns, lines, strict=True)]
        self.size = [share(r) for r in size or [[1] * CLASSES] * 3]
        self.asks = [[log(1 - (a + 1) / (n + 2)), log((a + 1) / (n + 2))] for a, n in zip(asks, lines, strict=True)]

    def emit(self, line: str, role: int | None, sure: bool) -> list[float]:
        """Of each role; role: that of the line's marker, sure: whether a role word gives it."""
        k, q = min(len(line).bit_length(), CLASSES - 1), line.rstrip().endswith("?")
        out = [self.size[r][k] + self.asks[r][q] for r in range(3)]
        if role is not None:
            odds = (1 - 2 * MISNAMED, MISNAMED) if sure else (0.6, 0.2)
            out = [e + log(odds[0] if r == role else odds[1]) for r, e in enumerate(out)]
        return out

    def step(self, marked: bool) -> list[list[float]]:
        """From role (row) to role: at a marker a new turn; else mostly the same one."""
        if marked:
            return self.move
        lost = [MISSING * x for x in self.last]
        return [[log(1 - lost[p] + lost[p] * 2.718281828459045 ** self.move[p][r]) if p == r else log(lost[p]) + self.move[p][r] for r in range(3)] for p in range(3)]


def fit(chats) -> Model:
    """Counts of conversations with known roles, chats(conv_id, turn, role, text); at most a few dozen numbers reach the driver."""
    ship(chats.sparkSession)
    rows = chats.where(F.col("role").isin(*ROLES)).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    at = {r: i for i, r in enumerate(ROLES)}
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("then"))
    moves = rows.select("conv_id", "turn", "role").join(nxt, ["conv_id", "turn"]).groupBy("role", "then").count().collect()
    first = rows.groupBy("conv_id").agg(F.min_by("role", "turn").alias("role")).groupBy("role").count().collect()
    line = F.explode(F.split("text", "\n")).alias("line")
    size = F.least(F.lit(CLASSES - 1), F.ceil(F.log2(F.char_length("line") + 1)).cast("int")).alias("size")
    seen = rows.select("role", line).select("role", size, F.rtrim("line").endswith("?").alias("asks")).groupBy("role", "size", "asks").count().collect()
    turns = rows.groupBy("role").count().collect()
    out = {"start": [0.0] * 3, "move": [[0.0] * 3 for _ in range(3)], "lines": [0.0] * 3, "turns": [0.0] * 3, "size": [[0.0] * CLASSES for _ in range(3)], "asks": [0.0] * 3}
    if not turns:
        return Model()
    for r in first:
        out["start"][at[r.role]] += r["count"]
    for r in turns:
        out["turns"][at[r.role]] += r["count"]
    for r in moves:
        out["move"][at[r.role]][at[r.then]] += r["count"]
    for r in seen:
        i = at[r.role]
        out["lines"][i] += r["count"]
        out["size"][i][r["size"]] += r["count"]
        out["asks"][i] += r["count"] * r["asks"]
    return Model(**out)


def marker(line: str) -> tuple[str, str, int] | None:
    """(form, name, where the text after it begins) of a line that looks like a speaker's."""
    m = _MARKER.match(line)
    if not m:
        return None
    opens, name, closes = (m.group(1) or "").strip(), m.group(2).strip().lower(), m.group(3) or ""
    heading = opens.startswith("#") and (closes == ":" or m.end() == len(line))
    tag = opens.startswith("<") and closes in ("|>", ">") or opens == "[" and closes[:1] == "]" or opens == "**" and "**" in closes
    plain = not opens and closes in (":", ">")
    return (f"{opens[:1]}{closes}", name, m.end()) if heading or tag or plain else None


def marks_of(lines: list[str]) -> list[tuple[int | None, bool, int] | None]:
    """Of each line (its marker's role, whether a role word gives it, where its text begins), or None."""
    found, fenced = [], False
    for line in lines:
        fence = line.lstrip().startswith("```")
        fenced ^= fence
        found.append(None if fence or fenced else marker(line))
    often = Counter(m[:2] for m in found if m)
    # the form and set of words that explain most markers, several roles before one
    best = max(((len({words[n] for f, n in often if f == form and n in words}) > 1, sum(c for (f, n), c in often.items() if f == form and n in words), -i, form) for form in dict.fromkeys(f for f, _ in often) for i, words in enumerate(SETS)), default=None)
    known = SETS[-best[2]] if best and best[1] and (best[0] or best[1] > 1 or len(often) == 1) else {}
    forms = Counter(m[0] for m in found if m and often[m[:2]] > 1)
    form = best[3] if known else max(forms, key=forms.get, default=None)
    # an unknown name speaks only if it recurs; by its first appearance it leans to user, the next to assistant
    names = [] if best and best[0] else [n for n in dict.fromkeys(m[1] for m in found if m and m[0] == form) if n not in known and often[form, n] > 1]
    return [None if not m or m[0] != form or m[1] not in known and m[1] not in names else (known[m[1]], True, m[2]) if m[1] in known else (1 + names.index(m[1]) % 2, False, m[2]) for m in found]


def viterbi(model: Model, emits: list[list[float]], marked: list[bool]) -> list[int]:
    """The likeliest roles of the lines; of equally likely ones the first."""
    score, back = None, []
    steps = {x: model.step(x) for x in (False, True)}
    for e, m in zip(emits, marked, strict=True):
        if score is None:
            score = [s + x for s, x in zip(model.start, e, strict=True)]
            continue
        move = steps[m]
        best = [max(range(3), key=lambda p, r=r: score[p] + move[p][r]) for r in range(3)]
        score = [score[best[r]] + move[best[r]][r] + e[r] for r in range(3)]
        back.append(best)
    path = [max(range(3), key=lambda r: score[r])]
    for best in reversed(back):
        path.append(best[path[-1]])
    return path[::-1]


def parse(transcript: str, model: Model | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    model = model or Model()
    lines = transcript.split("\n")
    marks = marks_of(lines)
    emits = [model.emit(line[m[2] :] if m else line, m and m[0], bool(m and m[1])) for line, m in zip(lines, marks, strict=True)]
    turns: list[tuple[int, list[str]]] = []
    for i, (line, m, r) in enumerate(zip(lines, marks, viterbi(model, emits, [m is not None for m in marks]), strict=True)):
        if not i or m or r != turns[-1][0]:
            turns.append((r, []))
        turns[-1][1].append(line[m[2] :] if m else line)
    return [(ROLES[r], t) for r, ls in turns if (t := "\n".join(ls).strip("\n")) or len(turns) > 1]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


_STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### System:\n", "user": "### Human:\n", "assistant": "### Assistant:\n"},
    {"system": "Context: ", "user": "Q: ", "assistant": "A: "},
    {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    {"system": "", "user": "Marta: ", "assistant": "Dr. Okoye: "},
    {"system": "**System**: ", "user": "**Customer**: ", "assistant": "**Agent**: "},
)
STYLES = 2 * len(_STYLES)


def transcript(turns: list[tuple[str, str]], style: int) -> str:
    """A raw transcript in one of the common styles; those from len(_STYLES) on lose each fifth marker, and have lines that look like markers."""
    style %= STYLES
    marks, hard = _STYLES[style % len(_STYLES)], style >= len(_STYLES)
    out = []
    for i, (r, t) in enumerate(turns):
        out.append(("" if hard and i % 5 == 4 else marks.get(r, f"{r}: ")) + t + ("\nNote: this line is content" if hard and i % 3 == 1 else ""))
    return "\n".join(out)


def format_transcripts(transcripts, model: Model | None = None):
    """transcripts(conv_id, text): the turns recovered, (conv_id, turn, role, text, rendered), a row each."""
    model = model or Model()

    def run(batches):
        begin("chat")
        for b in batches:
            for conv, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = parse(text or "", model)
                r, t = ([x[i] for x in got] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(got), pa.int64()), pa.array(range(len(got)), pa.int64()), pa.array(r, pa.string()), pa.array(t, pa.string()), pa.array([render([x]) for x in got], pa.string())], names=["conv_id", "turn", "role", "text", "rendered"])

    ship(transcripts.sparkSession)
    return transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), "text").mapInArrow(run, "conv_id long, turn long, role string, text string, rendered string")


def format_chats(chats, model: Model | None = None):
    """chats(conv_id, turn, role, text): each conversation as a raw transcript in a style of its own, its roles recovered and compared, and rendered."""
    model = model or Model()
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63)))
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def row(conv, given):
        style = conv or 0
        raw = transcript(given, style)
        got = parse(raw, model)
        # lines of turns that lie at the same place and have the same role
        want = [r for r, t in parse_plain(given, style)]
        have = [r for r, t in got for _ in t.split("\n")]
        agree = sum(a == b for a, b in zip(want, have, strict=False))
        return conv, len(given), len(got), len(want), agree, ",".join(r for r, _ in got), hashlib.sha256(render(got).encode()).hexdigest()

    def batch(done):
        cols = list(zip(*done, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 5 + [pa.string()] * 2, strict=True)], names=["conv_id", "n_turns", "n_parsed", "n_lines", "n_agree", "roles", "rendered_sha256"])

    def run(batches):
        begin("chat")
        at, given, done = None, [], []
        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if given and conv != at:
                    done.append(row(at, given))
                    given = []
                at = conv
                given.append((role, text))
            yield batch(done)
            done = []
        yield batch([row(at, given)] if given else [])

    ship(chats.sparkSession)
    return rows.mapInArrow(run, "conv_id long, n_turns long, n_parsed long, n_lines long, n_agree long, roles string, rendered_sha256 string")


def parse_plain(given: list[tuple[str, str]], style: int) -> list[tuple[str, str]]:
    """The lines that a perfect parse of transcript(given, style) has, each with its role."""
    hard = style % STYLES >= len(_STYLES)
    out = []
    for i, (r, t) in enumerate(given):
        text = t + ("\nNote: this line is content" if hard and i % 3 == 1 else "")
        out += [(r, line) for line in text.strip("\n").split("\n")]
    return out


def op6_chat_format(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations")
    return format_chats(chats, fit(chats))
