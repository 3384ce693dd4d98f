"""URL filters: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton with boundary checks.

A term counts where no letter or digit of any script stands directly before or after it in the whole url, A-Z lower-cased. One strict term,
or at least SOFT_DISTINCT soft ones whose weights reach SOFT_LIMIT together, block. Urls without "://" have an empty host and path and fit
no rule; a null url has no terms either and is allowed. A term found several times counts once. Repeated rows give repeated rows, an empty
table none; a very long url is matched whole. Other columns are ignored, whatever their names.

Host, path and rule are SQL expressions; only the automaton runs in Python. Vocabularies and rules are parameters.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .common import begin, ship, table

#: (verdict, host, path) as the contract has them.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: The default vocabulary: fixed values, English first, then German, French and Spanish.
STRICT = [
    "casino", "casinos", "porn", "porno", "xxx", "escort", "escorts", "viagra", "cialis", "sportsbook", "camgirls", "hentai", "warez", "keygen", "free-bets", "cheap-pills", "payday-loans", "onlinecasino",
    "gluecksspiel", "spielautomaten", "sportwetten", "machines-a-sous", "paris-sportifs", "tragamonedas", "apuestas-deportivas",
]
SOFT = {
    "win": 1, "bet": 1, "bets": 1, "free": 1, "cheap": 1, "pills": 2, "adult": 2, "sexy": 2, "hot": 1, "poker": 2, "slots": 2, "jackpot": 2, "bonus": 1, "crack": 2, "torrent": 2, "replica": 1, "loan": 1, "loans": 1, "pharmacy": 1, "dating": 1,
    "gewinn": 1, "wetten": 2, "gratis": 1, "billig": 1, "kredit": 1, "erotik": 2, "gagner": 1, "parier": 2, "gratuit": 1, "pilules": 2, "rencontre": 1, "ganar": 1, "apuestas": 2, "barato": 1, "pastillas": 2, "prestamos": 1, "citas": 1,
}
SOFT_LIMIT, SOFT_DISTINCT = 3, 2


def automaton(strict, soft):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t, w in soft.items():
        a.add_word(t, (t, False, w))
    for t in strict:
        a.add_word(t, (t, True, 0))
    a.make_automaton()
    return a


_LOWER = {c: c + 32 for c in range(65, 91)}


def hits(a, url: str) -> tuple[set[str], dict[str, int]]:
    """Distinct strict terms, and soft terms with their weights."""
    text = url.translate(_LOWER)
    strict, soft = set(), {}
    for end, (t, is_strict, w) in a.iter(text):
        first = end - len(t) + 1
        if first and text[first - 1].isalnum() or end + 1 < len(text) and text[end + 1].isalnum():
            continue
        if is_strict:
            strict.add(t)
        else:
            soft[t] = w
    return strict, soft


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rule_sql(rules) -> tuple[str, str]:
    """CASE expressions over host and path: the longest rule that fits, and its verdict."""
    fits = lambda h, p: f"((host = {quote(h)} OR endswith(host, {quote('.' + h)})) AND startswith(path, {quote(p)}))"
    longest = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {quote(value(v, h, p))}" for v, h, p in longest) + " END"
    return case(lambda v, h, p: h + p), case(lambda v, h, p: v)


SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long, soft_weight long"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def judge(pages, strict=tuple(STRICT), soft=None, rules=tuple(RULES)):
    """Host, path, rule and verdict of each row of pages(page_id, url); strict terms, soft terms with weights, rules (verdict, host, path)."""
    soft = SOFT if soft is None else soft
    ship(pages.sparkSession)
    rest = F.when(F.contains("url", F.lit("://")), F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract("rest", "^[^/?#]*", 0)
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url")).withColumn("rest", rest)
    cut = cut.select("page_id", "url", F.translate(host, UPPER, SMALL).alias("host"), F.regexp_extract(F.expr("substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)"), r"^[^?#]*", 0).alias("path"))
    rule, verdict = rule_sql(rules) if rules else ("CAST(NULL AS STRING)", "CAST(NULL AS STRING)")
    known = cut.select("page_id", "url", "host", "path", F.expr(rule).alias("rule"), F.expr(verdict).alias("verdict"))

    def run(batches):
        begin("urls")
        a = automaton(strict, soft)
        for b in batches:
            found = [hits(a, u) for u in b.column(1).to_pylist()]
            counts = [len(x) for x, _ in found], [len(y) for _, y in found], [sum(y.values()) for _, y in found]
            method = ["block" if x or y >= SOFT_DISTINCT and w >= SOFT_LIMIT else "allow" for x, y, w in zip(*counts, strict=True)]
            given = pc.coalesce(b.column(5), pa.array(method, b.column(5).type))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), given, *(pa.array(c, pa.int64()) for c in counts)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return known.mapInArrow(run, SCHEMA)


def op8_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    rule, verdict = (x.replace("endswith(", "ends_with(").replace("startswith(", "starts_with(") for x in rule_sql(RULES))
    has = lambda t: f"CAST(regexp_matches(low, {quote('(^|[^\\p{L}\\p{N}])' + t + '($|[^\\p{L}\\p{N}])')}) AS BIGINT)"
    strict, soft = " + ".join(map(has, STRICT)), " + ".join(map(has, SOFT))
    weight = " + ".join(f"{w} * {has(t)}" for t, w in SOFT.items())
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(url, '{UPPER}', '{SMALL}') AS low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{SMALL}') AS host,
  regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM a),
c AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS given, {strict} AS n_strict, {soft} AS n_soft, {weight} AS soft_weight FROM b)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN n_strict > 0 OR (n_soft >= {SOFT_DISTINCT} AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft, soft_weight FROM c"""


SQL = {"op8_url_filter": _sql()}
