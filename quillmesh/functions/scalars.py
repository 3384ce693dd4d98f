"""Column functions that the design pipeline and the catalogue share: names, document ids, paths, links, coercions. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c) -> Column:
    """White space of any script cut from both ends; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def filled(c: Column) -> Column:
    """Null for the empty string, which lookups treat as missing."""
    return F.when(c != "", c)


def safe_slug(c: Column) -> Column:
    clean = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_")
    return F.coalesce(filled(F.regexp_replace(F.regexp_replace(clean, r"^[. ]+", ""), r"[. ]+$", "")), F.lit("_"))


def folder_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), strip), lambda x: x != "")


def doc_id(kind: str, *parts) -> Column:
    """kind:a::b::...; null if any part is."""
    out = [F.lit(kind + ":")]
    for i, p in enumerate(parts):
        out += [F.lit("::")] * (i > 0) + [F.col(p) if isinstance(p, str) else p]
    return F.concat(*out)


def numbered(kind: str, owner: Column, n: Column) -> Column:
    """kind:owner:0001, the number widened if it needs more digits."""
    return F.concat(F.lit(kind + ":"), owner, F.lit(":"), F.format_string("%04d", n))


def relative_path(source: Column, target: Column) -> Column:
    """POSIX path from the page source to the page target, over their common folders."""
    a, b = F.split(source, "/"), F.split(target, "/")
    folders = F.size(a) - 1
    shared = F.aggregate(F.sequence(F.lit(0), F.greatest(folders, F.lit(1)) - 1), F.lit(0), lambda n, i: F.when((n == i) & (i < folders) & (i < F.size(b) - 1) & (F.get(a, i) == F.get(b, i)), n + 1).otherwise(n))
    return F.concat_ws("/", F.array_repeat(F.lit(".."), folders - shared), F.slice(b, shared + 1, F.size(b)))


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\[\]])", r"\\$1")


def md_link(title: Column, href: Column) -> Column:
    return F.when(href.isNull(), title).otherwise(F.concat(F.lit("["), escape(title), F.lit("]("), href, F.lit(")")))


def iso_minute(c: Column) -> Column:
    """ISO time as "YYYY-MM-DD HH:MM UTC"; what can't be read stays as it is, empty is null."""
    return F.coalesce(F.date_format(F.try_to_timestamp(filled(c)), "yyyy-MM-dd HH:mm 'UTC'"), filled(c))


def is_true(c: Column) -> Column:
    """Exactly "True"."""
    return F.coalesce(c == "True", F.lit(False))


def not_off(c: Column, default: str) -> Column:
    """Anything but false, 0, no in any case; missing is default, and empty counts as on."""
    return ~F.lower(F.coalesce(c, F.lit(default))).isin("false", "0", "no")


def indexed(c: Column) -> Column:
    return ~F.lower(F.coalesce(c, F.lit(""))).isin("", "none", "false")


def whole_number(c: Column, default) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def shorten(c: Column, n: int, leeway: int = 5) -> Column:
    """At most n characters, cut at a word, with dots; texts longer by no more than the leeway stay whole."""
    cut = F.substring(c, 1, n - 3)
    return F.when(F.length(c) <= n + leeway, c).otherwise(F.concat(F.regexp_replace(cut, r"(?s)^(.*) [^ ]*$", "$1"), F.lit("...")))


FIELD_REF = r"([A-Za-z_][A-Za-z0-9_ ]*)::([A-Za-z_][A-Za-z0-9_ ]*)"
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("


def field_refs(c: Column) -> Column:
    """Array of (table, field) named in a calculation."""
    return F.arrays_zip(F.transform(F.regexp_extract_all(c, F.lit(FIELD_REF), 1), strip).alias("table"), F.transform(F.regexp_extract_all(c, F.lit(FIELD_REF), 2), strip).alias("field"))


def calls(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(CALL), 1))
