"""Column functions on a record's subtree (the array "sub" of sources.shred): attributes, children, descendants, texts. All native, no joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import filled, strip


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def attr(node: Column, *names: str, default: str | None = "") -> Column:
    """The first attribute of these names, else of these names in any case, else the default."""
    found = [node["attrs"][n] for n in names] + [F.coalesce(node["low"], node["attrs"])[n.lower()] for n in names]
    return F.coalesce(*found, *([] if default is None else [F.lit(default)]))


def element(sub: str | Column = "sub") -> Column:
    return F.get(F.col(sub) if isinstance(sub, str) else sub, F.lit(0))


def at(path: str, sub: str = "sub") -> Column:
    """The first child, its first child, and so on along a path of tags; null if there is none."""
    return F.get(F.filter(sub, lambda x: x["first"] & (x["path"] == path)), F.lit(0))


def children(node: Column, *tags: str, sub: str = "sub") -> Column:
    return F.filter(sub, lambda x: (x["p"] == node["i"]) & x["tag"].isin(*tags))


def child(node: Column, *tags: str, sub: str = "sub") -> Column:
    """The node's first child of any of the tags."""
    return F.get(children(node, *tags, sub=sub), F.lit(0))


def descendants(*tags: str, sub: str = "sub") -> Column:
    """All below the record's element, and it itself, in document order."""
    return F.filter(sub, lambda x: x["tag"].isin(*tags))


def below(tag: str, *tags: str, sub: str = "sub") -> Column:
    """All below the element's first child of that tag."""
    return F.coalesce(let(at(tag, sub), lambda n: F.filter(sub, lambda x: (x["top"] == n["i"]) & x["tag"].isin(*tags))), F.filter(sub, lambda x: F.lit(False)))


def text(node: Column) -> Column:
    """The node's own text, stripped; empty if there is none."""
    return F.coalesce(strip(node["text"]), F.lit(""))


def calculation(path: str = "Calculation", sub: str = "sub") -> Column:
    """A calculation's text: that of its first Text child if it isn't empty, else its own; null if empty."""
    return F.coalesce(filled(text(at(f"{path}/Text", sub))), filled(text(at(path, sub))))


def lines(c: Column) -> Column:
    """Non-empty stripped lines."""
    return F.filter(F.transform(F.split(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
