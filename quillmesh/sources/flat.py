"""Records of the kinds that make up most of an export, as the values that are read of them instead of their subtrees.

A value is an attribute, a text or a place of one node. FLAT says which; values() reads them where a file is parsed, plans.model reads the
same ones of a record's subtree. What a kind has any number of is a list of lists of texts beside them (LISTS).
"""

from __future__ import annotations

#: What is read of a node besides attributes: its text, xpath and tag, and whether it is there.
TEXT, XPATH, TAG, HERE = "#text", "#xpath", "#tag", "#here"
_FR, _TR = "Field/FieldReference", "Field/FieldReference/TableOccurrenceReference"
_ID, _NAME = ("id", "ID"), ("name", "Name")
_BASE = {"id": ("", *_ID), "name": ("", *_NAME), "xpath": ("", XPATH)}
_UUID = {"uuid": ("", "uuid", "UUID"), "uuidText": ("UUID", TEXT)}
_LEGACY = "FieldObj|Field/Name"
_CREATE, _DELETE, _SORT = ("allowCreateRelatedRecords", "createRelated"), ("deleteRelatedRecords", "deleteRelated"), ("sortRelatedRecords", "sortRelated")
_SIDE = lambda p: {f"{p[0]}Id": (p, *_ID), f"{p[0]}Name": (p, *_NAME), f"{p[0]}RefId": (f"{p}/TableOccurrenceReference", *_ID), f"{p[0]}RefName": (f"{p}/TableOccurrenceReference", *_NAME)}
#: Kind: value: the node's path of first children (a|b is the first child of either tag; ^ the first node above), and names of the attribute, tried in this order.
FLAT = {
    "tableOccurrence": {**_BASE, **_UUID, "base": ("", "baseTableID", "baseTableId", "tableID"), "baseRef": ("BaseTableSourceReference/BaseTableReference", *_ID)},
    "relationship": {
        **_BASE, **_SIDE("LeftTable"), **_SIDE("RightTable"), "options": ("Options", HERE), "create": ("Options", *_CREATE), "delete": ("Options", *_DELETE), "sort": ("Options", *_SORT),
        "ownCreate": ("", *_CREATE), "ownDelete": ("", *_DELETE), "ownSort": ("", *_SORT),
    },
    "layout": {
        **_BASE, **_UUID, "toId": ("", "tableOccurrenceID", "tableOccurrenceId", "tableID"), "toName": ("", "tableOccurrenceName", "tableName"), "refId": ("TableOccurrenceReference", *_ID), "refName": ("TableOccurrenceReference", *_NAME),
        "theme": ("", "theme", "Theme"), "themeName": ("LayoutThemeReference", *_NAME),
    },
    "layoutObject": {
        **_BASE, **_UUID, "tag": ("", TAG), "type": ("", "type", "Type"), "kindOf": ("", "kind", "Kind"), "partType": ("^", "type", "Type"), "partKind": ("^", "kind", "Kind"),
        "placed": (_FR, HERE), "placedName": (_FR, *_NAME), "toName": (_TR, *_NAME), "toId": (_TR, *_ID), "data": ("Text/StyledText/Data", TEXT), "ownText": ("Text", TEXT), **{k: ("Bounds", k, k.capitalize()) for k in ("top", "left", "bottom", "right")},
        "legacy": (_LEGACY, HERE), "legacyField": (_LEGACY, "field", "Field", *_NAME), "legacyTable": (_LEGACY, "table", "Table", "tableName"), "legacyId": (_LEGACY, "tableID", "TableId"),
    },
    "script": {**_BASE, **_UUID},
    "step": {
        "id": ("", *_ID), "name": ("", *_NAME), "index": ("", "index", "Index"), "enable": ("", "enable", "Enable", "enabled", "Enabled"), "layout": ("Layout", HERE), "layoutName": ("Layout", *_NAME),
        "script": ("Script", HERE), "scriptName": ("Script", *_NAME), "calculation": ("Calculation", TEXT),
    },
    "stepSet": {"id": ("^", *_ID)},
}
#: Values of the kind that has most.
WIDTH = max(map(len, FLAT.values()))


def _named(keys: tuple[str, ...], names: tuple[str, ...]) -> str | None:
    """The first of these names among attributes, else the first in any case."""
    low = {k.lower(): k for k in keys}
    return next((n for n in names if n in keys), None) or next((low[n.lower()] for n in names if n.lower() in low), None)


def attribute(t, e, names: tuple[str, ...]) -> str | None:
    """The first attribute of these names, else of these names in any case."""
    held = dict(t.attrs(e))
    for n in names:
        if n in held:
            return held[n]
    k = _named(tuple(held), names)
    return None if k is None else held[k]


def first(e, *tags: str):
    if e is not None:
        for c in e:
            if c.tag in tags:
                return c
    return None


def _predicates(t, e, above, stop) -> list[list[str]]:
    def found(x):
        for c in x:
            if c.tag not in stop:
                if c.tag == "JoinPredicate":
                    yield c
                yield from found(c)

    def end(p, tag: str) -> list[str]:
        if (w := first(p, tag)) is None:
            return ["", ""]
        ref = first(w, "FieldReference")
        of = lambda x, *names: "" if x is None else attribute(t, x, names) or ""
        return [of(w, *_NAME) or of(ref, *_NAME), of(w, "tableName", "table") or of(first(ref, "TableOccurrenceReference"), *_NAME)]

    held = first(e, "JoinPredicateList")
    return [] if held is None else [[attribute(t, p, ("fieldCompareOp", "operator", "op", "type")) or "0", *end(p, "LeftField"), *end(p, "RightField")] for p in found(held)]


#: Kind: lists of texts of a record: predicates with operator, field and table on the left, on the right; tables and fields that a step names; names of folders.
LISTS = {
    "relationship": _predicates,
    "step": lambda t, e, above, stop: [[attribute(t, f, ("table", "Table", "tableName")) or "", attribute(t, f, _NAME) or ""] for f in e.iter("Field")],
    "script": lambda t, e, above, stop: [[attribute(t, f, _NAME) or ""] for f in above],
}


class _Want:
    """What is read of a node: (place, what) of itself, (place, names) of attributes, and the same of children by tag. known: places and attributes by the names of all that a node has, since these repeat."""

    def __init__(self):
        self.special, self.attrs, self.kids, self.known = [], [], {}, {}

    def add(self, place: int, what: tuple[str, ...]) -> None:
        if what[0][0] == "#":
            self.special.append((place, what[0]))
        else:
            self.attrs.append((place, what))

    def read(self, t, x, out: list) -> None:
        if self.attrs:
            items = dict(t.attrs(x)) if t.spaced else x.attrib
            keys = tuple(items)
            found = self.known.get(keys)
            if found is None:
                found = [(i, k) for i, names in self.attrs if (k := _named(keys, names)) is not None]
                if len(self.known) < 1000:
                    self.known[keys] = found
            for i, k in found:
                out[i] = items[k]
        for i, what in self.special:
            out[i] = x.text if what == TEXT else "" if what == HERE else x.tag if what == TAG else t.path(x)
        if kids := self.kids:
            seen = ()
            for c in x:
                tag = c.tag
                if tag in kids and tag not in seen:
                    kids[tag].read(t, c, out)
                    seen += (tag,)


def _plan(kind: str) -> tuple[int, _Want, _Want | None, list]:
    """Of a kind: how many values, what to read of the element, of the one above it, and of nodes whose way has a choice."""
    own, above, choices = _Want(), _Want(), {}
    for i, (path, *what) in enumerate(FLAT[kind].values()):
        if path == "^":
            node = above
        elif "|" in path:
            node = choices.setdefault(tuple(tuple(s.split("|")) for s in path.split("/")), _Want())
        else:
            node = own
            for tag in path.split("/") if path else ():
                node = node.kids.setdefault(tag, _Want())
        node.add(i, tuple(what))
    return len(FLAT[kind]), own, above if above.attrs else None, list(choices.items())


_PLANS = {k: _plan(k) for k in FLAT}


def values(t, kind: str, e, above: list) -> list[str | None]:
    """A record's values in the order of FLAT."""
    n, own, over, choices = _PLANS[kind]
    out = [None] * n
    own.read(t, e, out)
    if over is not None and above:
        over.read(t, above[0], out)
    for way, want in choices:
        x = e
        for tags in way:
            if (x := first(x, *tags)) is None:
                break
        else:
            want.read(t, x, out)
    return out
