"""The scan of design exports: binary files to records, one row for each catalog element with its subtree as an array.

XML can only be read in order, so one file is one shredding task and many files scale out. Everything after this is DataFrame expressions:
a record carries all that belongs to it, so an extractor is a projection without a join. Columns:

file, kind, ord (place in the file's document order), owner (ord of the owning record), idx (place among the owner's records),
above (nodes that tell whose it is: the table of a field, the part of an object, the folders of a script, the script of a step), sub (the
element and its descendants; path is relative to it, first tells that the node and all above it are the first of their tag among siblings).

A file that cannot be read gives a record of kind "file" with a warning and nothing else; so does null or empty content. A file is one
binary value, of 2 GB at most.
"""

from __future__ import annotations

import gc
import io
import re
import threading
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping
from datetime import UTC, datetime
from itertools import accumulate, chain

import pyarrow as pa
import pyexpat

from ..ship import ship
from .flat import FLAT, LISTS, WIDTH, values

NODE = "struct<i:int,p:int,top:int,tag:string,path:string,first:boolean,attrs:map<string,string>,low:map<string,string>,text:string,xpath:string>"
SCHEMA = f"file string, modified timestamp, kind string, ord int, owner int, idx int, above array<{NODE}>, sub array<{NODE}>"
_NODE = pa.struct([
    ("i", pa.int32()), ("p", pa.int32()), ("top", pa.int32()), ("tag", pa.string()), ("path", pa.string()), ("first", pa.bool_()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("low", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("xpath", pa.string()),
])
#: Columns of flat records: values, and lists of texts.
VALUES = [f"v{i}" for i in range(WIDTH)]
FLAT_SCHEMA = ", ".join(f"{v} string" for v in VALUES) + ", more array<array<string>>"
_MORE = pa.list_(pa.list_(pa.string()))
#: Content that nothing reads and that may be very large (images).
SKIPPED = {"StreamList"}
#: Records, and nodes in them, after which a batch is sent to the JVM.
BATCH, BATCH_NODES = 2000, 50_000


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


class Tree:
    """A parsed file: places in document order, and paths. What is asked of few elements is made when it is first asked for."""

    def __init__(self, content: bytes, kinds: frozenset[str] | None = None):
        lean = None if kinds is None else _lean(content, kinds)
        self.root, self._left_out = (_parse(content), {}) if lean is None else lean
        every = list(self.root.iter())
        self.spaced = any(k[0] == "{" for k in set(chain.from_iterable(map(ET.Element.keys, every))))
        if any(tag[0] == "{" for tag in {e.tag for e in every}):
            for e in every:
                e.tag = local(e.tag)
        self._every = every
        self._at: dict[ET.Element, int] = {}
        self._up: dict[ET.Element, ET.Element] = {}
        self._path: dict[ET.Element, str] = {}

    def at(self, e: ET.Element) -> int:
        if not self._at:
            i = 0
            for x in self._every:
                self._at[x] = i
                i += 1
                if x in self._left_out:  # elements that were left out have places too
                    i += self._left_out[x].count(b"<") - self._left_out[x].count(b"</")
        return self._at[e]

    def path(self, e: ET.Element) -> str:
        if not self._up:
            self._up = {c: x for x in self._every for c in x}
        if (known := self._path.get(self._up.get(e))) is not None:
            return f"{known}/{e.tag}"
        known, way, x = self._path, [e.tag], self._up.get(e)
        above = x
        while x is not None and x not in known:
            way.append(x.tag)
            x = self._up.get(x)
        path = "/".join(["" if x is None else known[x], *reversed(way)])
        if above is not None:
            known[above] = path[: len(path) - len(e.tag) - 1]
        return path

    def attrs(self, e: ET.Element):
        return list({local(k): v for k, v in e.items()}.items()) if self.spaced else e.items()

    def node(self, e: ET.Element) -> tuple:
        """An element by itself, in the order of NODE's columns without low."""
        return (0, -1, 0, e.tag, "", True, self.attrs(e), e.text, self.path(e))

    def subtree(self, e: ET.Element, stop: frozenset[str]) -> list[tuple]:
        """e and its descendants in document order, without elements whose tag is in stop. Only e has an xpath: those of the others follow from it."""
        attrs = self.attrs if self.spaced else ET.Element.items
        out, stack, xpath = [], [(e, -1, 0, "", True)], self.path(e)
        while stack:
            x, p, top, path, first = stack.pop()
            i = len(out)
            out.append((i, p, top or i, x.tag, path, first, attrs(x), x.text, xpath))
            xpath = None
            if not len(x):
                continue
            seen: set[str] = set()
            kids = []
            for c in x:
                tag = c.tag
                if tag not in stop:
                    kids.append((c, i, top or i, f"{path}/{tag}" if path else tag, first and tag not in seen))
                    seen.add(tag)
            kids.reverse()
            stack += kids
        return out


def _parse(content: bytes) -> ET.Element:
    """The root; a content that may hold skipped elements is read event by event, so that these never pile up."""
    if not any(t.encode(code) in content for t in SKIPPED for code in ("utf-8", "utf-16-le")):
        parser = ET.XMLParser()
        parser.feed(content)
        root = parser.close()
        if any(local(t) in SKIPPED for t in {x.tag for x in root.iter()}):
            for e in [x for x in root.iter() if local(x.tag) in SKIPPED]:
                e.clear()
        return root
    for _, e in (events := ET.iterparse(io.BytesIO(content), events=("end",))):
        if local(e.tag) in SKIPPED:
            e.clear()
    return events.root


#: Catalogs and the kinds that are read from them, those that may be large first.
CUT = {
    b"LayoutCatalog": {"layout", "layoutObject"}, b"ScriptCatalog": {"script", "step"}, b"StepsForScripts": {"stepSet", "step"}, b"RelationshipCatalog": {"relationship"}, b"TableOccurrenceCatalog": {"tableOccurrence"},
    b"FieldsForTables": {"field"}, b"TableCatalog": {"table", "field"}, b"CustomFunctionCatalog": {"customFunction"}, b"CustomFunctionsCatalog": {"customFunction"}, b"CalcsForCustomFunctions": {"customFunctionCalc"},
    b"ValueListCatalog": {"valueList"}, b"OptionsForValueLists": {"valueListOptions"}, b"AccountsCatalog": {"account"}, b"CustomMenuCatalog": {"customMenu"}, b"ExtendedPrivilegesCatalog": {"extPriv"}, b"ThemeCatalog": {"theme"},
}
_DECLARED = re.compile(rb"""<\?xml\s+version\s*=\s*["']1\.0["'](?:\s+encoding\s*=\s*["'][Uu][Tt][Ff]-8["'])?\s*\?>""")
_ATTRIBUTES = re.compile(rb"""(?:\s+[^\s=<>"'/]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*(/?)>""")
_DELIMITERS = b" \t\r\n/>"


def _holds(content: bytes, two: bytes, start: int = 0) -> bool:
    """Whether two bytes stand side by side; the second one is looked for first, since the first is everywhere."""
    return content.find(two[1:], start) >= 0 and content.find(two, start) >= 0


def _lean(content: bytes, kinds: frozenset[str]) -> tuple[ET.Element, dict[ET.Element, bytes]] | None:
    """The root of a file, where catalogs that these kinds aren't read from are empty, and what each lacks. What is left out is read
    through too, but nothing is built of it. None where that can't be told from the bytes alone, and where anything is wrong with the file."""
    cut = [t for t, of in CUT.items() if kinds.isdisjoint(of)]
    declared = _DECLARED.match(content)
    # a start tag is one wherever it stands only without comments, sections and declarations; these may hold anything
    if not cut or _holds(content, b"<!") or _holds(content, b"<?", declared.end() if declared else 0) or any(t.encode() in content for t in SKIPPED):
        return None
    found: dict[str, list[bytes]] = {}
    for tag in cut:
        begin, end, at, pieces = b"<" + tag, b"</" + tag, 0, []
        while (i := content.find(begin, at)) >= 0:
            start = i + len(begin)
            if content[start : start + 1] not in _DELIMITERS:  # another name that begins so
                pieces.append(content[at:start])
                at = start
                continue
            if not (m := _ATTRIBUTES.match(content, start)):
                return None
            pieces.append(content[at : m.end()])
            at = m.end()
            if m[1]:
                found.setdefault(tag.decode(), []).append(b"")
                continue
            j = content.find(end, at)
            if j < 0 or content.find(begin, at, j) >= 0:
                return None
            inner = content[at:j]
            try:
                parser = pyexpat.ParserCreate(namespace_separator="}")
                parser.Parse(b"<x>", False)
                parser.Parse(inner, False)
                parser.Parse(b"</x>", True)
            except pyexpat.ExpatError:
                return None
            found.setdefault(tag.decode(), []).append(inner)
            at = j
        if pieces:
            content = b"".join((*pieces, content[at:]))
    try:
        root = _parse(content)
    except (ET.ParseError, ValueError, LookupError):
        return None
    # they are what they seem only where they are looked for
    outer = child(root, "Structure" if _is_v2(root) else "File")
    top = child(outer, "AddAction") if _is_v2(root) else child(root if outer is None else outer, "Database")
    held = [e for x in (top, *kids(top, "RelationshipGraph")) if x is not None for e in x if e.tag in found]
    if len(held) != sum(map(len, found.values())):
        return None
    left_out, told = {}, {t: iter(n) for t, n in found.items()}
    for e in root.iter():
        if e.tag in told:
            left_out[e] = next(told[e.tag])
    return root, left_out


def child(e: ET.Element | None, *tags: str) -> ET.Element | None:
    return None if e is None else next((c for c in e if c.tag in tags), None)


def kids(e: ET.Element | None, tag: str) -> list[ET.Element]:
    return [] if e is None else [c for c in e if c.tag == tag]


def inside(e: ET.Element | None, *tags: str) -> Iterator[ET.Element]:
    return iter(()) if e is None else (x for x in e.iter() if x.tag in tags)


#: Kinds that are simply all elements of some tags in the first catalog of some tags: (kind, catalogs, elements).
CATALOGS = (
    ("tableOccurrence", ("TableOccurrenceCatalog",), ("TableOccurrence",)),
    ("relationship", ("RelationshipCatalog",), ("Relationship",)),
    ("valueList", ("ValueListCatalog",), ("ValueList",)),
    ("privilegeSet", ("PrivilegeSetsCatalog", "PrivilegesCatalog", "PrivilegeSetCatalog", "AccountCatalog"), ("PrivilegeSet", "Privilege")),
    ("account", ("AccountsCatalog",), ("Account",)),
    ("extPriv", ("ExtendedPrivilegesCatalog",), ("ExtendedPrivilege",)),
    ("customMenu", ("CustomMenuCatalog",), ("CustomMenu",)),
    ("customMenuSet", ("CustomMenuSetsCatalog",), ("CustomMenuSet",)),
    ("theme", ("ThemeCatalog",), ("Theme",)),
    ("fileRef", ("FileAccessCatalog",), ("Authorization",)),
)
IN_GRAPH = {"tableOccurrence", "relationship"}
OBJECTS = frozenset(("LayoutObject", "Object", "ObjectList"))
FOLDERS = ("ScriptFolder", "Folder", "Group")


def _is_v2(root: ET.Element) -> bool:
    return root.tag == "FMSaveAsXML" and bool(root.get("File") or root.get("file") or (root.get("version") or root.get("Version") or "").startswith("2."))


def records(content: bytes, kinds: frozenset[str] | None = None, flat: bool = False) -> Iterator[dict | tuple]:
    """The records of one file; of the kinds asked for, if any are named. flat: those of FLAT are (kind, ord, owner, idx, more, values ...)."""
    want = (lambda *k: True) if kinds is None else lambda *k: not kinds.isdisjoint(k)
    try:
        t = Tree(content or b"", kinds)
    except (ET.ParseError, ValueError, LookupError) as e:
        if want("file"):
            yield {"kind": "file", "ord": 0, "above": [], "sub": [], "warning": f"XML parse error: {e}"}
        return
    root, v2 = t.root, _is_v2(t.root)
    outer = child(root, "Structure" if v2 else "File")
    if v2:
        top, lacking = child(outer, "AddAction"), "v2: Could not find <AddAction> element." if outer is not None else "v2: Could not find <Structure> element."
    else:
        top, lacking = child(root if outer is None else outer, "Database"), "Could not find <Database> element. XML structure may be unexpected."
    if want("file"):
        above = [t.node(x) for x in (child(root, "Product"), outer, top) if x is not None]
        yield {"kind": "file", "ord": 0, "above": above, "sub": [t.node(root)], "warning": lacking if top is None else None}
    if top is None:
        return

    def row(kind: str, e: ET.Element, stop: frozenset[str] = frozenset(), owner: ET.Element | None = None, idx: int = 0, above=()) -> dict | tuple:
        if flat and kind in FLAT:
            above = [x for x in above if x is not None]
            return (kind, t.at(e), None if owner is None else t.at(owner), idx, LISTS[kind](t, e, above, stop) if kind in LISTS else None, *values(t, kind, e, above))
        return {"kind": kind, "ord": t.at(e), "owner": None if owner is None else t.at(owner), "idx": idx, "above": [t.node(x) for x in above if x is not None], "sub": t.subtree(e, stop)}

    def catalog(*tags: str, graph: bool = False) -> ET.Element | None:
        c = child(top, *tags)
        return child(child(top, "RelationshipGraph"), *tags) if c is None and graph else c

    tables = catalog("TableCatalog", "BaseTableCatalog")
    if want("table"):
        for e in inside(tables, "BaseTable"):
            yield row("table", e, frozenset(("FieldCatalog", "BaseTable")))
    side = catalog("FieldsForTables")
    if not want("field"):
        pass
    elif side is not None:
        for c in kids(side, "FieldCatalog"):
            for e in kids(child(c, "ObjectList"), "Field"):
                yield row("field", e, above=(child(c, "BaseTableReference"),))
    else:
        for b in inside(tables, "BaseTable"):
            for e in inside(child(b, "FieldCatalog"), "Field", "BaseField"):
                yield row("field", e, above=(b,))
    for kind, tags, elements in CATALOGS:
        if want(kind):
            for e in inside(catalog(*tags, graph=kind in IN_GRAPH), *elements):
                yield row(kind, e, frozenset(elements))
    if want("valueListOptions"):
        for c in kids(catalog("OptionsForValueLists"), "ValueList"):
            yield row("valueListOptions", c)
    if want("layout", "layoutObject"):
        for layout in inside(catalog("LayoutCatalog"), "Layout"):
            if want("layout"):
                yield row("layout", layout, frozenset(("PartsList", "Object", "Layout")))
            if want("layoutObject"):
                found = [(p, e) for p in kids(child(layout, "PartsList"), "Part") for e in kids(child(p, "ObjectList"), "LayoutObject")]
                found = found or [(None, e) for e in inside(layout, "Object")]
                for n, (p, e) in enumerate(found):
                    yield row("layoutObject", e, OBJECTS, layout, n, (p,))
    scripts = catalog("ScriptCatalog") if want("script", "step") else None
    stack = [] if scripts is None else [(c, ()) for c in reversed(scripts)]
    while stack:
        e, folders = stack.pop()
        if e.tag in FOLDERS:
            stack += [(c, (*folders, e)) for c in reversed(e)]
        elif e.tag == "Script":
            if want("script"):
                yield row("script", e, frozenset(("StepList",)), above=folders)
            if want("step"):
                for n, s in enumerate(inside(child(e, "StepList"), "Step")):
                    yield row("step", s, owner=e, idx=n)
    for w in inside(catalog("StepsForScripts"), "Script") if want("stepSet", "step") else ():
        if (ref := child(w, "ScriptReference")) is not None:
            if want("stepSet"):
                yield row("stepSet", w, frozenset(("ObjectList",)), above=(ref,))
            if want("step"):
                for n, s in enumerate(inside(child(w, "ObjectList"), "Step")):
                    yield row("step", s, owner=w, idx=n)
    functions = catalog("CustomFunctionCatalog", "CustomFunctionsCatalog")
    if want("customFunction"):
        for e in kids(child(functions, "ObjectList"), "CustomFunction") or inside(functions, "CustomFunction"):
            yield row("customFunction", e, frozenset(("CustomFunction",)))
    if want("customFunctionCalc"):
        for held in kids(catalog("CalcsForCustomFunctions"), "ObjectList"):
            for e in kids(held, "CustomFunctionCalc"):
                yield row("customFunctionCalc", e)


def _starts(sizes) -> list[int]:
    return [0, *accumulate(sizes)]


def _nodes(lists: list[list[tuple]]) -> pa.Array:
    """Lists of nodes, column by column. low is null where no name has a capital: it would be attrs again."""
    flat = [n for nodes_ in lists for n in nodes_]
    if not flat:
        return pa.array(lists, pa.list_(_NODE))
    i, p, top, tag, path, first, attrs, text, xpath = zip(*flat)
    pairs = [x for a in attrs for x in a]
    low, at = [], []
    for a in attrs:
        odd = False
        for k, _ in a:
            if k != k.lower():
                odd = True
                break
        at.append(len(low) if odd else None)
        if odd:
            low += {k.lower(): v for k, v in a}.items()
    at.append(len(low))
    named = lambda offsets, xs: pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([k for k, _ in xs], pa.string()), pa.array([v for _, v in xs], pa.string()))
    columns = [
        pa.array(i, pa.int32()), pa.array(p, pa.int32()), pa.array(top, pa.int32()), pa.array(tag, pa.string()), pa.array(path, pa.string()), pa.array(first, pa.bool_()),
        named(_starts(map(len, attrs)), pairs), named(at, low), pa.array(text, pa.string()), pa.array(xpath, pa.string()),
    ]
    return pa.ListArray.from_arrays(pa.array(_starts(map(len, lists)), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_NODE)))


def shred(files, kinds=None, texts=None, flat=False):
    """files(path, modificationTime, content) as Spark's binaryFile reader gives them, to records, of the kinds asked for, if any are named. texts: makes batches of these columns of files' own.
    flat: records of FLAT's kinds have no nodes, but the columns v0, v1, ... in its order, and more."""
    kinds = None if kinds is None else frozenset(kinds)
    plain = (("file", pa.string()), ("modified", pa.timestamp("us", tz="UTC")), ("kind", pa.string()), ("ord", pa.int32()), ("owner", pa.int32()), ("idx", pa.int32()))

    def batch(out: list[dict]) -> pa.RecordBatch:
        columns = {n: pa.array([r.get(n) for r in out], t) for n, t in plain}
        for n in ("above", "sub"):
            columns[n] = _nodes([r[n] for r in out])
        columns["warning"] = pa.array([r.get("warning") for r in out], pa.string())
        none = pa.nulls(len(out), pa.string())
        return pa.RecordBatch.from_pydict(columns | ({v: none for v in VALUES} | {"more": pa.nulls(len(out), _MORE)} if flat else {}))

    def flat_batch(rows: list[tuple]) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.string())
        file, modified, kind, ord_, owner, idx, more, *read = zip(*rows)
        columns = {n: pa.array(x, t) for (n, t), x in zip(plain, (file, modified, kind, ord_, owner, idx), strict=True)} | {n: pa.nulls(len(rows), pa.list_(_NODE)) for n in ("above", "sub")} | {"warning": none}
        read = [pa.array(x, pa.string()) for x in read]
        return pa.RecordBatch.from_pydict(columns | dict(zip(VALUES, read + [none] * (WIDTH - len(read)), strict=True)) | {"more": pa.array(more, _MORE)})

    def run(batches):
        gc.disable()  # nothing here refers to itself, and the collector would go through all nodes held again and again
        try:
            yield from pieces(batches)
        finally:
            gc.enable()

    def pieces(batches):
        out, size, flats = [], 0, {}
        for b in batches if texts is None else texts(batches):
            for path, modified, content in zip(*(b.column(n) for n in ("path", "modificationTime", "content")), strict=True):
                file = (path.as_py(), modified.value if flat else None)
                of = {"file": path.as_py(), "modified": modified.as_py(), "idx": 0}
                for r in records(content.as_py(), kinds, flat):
                    if type(r) is tuple:  # a batch holds one kind
                        held = flats.setdefault(r[0], [])
                        held.append(file + r)
                        if len(held) == BATCH:
                            yield flat_batch(held)
                            held.clear()
                        continue
                    out.append(of | r)
                    size += len(r["sub"]) + len(r["above"])
                    if len(out) == BATCH or size >= BATCH_NODES:
                        yield batch(out)
                        out, size = [], 0
        if out:
            yield batch(out)
        for held in flats.values():
            if held:
                yield flat_batch(held)

    ship(files.sparkSession)
    return (files if texts else files.select("path", "modificationTime", "content")).mapInArrow(run, SCHEMA + ", warning string" + (f", {FLAT_SCHEMA}" if flat else ""))


#: Kinds that make up most of an export, each set a table of its own: what reads other kinds doesn't read past them.
LARGE = (frozenset(("layout", "layoutObject")), frozenset(("script", "step", "stepSet")))


class Records(Mapping):
    """Records by kind, flat where they can be. Kinds that are asked for together are shredded in one pass, large ones apart unless all sets of them are asked for; files, a function, is asked again for kinds that are asked for later; texts as in shred."""

    def __init__(self, files, store, texts=None):
        self.files, self.store, self.texts, self.of, self.lock = files, store, texts, {}, threading.RLock()

    def want(self, *kinds: str) -> Records:
        with self.lock:
            new = frozenset(kinds) - self.of.keys()
            sets = [s for s in (*[new & g for g in LARGE], new.difference(*LARGE)) if s]
            # then files are parsed whole anyway, and once is enough
            sets = [new] if all(new & g for g in LARGE) else sets
            made = self.store.keep_all({f"records/{min(s)}": shred(self.files(), s, self.texts, flat=True) for s in sets}, apart="kind") if sets else {}
            self.of |= {k: made[f"records/{min(s)}"] for s in sets for k in s}
        return self

    def __getitem__(self, kind: str):
        return self.want(kind).of[kind]

    def __iter__(self):
        return iter(self.of)

    def __len__(self) -> int:
        return len(self.of)


def empty_files(spark, path: str, pattern: str):
    """Files of no bytes below path, which Spark's binary reader leaves out: (path, modificationTime, content)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, found = jvm.org.apache.hadoop.fs.Path(path), []
    fs, fits = at.getFileSystem(conf), jvm.org.apache.hadoop.fs.GlobFilter(pattern)
    for status in fs.globStatus(at) or []:
        if status.isFile():
            found += [status] if status.getLen() == 0 else []
            continue
        every = fs.listFiles(status.getPath(), True)
        while every.hasNext():
            x = every.next()
            if x.getLen() == 0 and fits.accept(x.getPath()):
                found.append(x)
    rows = [(x.getPath().toString(), datetime.fromtimestamp(x.getModificationTime() / 1000, UTC), bytearray()) for x in found]
    return spark.createDataFrame(rows, "path string, modificationTime timestamp, content binary")


def read_exports(spark, path: str, pattern: str = "*.xml"):
    """All files below path (a file, a folder or a glob) as records."""
    reader = spark.read.format("binaryFile")
    files = (reader if path.endswith(".xml") else reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")).load(path)
    return shred(files.select("path", "modificationTime", "content").unionByName(empty_files(spark, path, pattern)))


def nodes(records_):
    """The records' elements as rows (file, kind, ord, pre, post, parent, tag, path, attrs, text, xpath): descendants of x are those with x.pre < pre <= x.post."""
    from pyspark.sql import functions as F

    x = records_.select("file", "kind", "ord", F.explode("sub").alias("x"), "sub")
    # the subtree ends before the next element that isn't deeper
    depth = lambda p: F.when(p == "", 0).otherwise(F.size(F.split(p, "/")))
    after = F.filter("sub", lambda y: (y.i > F.col("x.i")) & (depth(y.path) <= depth(F.col("x.path"))))
    end = F.coalesce(F.get(after, F.lit(0))["i"], F.size("sub")) - 1
    xpath = F.concat_ws("/", F.get("sub", F.lit(0))["xpath"], F.nullif("x.path", F.lit("")))
    return x.select("file", "kind", "ord", F.col("x.i").alias("pre"), end.alias("post"), F.col("x.p").alias("parent"), "x.tag", "x.path", "x.attrs", "x.text", xpath.alias("xpath"))
