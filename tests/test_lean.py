"""Exports are made where they are read, and read through whole, but only what is asked for is built."""

import pytest

from quillmesh import designs
from quillmesh.sources import shred
from tests.test_design import V1, V2
from tests.test_queries import SF

PLAIN = b"""<FMSaveAsXML><File><Database><TableCatalog a=">"><BaseTable id="1" name="T"><FieldCatalog><Field name="f"/></FieldCatalog></BaseTable></TableCatalog><RelationshipGraph><TableOccurrenceCatalog><TableOccurrence name="T"/></TableOccurrenceCatalog>
<RelationshipCatalog><Relationship name="R"/></RelationshipCatalog></RelationshipGraph><LayoutCatalog><Layout name="L"><Object type="Line" id="1"><a><b/></a></Object></Layout></LayoutCatalog><LayoutCatalogs/><LayoutCatalog/>
<ScriptCatalog ><Folder name="F"><Script name="S"><StepList><Step id="1" name="s"/></StepList></Script></Folder></ScriptCatalog><ThemeCatalog><Theme name="t"/></ThemeCatalog></Database></File></FMSaveAsXML>"""
KINDS = ["file", "table", "field", "tableOccurrence", "relationship", "layout", "layoutObject", "script", "step", "stepSet", "customFunction", "theme", "valueList"]
INNER = b"<LayoutCatalog><Layout"
ODD = {
    "plain": PLAIN, "declared": b'<?xml version="1.0" encoding="UTF-8"?>\n' + PLAIN, "latin": b'<?xml version="1.0" encoding="ISO-8859-1"?>' + PLAIN.replace(b'"f"', b'"\xe4"'), "utf16": PLAIN.decode().encode("utf-16"), "mark": b"\xef\xbb\xbf" + PLAIN,
    "comment": PLAIN.replace(INNER, b"<LayoutCatalog><!-- </LayoutCatalog> --><Layout"), "section": PLAIN.replace(INNER, b"<LayoutCatalog><![CDATA[</LayoutCatalog>]]><Layout"), "order": PLAIN.replace(INNER, b"<LayoutCatalog><?p </LayoutCatalog>?><Layout"),
    "nested": PLAIN.replace(INNER, b"<LayoutCatalog><LayoutCatalog/><Layout"), "elsewhere": PLAIN.replace(b"<ThemeCatalog>", b"<ThemeCatalog><ScriptCatalog><Theme name='u'/></ScriptCatalog>"), "swallowed": PLAIN.replace(INNER, b"<LayoutCatalog><ScriptCatalog><x/></ScriptCatalog><Layout"),
    "images": PLAIN.replace(INNER, b"<LayoutCatalog><StreamList><x/><y/></StreamList><Layout"), "spaces": PLAIN.replace(b"<FMSaveAsXML>", b'<FMSaveAsXML xmlns="u">'), "prefix": PLAIN.replace(INNER, b"<LayoutCatalog><q:x/><Layout"), "bound": PLAIN.replace(b"<FMSaveAsXML>", b'<FMSaveAsXML xmlns:q="u">').replace(INNER, b"<LayoutCatalog><q:x q:a='1'/><Layout"),
    "broken inside": PLAIN.replace(b"<a><b/></a>", b"<a><b></a>"), "entity": PLAIN.replace(b"<a>", b"<a>&no;"), "cut off": PLAIN[: PLAIN.index(b"<Object")], "twice": PLAIN + b"<x/>", "bytes": PLAIN.replace(b"<a>", b"<a>\xff"), "attribute": PLAIN.replace(b"<LayoutCatalog>", b"<LayoutCatalog a=1>"), "none": b"",
    "v1": V1.encode(), "v2": V2.encode("utf-16"),
}


@pytest.mark.parametrize("name", sorted(ODD))
def test_same_as_whole(name):
    every = list(shred.records(ODD[name]))
    for kinds in [[k] for k in KINDS] + [["table", "field"], ["layout", "layoutObject"], ["script", "step", "stepSet"], ["theme", "script"]]:
        assert list(shred.records(ODD[name], frozenset(kinds))) == [r for r in every if r["kind"] in kinds]


def test_builds_only_what_is_asked_for(monkeypatch):
    built, parse = [], shred._parse
    monkeypatch.setattr(shred, "_parse", lambda content: (built.append(content), parse(content))[1])
    assert [r["sub"][0][3] for r in shred.records(PLAIN, frozenset(["theme"]))] == ["Theme"]
    assert len(built) == 1 and b"<Step" not in built[0] and b"<Object" not in built[0] and b"<Theme " in built[0]


def test_packs_hold_whole_exports(spark, monkeypatch):
    whole = {r.path: bytes(r.content) for r in designs.exports(spark, SF).collect()}
    customers = spark.read.parquet(f"{SF}/customer.parquet").selectExpr(f"floor(c_custkey / {designs.SIZE}) AS b").distinct().count()
    assert len(whole) == customers and all(x.endswith(b"</FMSaveAsXML>") for x in whole.values())
    monkeypatch.setattr(designs, "ROWS", 1)
    few = designs.exports(spark, SF)
    assert {r.path: bytes(r.content) for r in few.collect()} == whole and few.count() == len(whole)


def test_nodes_are_looked_for_once(spark):
    """Several attributes are read of a node, which is looked for before."""
    from quillmesh.plans import model

    files = spark.createDataFrame([("a.xml", bytearray(V1.encode()))], "path string, content binary").selectExpr("path", "timestamp '2024-01-02' AS modificationTime", "content")
    plan = model.fields(shred.shred(files))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("= Storage)") == 1 and plan.count("= AutoEnter)") == 1


def test_equal_places_are_ordered_by_text(spark, tmp_path):
    """Line items of one number, part and supplier stand in the order of what is said of them, not of their other columns."""
    for name in ("customer", "nation", "orders"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    order = spark.read.parquet(f"{SF}/orders.parquet").agg({"o_orderkey": "min"}).first()[0]
    line = "SELECT CAST({} AS BIGINT) l_orderkey, 123L l_partkey, 0L l_suppkey, 4 l_linenumber, {} l_quantity, 'N' l_returnflag, '{}' l_linestatus"
    spark.sql(" UNION ALL ".join(line.format(order, q, ls) for q, ls in ((9.0, "O"), (10.0, "F")))).write.parquet(f"{tmp_path}/lineitem.parquet")
    steps = [x for r in designs.exports(spark, str(tmp_path)).collect() for x in bytes(r.content).split(b"<Step ")[1:]]
    assert [x.split(b'"')[7] for x in steps] == [b"False", b"True"]


def test_time_is_the_sessions(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert designs.exports(spark, SF).selectExpr("CAST(modificationTime AS string) AS t").distinct().collect() == [("2024-01-02 03:04:05",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_packing_needs_no_python(spark):
    """Rows are brought together as lines, by Spark alone: moved row by row to Python they took most of the time."""
    assert "MapInArrow" not in designs.packed(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_lines_hold_any_text(spark):
    """Separators, quotes, line ends, nothing and null come back as they were."""
    texts = ['a,"b"', "", None, "\r\nx\n", '"', "é ", "NULL"]
    rows = [(None if i == 4 else i, t, None, 2, 3 if i else None, "F", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "o long, rf string, ln int, p long, s long, q string, ls string").selectExpr("o", "ln", "p", "s", "CAST(NULL AS int) q", "rf", "ls")
    got = designs._table(["\n".join(r.line for r in df.select(designs._line("l").alias("line")).collect()).encode(), b""], "l")
    assert [tuple(x.values()) for x in got.to_pylist()] == [tuple(r) for r in df.collect()]
    assert designs._table([b""], "o").num_rows == 0 and designs._table([b""], "o").column_names == ["k", "o", "prio", "st"]


def test_small_catalogs_are_left_out_too(monkeypatch):
    """Of a file that is only asked what it is, no catalog is built."""
    built, parse = [], shred._parse
    monkeypatch.setattr(shred, "_parse", lambda content: (built.append(content), parse(content))[1])
    more = PLAIN.replace(b"<ThemeCatalog>", b"<ValueListCatalog><ValueList name='v'/></ValueListCatalog><AccountsCatalog><Account/></AccountsCatalog><ThemeCatalog>")
    assert [r["kind"] for r in shred.records(more, frozenset(["file"]))] == ["file"]
    assert len(built) == 1 and not any(x in built[0] for x in (b"<ValueList ", b"<Account/>", b"<Theme "))
    for kind in ("valueList", "account", "theme"):
        assert list(shred.records(more, frozenset([kind]))) == [r for r in shred.records(more) if r["kind"] == kind]
