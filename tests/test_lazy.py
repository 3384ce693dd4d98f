"""Queries over design exports make only the tables that they need."""

import pytest

from quillmesh import catalog, designs
from quillmesh.sources import shred
from tests.test_queries import SF

#: Query: the tables it makes, besides exports.
NEEDS = {
    "design_nodes": {"records/account"}, "design_accounts": {"records/account", "entities/account"}, "design_themes_and_files": {"records/fileRef", "entities/theme", "entities/fileRef"},
    "design_menus": {"records/customMenu", "entities/customMenu", "entities/customMenuSet"}, "design_privileges": {"records/extPriv", "entities/privilegeSet", "entities/extPriv"},
    "design_functions": {"records/customFunction", "entities/customFunction"}, "design_value_lists": {"records/valueList", "entities/valueList"}, "design_json": {"records/valueList", "entities/valueList"},
    "design_files": {"records/file", "files"}, "design_fields": {"records/field", "raw/field", "entities/field"}, "design_reading_warnings": {"records/field", "raw/field", "base/table", "early"},
    "design_steps": {"records/script", "raw/scriptStep", "entities/scriptStep"}, "design_scripts": {"records/script", "raw/scriptStep", "entities/script"},
    "design_tables": {"records/field", "raw/field", "base/table", "raw/tableOccurrence", "entities/table"}, "design_account_pages": {"records/account", "entities/account", "entities/privilegeSet", "files", "index/account"},
    "design_occurrences": {"records/relationship", "base/table", "raw/tableOccurrence", "base/tableOccurrence", "raw/relationship", "entities/tableOccurrence"},
    "design_relationships": {"records/field", "raw/field", "entities/field", "base/table", "raw/tableOccurrence", "base/tableOccurrence", "raw/relationship", "entities/relationship"},
    "design_layouts": {"records/layout", "records/table", "base/table", "raw/tableOccurrence", "base/tableOccurrence", "raw/layoutObject", "entities/layout"},
}
WITHOUT = {"design_script_pages": ("references", "pieces", "entities/theme", "entities/account", "records/account"), "design_paths": ("references", "raw/relationship", "entities/layout"), "design_references": ("warnings", "entities/valueList", "entities/theme"), "design_reference_counts": ("warnings", "entities/valueList"), "design_backlinks": ("warnings", "entities/customMenu"), "design_warnings": ("entities/valueList", "entities/theme")}


@pytest.fixture
def made(monkeypatch):
    """Names of tables, each planned but empty, so that nothing runs."""
    names = set()
    monkeypatch.setattr(designs, "_MODELS", {})
    monkeypatch.setattr(designs, "exports", lambda spark, d: spark.createDataFrame([], "path string, modificationTime timestamp, content binary"))
    monkeypatch.setattr(designs.Store, "keep", lambda self, name, df, **options: (names.add(name), self.spark.createDataFrame([], df.schema))[1])
    return names


@pytest.mark.parametrize("name", sorted(NEEDS))
def test_makes_what_it_needs(spark, made, name):
    catalog.QUERIES[name](spark, SF)
    assert made == NEEDS[name] | {"exports"}


@pytest.mark.parametrize("name", sorted(WITHOUT))
def test_leaves_out(spark, made, name):
    catalog.QUERIES[name](spark, SF)
    assert made and made.isdisjoint(WITHOUT[name])


XML = b"""<FMSaveAsXML><File><Database><TableCatalog><BaseTable id="1" Name="T" xmlns:q="u" q:Ab="x"><FieldCatalog><Field name="f"/></FieldCatalog></BaseTable></TableCatalog>
<LayoutCatalog><Layout name="L"><Object type="Line" id="1"><a><b/></a><a/><StreamList><x/></StreamList></Object></Layout></LayoutCatalog>
<ScriptCatalog><Folder name="F"><Script name="S"><StepList><Step ID="1" name="s"/></StepList></Script></Folder></ScriptCatalog></Database></File></FMSaveAsXML>"""


@pytest.mark.parametrize("kind", ["file", "table", "field", "layout", "layoutObject", "script", "step", "theme"])
def test_kinds_asked_for(kind):
    assert list(shred.records(XML, frozenset([kind]))) == [r for r in shred.records(XML) if r["kind"] == kind]


def test_nodes_in_columns(spark):
    files = spark.createDataFrame([("a.xml", bytearray(XML)), ("b.xml", bytearray(b"")), ("c.xml", bytearray(XML.decode().encode("utf-16")))], "path string, content binary").selectExpr("path", "timestamp '2024-01-02' AS modificationTime", "content")
    got = {(r.file, r.kind): r for r in shred.shred(files).collect()}
    assert got["b.xml", "file"].warning.startswith("XML parse error") and got["b.xml", "file"].sub == []
    for f in ("a.xml", "c.xml"):
        x = got[f, "layoutObject"].sub
        assert [(n.i, n.p, n.top, n.path, n.first) for n in x] == [(0, -1, 0, "", True), (1, 0, 1, "a", True), (2, 1, 1, "a/b", True), (3, 0, 3, "a", False), (4, 0, 4, "StreamList", True)]
        table, step = got[f, "table"].sub[0], got[f, "step"].sub[0]
        assert table.attrs == {"id": "1", "Name": "T", "Ab": "x"} and table.low == {"id": "1", "name": "T", "ab": "x"}
        assert step.low == {"id": "1", "name": "s"} and x[0].low is None and x[0].attrs == {"type": "Line", "id": "1"}
        assert (got[f, "step"].owner, got[f, "script"].ord, got[f, "script"].above[0].attrs) == (got[f, "script"].ord, got[f, "script"].ord, {"name": "F"})
    at = {r.path: r.xpath for r in shred.nodes(shred.shred(files).where("file = 'a.xml' and kind = 'layoutObject'")).collect()}
    assert at["a/b"] == "/FMSaveAsXML/File/Database/LayoutCatalog/Layout/Object/a/b" and at[""] == "/FMSaveAsXML/File/Database/LayoutCatalog/Layout/Object"
