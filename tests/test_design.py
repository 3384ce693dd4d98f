"""The design pipeline on exports written for these tests: both dialects, duplicates, dangling and aliased references, broken files."""

import json

import pytest
from pyspark.sql import functions as F

from quillmesh import cli, streaming
from quillmesh.plans import graph, pages
from quillmesh.sources import export, shred

V1 = """<?xml version="1.0"?><x:FMSaveAsXML xmlns:x="urn:x" Version="1.0"><Product Version="19.1" Build="7"/><File name="Shop"><Database name="Shop">
<TableCatalog>
 <BaseTable id="1" name=" Item " uuid="u1"><FieldCatalog>
  <Field id="1" name="Code" dataType="Number" fieldType="Normal"><AutoEnter serial="True" allowEditing="False"/><Validation message="no"><Unique value="True"/><MaximumCharacters value="9"/></Validation><Storage global="True" index="Minimal" maxRepeat="x"/></Field>
  <Field id="2" name="Total"><Calculation>Item::Code * 2</Calculation><AutoEnter constant="k"><Calculation> Get(1) </Calculation></AutoEnter><Validation><NotEmpty value="False"/></Validation></Field>
  <Field id="3" name="Total" dataType="Date"><Storage autoIndex="None" ID="1"/></Field>
  <Field id="4" name=""/>
 </FieldCatalog></BaseTable>
 <BaseTable id="2" name=""/>
</TableCatalog>
<RelationshipGraph>
 <TableOccurrenceCatalog><TableOccurrence id="7" name="Item" baseTableID="1"/><TableOccurrence id="8" name="Alias" baseTableID="1"/><TableOccurrence id="9" name="Lost" baseTableID="99"/></TableOccurrenceCatalog>
 <RelationshipCatalog>
  <Relationship id="1" name="R"><LeftTable id="7" name="Item"/><RightTable id="8" name="Alias"/><Options allowCreateRelatedRecords="True"/><JoinPredicateList><JoinPredicate fieldCompareOp="3"><LeftField name="Code" tableName="Item"/><RightField name="Code" tableName="Alias"/></JoinPredicate></JoinPredicateList></Relationship>
  <Relationship id="2"><LeftTable name="Item"/><RightTable name="Nowhere"/><JoinPredicateList><JoinPredicate type="Equal"><LeftField name="Gone" tableName="Item"/><RightField/></JoinPredicate></JoinPredicateList></Relationship>
 </RelationshipCatalog>
</RelationshipGraph>
<LayoutCatalog><Layout id="1" name="Main [1]" tableOccurrenceID="8"><Objects>
  <Object type="FieldObj" id="5"><FieldObj><Name field="Code" table="Item"/></FieldObj></Object><Object type="FieldObj" id="5"><FieldObj><Name field="Total" table="Item"/></FieldObj></Object>
  <Object type=""/><Object type="Field"><Field><Name field="Code" table="Alias" tableID="8"/></Field></Object></Objects></Layout>
 <Layout id="2" name="Void" tableOccurrenceName="Nope"/></LayoutCatalog>
<ScriptCatalog><Folder name="A"><Group name="B/C"><Script id="1" name="Run"><StepList>
  <Step id="1" index="0" name="Go" enable="false"><Layout name="Main [1]"/><Field name="Code" table="Item"/></Step><Step id="2" index="0" name="Set"><Wrap><Field name="Code" table="Alias"/></Wrap></Step><Step id="3" name="Call"><Script name="Stop"/></Step></StepList></Script></Group></Folder>
 <Script id="2" name="Stop"/></ScriptCatalog>
<CustomFunctionCatalog><CustomFunction id="1" name="Twice" pramaters="a; b"><Calculation>Twice(1) + Alias::Code + Item::Code + Bad::X + Twice (2)</Calculation></CustomFunction></CustomFunctionCatalog>
<ValueListCatalog><ValueList id="1" name="V" type="Custom"><CustomValues><Value> a </Value><Value/><Value>b</Value></CustomValues></ValueList><ValueList id="2" name="W" type="relatedThing"><SourceField name="Code" table="Item"/></ValueList></ValueListCatalog>
</Database></File></x:FMSaveAsXML>"""

V2 = """<?xml version="1.0" encoding="UTF-16"?><FMSaveAsXML version="2.1" Source="22.0" File="Neu.fmp12"><Structure><AddAction>
<BaseTableCatalog><BaseTable id="1" name="Ware"><UUID>w</UUID></BaseTable></BaseTableCatalog>
<TableOccurrenceCatalog><TableOccurrence id="11" name="Ware"><BaseTableSourceReference><BaseTableReference id="1"/></BaseTableSourceReference></TableOccurrence></TableOccurrenceCatalog>
<FieldsForTables><FieldCatalog><BaseTableReference id="1" name="Ware"/><ObjectList><Field id="1" name="Größe" fieldtype="Calculated" datatype="Text"><Validation notEmpty="TRUE"/><Storage maxRepetitions="3"/><Calculation><Text><![CDATA[1+1]]></Text></Calculation></Field></ObjectList></FieldCatalog>
 <FieldCatalog><BaseTableReference id="5" name="Fehlt"/><ObjectList><Field id="9" name="x"/></ObjectList></FieldCatalog></FieldsForTables>
<LayoutCatalog><Layout id="1" name="L"><TableOccurrenceReference id="11" name="Ware"/><PartsList><Part type="Body"><ObjectList><LayoutObject id="1" type="Edit Box" name="e"><UUID>q</UUID><Bounds top="1" left="x" right="2.5"/><Field><FieldReference id="1" name="Größe"><TableOccurrenceReference id="11" name="Ware"/></FieldReference></Field></LayoutObject>
 <LayoutObject id="" type="Text"><Text><StyledText><Data> Hallo </Data></StyledText></Text><StreamList><Stream>zzz</Stream></StreamList></LayoutObject></ObjectList></Part></PartsList></Layout></LayoutCatalog>
<ScriptCatalog><Script id="1" name="S"><StepList><Step name="inline"/></StepList></Script></ScriptCatalog>
<StepsForScripts><Script><ScriptReference id="1"/><ObjectList><Step id="1" index="4" name="Apart"><Calculation> f(x) </Calculation></Step></ObjectList></Script></StepsForScripts>
<CustomFunctionsCatalog><ObjectList><CustomFunction id="1" name="F"><ObjectList><Parameter name="n"/></ObjectList></CustomFunction></ObjectList></CustomFunctionsCatalog>
<CalcsForCustomFunctions><ObjectList><CustomFunctionCalc><CustomFunctionReference id="1"/><Calculation><Text>n + 1</Text></Calculation></CustomFunctionCalc></ObjectList></CalcsForCustomFunctions>
<ValueListCatalog><ValueList id="1" name="A"><Source value="Custom"/></ValueList><ValueList id="2" name="B"><Source value="FromField"/></ValueList></ValueListCatalog>
<OptionsForValueLists><ValueList><ValueListReference id="1"/><Source value="Custom"/><CustomValues><Text>x

 y </Text></CustomValues></ValueList><ValueList><ValueListReference id="2"/><Source value="FromField"/><Field><PrimaryField><FieldReference name="Größe"><TableOccurrenceReference name="Ware"/></FieldReference></PrimaryField></Field></ValueList></OptionsForValueLists>
<PrivilegeSetsCatalog><ObjectList><PrivilegeSet id="1" name="[Full]"><Description>all</Description></PrivilegeSet></ObjectList></PrivilegeSetsCatalog>
<AccountsCatalog><Account id="1" enable=""><Authentication><AccountName>boss</AccountName></Authentication><PrivilegeSetReference name="[Full]"/></Account><Account id="2" enable="No" name="guest"><PrivilegeSetReference name="none"/></Account></AccountsCatalog>
<ExtendedPrivilegesCatalog><ExtendedPrivilege id="1" name="web"><L><PrivilegeSetReference name="[Full]"/><PrivilegeSetReference name="[Full]"/></L></ExtendedPrivilege></ExtendedPrivilegesCatalog>
<CustomMenuCatalog><CustomMenu id="1" name="M"><Base name="Edit"/><Conditions><Install><Calculation><Text>1</Text></Calculation></Install></Conditions><Options browseMode="FALSE" FINDMODE="false"/><MenuItemList><MenuItem name="Undo" type="Std"/></MenuItemList></CustomMenu></CustomMenuCatalog>
<CustomMenuSetsCatalog><CustomMenuSet id="1" name="MS"><CustomMenuReference name="M"/><CustomMenuReference name="M"/></CustomMenuSet></CustomMenuSetsCatalog>
<ThemeCatalog><Theme id="1" name="t" Display="Nice" defaultTheme=""/></ThemeCatalog><FileAccessCatalog><Authorization id="1" type="Local" self="True"><Display>Neu</Display></Authorization></FileAccessCatalog>
</AddAction></Structure></FMSaveAsXML>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("exports")
    (d / "one.xml").write_text(V1)
    (d / "two.xml").write_bytes(V2.encode("utf-16"))
    (d / "bad.xml").write_text("<a><b></a>")
    (d / "odd.xml").write_text("<a/>")
    (d / "empty.xml").write_text("")
    return d


@pytest.fixture(scope="module")
def model(spark, folder):
    return cli.load(spark, f"file://{folder}")


def of(df, file):
    return df.where(F.col("file").endswith(file))


def entity(model, kind, doc_id):
    (r,) = model.entities[kind].where(F.col("docId") == doc_id).collect()
    return r


def test_empty_content():
    (r,) = shred.records(b"")
    assert r["warning"]


def test_counts(model):
    n = {f: {r.entityType: r["count"] for r in of(graph.entity_index(model), f).groupBy("entityType").count().collect()} for f in ("one.xml", "two.xml")}
    assert n["one.xml"] == {"table": 1, "field": 2, "tableOccurrence": 3, "relationship": 2, "layout": 2, "layoutObject": 2, "script": 2, "scriptStep": 2, "customFunction": 1, "valueList": 2}
    assert n["two.xml"] == {"table": 1, "field": 2, "tableOccurrence": 1, "layout": 1, "layoutObject": 2, "script": 1, "scriptStep": 1, "customFunction": 1, "valueList": 2, "privilegeSet": 1, "account": 2, "extPriv": 1, "customMenu": 1, "customMenuSet": 1, "theme": 1, "fileRef": 1}
    assert {r.entity: r.n for r in graph.entity_counts(model).collect()}["fields"] == 4


def test_files(model):
    got = {r.fileName: (r.version, r.solution, bool(r.warning)) for r in model.files.collect()}
    assert got["one.xml"] == ("19.1 (build 7)", "Shop", False) and got["two.xml"] == ("22.0", "Neu", False)
    assert got["bad.xml"][2] and got["odd.xml"][2] and got["empty.xml"][2]


def test_fields(model):
    code, total = entity(model, "field", "field:Item::Code"), entity(model, "field", "field:Item::Total")
    assert code.autoEnter.asDict() == {"type": "serial", "value": None, "calculation": None, "no_modify_auto_enter": True}
    assert code.validation.asDict() == {"required": False, "not_empty": False, "unique": True, "max_characters": 9, "message": "no"}
    assert code.storage.asDict() == {"global": True, "indexed": True, "maxRepeat": 1}
    # the last record's values at the first record's place
    assert total.dataType == "Date" and total.calculation is None and total.fmpId == "3" and total.pos.ord < total.ord
    size = entity(model, "field", "field:Ware::Größe")
    assert size.calculation == "1+1" and size.validation.not_empty and size.storage.maxRepeat == 3
    assert entity(model, "table", "table:Item").fields == ["field:Item::Code", "field:Item::Total"]


def test_lookups(model):
    assert entity(model, "tableOccurrence", "to:Alias").baseTableDocId == "table:Item"
    assert entity(model, "tableOccurrence", "to:Lost").baseTableDocId == ""
    r = entity(model, "relationship", "relationship:R")
    # an alias is read through its base table
    assert [p.asDict() for p in r.predicates] == [{"leftFieldDocId": "field:Item::Code", "operator": "<=", "rightFieldDocId": "field:Item::Code"}] and r.options.allowCreateRelated
    s = entity(model, "relationship", "relationship:Item__Nowhere")
    assert s.rightTableOccurrenceDocId == "to:Nowhere" and s.predicates[0].asDict() == {"leftFieldDocId": "field:Item::Gone", "operator": "equal", "rightFieldDocId": ""}
    assert entity(model, "layout", "layout:Main [1]").baseTableOccurrenceDocId == "to:Alias" and entity(model, "layout", "layout:Void").baseTableOccurrenceDocId == "to:Nope"


def test_layout_objects(model):
    main = entity(model, "layout", "layout:Main [1]")
    # of two objects with an id the first; those without one by their number; the alias isn't read through
    assert main.layoutObjects == ["layoutObject:Main [1]::5", "layoutObject:Main [1]::idx0003"] and main.referencedFields == ["field:Item::Code", "field:Alias::Code"]
    box, text = entity(model, "layoutObject", "layoutObject:L::1"), entity(model, "layoutObject", "layoutObject:L::idx0002")
    assert box.bounds.asDict() == {"top": 1.0, "left": None, "bottom": None, "right": 2.5} and box.part == "Body" and box.uuid == "q" and text.rawText == "Hallo" and text.bounds is None


def test_scripts(model):
    run = entity(model, "script", "script:Run")
    assert run.folderPath == "A/B/C" and run.steps == ["scriptStep:Run:0000", "scriptStep:Run:0000", "scriptStep:Run:0002"]
    assert run.referencedFields == ["field:Item::Code", "field:Alias::Code"] and run.referencedLayouts == ["layout:Main [1]"] and run.referencedScripts == ["script:Stop"]
    assert entity(model, "scriptStep", "scriptStep:Run:0000").rawText == "Set [ Alias::Code ]"
    assert entity(model, "scriptStep", "scriptStep:S:0004").rawText == "Apart [ f(x) ]" and entity(model, "script", "script:Stop").steps == []


def test_other_kinds(model):
    assert entity(model, "customFunction", "customFunction:Twice").parameters == ["a", "b"] and entity(model, "customFunction", "customFunction:F").calculation == "n + 1"
    assert entity(model, "valueList", "valueList:V")["values"] == ["a", "b"] and entity(model, "valueList", "valueList:A")["values"] == ["x", "y"]
    assert entity(model, "valueList", "valueList:W").listType == "related" and entity(model, "valueList", "valueList:B").sourceFieldDocId == "field:Ware::Größe"
    assert entity(model, "account", "account:boss").enabled and not entity(model, "account", "account:guest").enabled
    m = entity(model, "customMenu", "customMenu:M")
    assert (m.browseMode, m.findMode, m.installCondition, m.baseMenuName) == (False, True, "1", "Edit")
    assert entity(model, "customMenuSet", "customMenuSet:MS").menuDocIds == ["customMenu:M"] * 2 and entity(model, "theme", "theme:t").defaultTheme and entity(model, "fileRef", "fileRef:Local:Neu").isSelf


def test_references(model):
    refs = [(r.sourceDocId, r.targetDocId, r.relationshipType, r.confidence) for r in of(model.references, "one.xml").orderBy("at").collect()]
    assert [r for r in refs if r[2] == "contains"] == [("table:Item", "field:Item::Code", "contains", "exact"), ("table:Item", "field:Item::Total", "contains", "exact"), ("layout:Main [1]", "layoutObject:Main [1]::5", "contains", "exact"), ("layout:Main [1]", "layoutObject:Main [1]::idx0003", "contains", "exact")]
    steps = [r[1:] for r in refs if r[0].startswith("scriptStep")]
    # two steps share an id: the last one's references come twice
    assert steps == [("field:Alias::Code", "usesField", "unresolved")] * 2 + [("script:Stop", "usesScript", "exact")]
    calc = [r[1:] for r in refs if r[0] == "customFunction:Twice"]
    assert calc == [("field:Item::Code", "usesField", "parsed")] * 2 + [("field:Bad::X", "usesField", "unresolved"), ("customFunction:Twice", "usesCustomFunction", "parsed")]
    back = {r.targetDocId: [x.sourceDocId for x in r.links] for r in of(graph.backlinks(model.references), "one.xml").collect()}
    assert back["script:Stop"] == ["scriptStep:Run:0002"] and len(back["field:Item::Code"]) == 7
    assert not [r for r in graph.dangling_references(model, model.references).collect() if r.confidence == "exact"]


def test_warnings(model):
    got = [(r.code, r.entityDocId) for r in of(model.warnings, "one.xml").orderBy("phase", "place").collect()]
    assert [c for c, _ in got] == ["MISSING_NAME", "MISSING_NAME", "UNRESOLVED_REFERENCE", "UNRESOLVED_REFERENCE", "UNRESOLVED_REFERENCE", "EMPTY_SCRIPT", "UNRESOLVED_TO_TABLE", "UNRESOLVED_RELATIONSHIP_TO", "UNRESOLVED_LAYOUT_TO"]
    assert {(r.code, r.entityDocId) for r in of(model.warnings, "two.xml").collect()} == {("ORPHAN_FIELD", "field:Fehlt::x"), ("UNUSED_FIELD_CANDIDATE", "field:Fehlt::x"), ("UNRESOLVED_FIELD_TABLE", "field:Fehlt::x")}
    assert {r.code for r in of(model.warnings, "bad.xml").collect()} == {"PARSE_WARNING"}


def test_pages_and_json(spark, model, tmp_path):
    p = {(r.file.rpartition("/")[2], r.path): r.content for r in pages.pages(model, "now").collect()}
    layout = p["one.xml", "Layouts/Main [1].md"]
    assert "| 5 | FieldObj |  |  | [Item::Code](../Fields/Item/Code.md) |" in layout and "| [Item::Code](../Fields/Item/Code.md) | Number |" in layout and "| field:Alias::Code | ? |" in layout
    assert p["one.xml", "Scripts/A/B/C/Run.md"].count("| 1 | Yes | Set [ Alias::Code ] |") == 2
    assert "## Global Fields" in p["one.xml", "Tables/Item.md"] and "| [Main [1]](Main [1].md) | Alias |" in p["one.xml", "Layouts/index.md"]
    assert ("two.xml", "FileAccess/Local_Neu.md") in p and ("bad.xml", "index.md") in p and "_0 table(s)_" in p["bad.xml", "Tables/index.md"]
    assert "| `UNRESOLVED_TO_TABLE` | to:Lost |" in p["one.xml", "Reports/warnings.md"] and "_3 unresolved reference(s)_" in p["one.xml", "Reports/unresolved-references.md"]
    docs = of(export.documents(model, "2026-01-01T00:00:00Z"), "one.xml")
    export.write_json(docs, str(tmp_path / "m.json"))
    d = json.loads((tmp_path / "m.json").read_text())
    assert list(d) == ["schemaVersion", "source", "solution", "entities", "references", "backlinks", "warnings"] and len(d["entities"]) == 17
    assert list(d["entities"]["fields"]) == ["field:Item::Code", "field:Item::Total"] and d["entities"]["fields"]["field:Item::Code"]["validation"]["max_characters"] == 9
    again = export.read_documents(spark, f"file://{tmp_path}/m.json", model.store.__class__(spark))
    second = {r.path: r.content for r in pages.pages(again, "now").collect()}
    assert second == {k[1]: v for k, v in p.items() if k[0] == "one.xml"}


def test_nodes(spark, folder):
    rec = shred.read_exports(spark, f"file://{folder}/one.xml")
    rel = shred.nodes(rec.where("kind = 'relationship'"))
    a, d = rel.where("tag = 'JoinPredicate'").alias("a"), rel.alias("d")
    inner = a.join(d, (F.col("a.ord") == F.col("d.ord")) & (F.col("d.pre") > F.col("a.pre")) & (F.col("d.pre") <= F.col("a.post")))
    assert sorted(r.tag for r in inner.select("d.tag").collect()) == ["LeftField", "LeftField", "RightField", "RightField"]


def test_stream(spark, folder, tmp_path):
    q = streaming.stream_exports(spark, f"file://{folder}").writeStream.format("parquet").option("path", f"file://{tmp_path}/r").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/r").where("kind = 'field'").count() == 6


def test_folders(tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_text("x")
    (tmp_path / "d" / "link").symlink_to(tmp_path)
    with pytest.raises(SystemExit):
        cli.output_folder(str(tmp_path / "d"), False, ask=lambda _: "n")
    with pytest.raises(SystemExit):
        cli.output_folder(str(tmp_path / "d" / "x"), True)
    monkeypatch.setenv("HERE", str(tmp_path))
    assert cli.output_folder("$HERE/d", True) == str(tmp_path / "d") and not list((tmp_path / "d").iterdir()) and tmp_path.exists()
    with pytest.raises(SystemExit):
        cli.input_file(str(tmp_path / "missing.xml"))
