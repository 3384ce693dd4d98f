"""Small exports of both dialects against known counts and edges; page files; a folder of exports; the command line."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quillmesh import cli
from quillmesh.plans import graph, pages
from quillmesh.sources import export

V1 = """<?xml version="1.0" encoding="UTF-8"?>
<FMSaveAsXML Version="1.0"><Product Name="Maker" Version="19.6.4.402" Build="19.6.4.402"/><File name="SampleSolution"><Database name="SampleSolution">
<TableCatalog>
<BaseTable id="1" name="Customer" uuid="c-1"><FieldCatalog>
<Field dataType="Text" fieldType="Normal" id="1" name="CustomerID" uuid="f1"><AutoEnter serial="True" allowEditing="False"/><Validation><Unique value="True"/></Validation><Storage index="All" global="False" maxRepeat="1"/></Field>
<Field dataType="Text" fieldType="Normal" id="2" name="FirstName"><Storage index="Minimal"/></Field>
<Field dataType="Text" fieldType="Normal" id="3" name="LastName"><Validation><NotEmpty value="True"/></Validation><Storage index="All"/></Field>
<Field dataType="Text" fieldType="Calculation" id="4" name="FullName"><Calculation>FirstName &amp; " " &amp; LastName</Calculation><Storage index="All"/></Field>
<Field dataType="Text" fieldType="Normal" id="5" name="Status"><AutoEnter constant="Active"/><Storage index="All"/></Field>
</FieldCatalog></BaseTable>
<BaseTable id="2" name="Invoice" uuid="i-1"><FieldCatalog>
<Field dataType="Text" fieldType="Normal" id="1" name="InvoiceID"><AutoEnter serial="True" allowEditing="False"/><Storage index="All"/></Field>
<Field dataType="Text" fieldType="Normal" id="2" name="CustomerFK"><Storage index="All"/></Field>
<Field dataType="Number" fieldType="Normal" id="3" name="Amount"><Storage index="None"/></Field>
<Field dataType="Date" fieldType="Normal" id="4" name="InvoiceDate"><Storage index="All"/></Field>
</FieldCatalog></BaseTable>
</TableCatalog>
<RelationshipGraph><TableOccurrenceCatalog><TableOccurrence id="10" name="Customer" baseTableID="1"/><TableOccurrence id="11" name="Invoice" baseTableID="2"/><TableOccurrence id="12" name="Invoice__Customer" baseTableID="2"/></TableOccurrenceCatalog>
<RelationshipCatalog><Relationship id="1" name="Customer_to_Invoice"><LeftTable id="10" name="Customer"/><RightTable id="11" name="Invoice"/><JoinPredicateList><JoinPredicate fieldCompareOp="0"><LeftField name="CustomerID" tableName="Customer"/><RightField name="CustomerFK" tableName="Invoice"/></JoinPredicate></JoinPredicateList></Relationship></RelationshipCatalog></RelationshipGraph>
<LayoutCatalog><Layout id="1" name="Customer List" tableOccurrenceID="10" tableOccurrenceName="Customer"><Objects>
<Object type="FieldObj"><FieldObj><Name field="CustomerID" table="Customer"/></FieldObj></Object><Object type="FieldObj"><FieldObj><Name field="FullName" table="Customer"/></FieldObj></Object><Object type="FieldObj"><FieldObj><Name field="Status" table="Customer"/></FieldObj></Object></Objects></Layout>
<Layout id="2" name="Invoice Detail" tableOccurrenceID="11" tableOccurrenceName="Invoice"><Objects><Object type="FieldObj"><FieldObj><Name field="InvoiceID" table="Invoice"/></FieldObj></Object><Object type="FieldObj"><FieldObj><Name field="Amount" table="Invoice"/></FieldObj></Object></Objects></Layout></LayoutCatalog>
<ScriptCatalog><ScriptFolder name="Customer Scripts">
<Script id="1" name="Create Customer"><StepList><Step enable="True" id="6" index="0" name="Go to Layout"><Layout id="1" name="Customer List"/></Step><Step enable="True" id="7" index="1" name="New Record/Request"/><Step enable="True" id="76" index="2" name="Set Field"><Field id="5" name="Status" table="Customer"/></Step></StepList></Script>
<Script id="2" name="Delete Customer"><StepList><Step enable="False" id="9" index="0" name="Delete Record"/></StepList></Script></ScriptFolder>
<Script id="3" name="Post Invoice"><StepList><Step enable="True" id="6" index="0" name="Go to Layout"><Layout id="2" name="Invoice Detail"/></Step><Step enable="True" id="1" index="1" name="Perform Script"><Script id="1" name="Create Customer"/></Step></StepList></Script></ScriptCatalog>
<CustomFunctionCatalog><CustomFunction id="1" name="FormatCurrency" pramaters="amount"><Calculation>"$" &amp; amount</Calculation></CustomFunction></CustomFunctionCatalog>
<ValueListCatalog><ValueList id="1" name="CustomerStatus" type="Custom"><CustomValues><Value>Active</Value><Value>Inactive</Value><Value>Prospect</Value></CustomValues></ValueList></ValueListCatalog>
</Database></File></FMSaveAsXML>"""

V2 = """<?xml version="1.0"?><FMSaveAsXML version="2.2.3.0" Source="22.0.6" File="TestSolution.fmp12"><Structure><AddAction>
<BaseTableCatalog><BaseTable id="1" name="Contact"><UUID>t</UUID></BaseTable></BaseTableCatalog>
<TableOccurrenceCatalog><TableOccurrence id="1" name="Contact"><BaseTableSourceReference><BaseTableReference id="1" name="Contact"/></BaseTableSourceReference></TableOccurrence><TableOccurrence id="2" name="Contact__selfJoin"><BaseTableSourceReference><BaseTableReference id="1" name="Contact"/></BaseTableSourceReference></TableOccurrence></TableOccurrenceCatalog>
<CustomFunctionsCatalog><ObjectList><CustomFunction id="1" name="DoubleIt"><ObjectList><Parameter name="n"/></ObjectList></CustomFunction></ObjectList></CustomFunctionsCatalog>
<ValueListCatalog><ValueList id="1" name="StatusList"><Source value="Custom"/></ValueList><ValueList id="2" name="NameFromField"><Source value="FromField"/></ValueList></ValueListCatalog>
<FieldsForTables><FieldCatalog><BaseTableReference id="1" name="Contact"/><ObjectList><Field id="1" name="ContactID" fieldtype="Normal" datatype="Number"><Validation notEmpty="True" unique="True"/><Storage maxRepetitions="1"/></Field><Field id="2" name="FullName" fieldtype="Calculated" datatype="Text"><Calculation><Text>"x"</Text></Calculation></Field><Field id="3" name="Status" fieldtype="Normal" datatype="Text"/></ObjectList></FieldCatalog></FieldsForTables>
<OptionsForValueLists><ValueList><ValueListReference id="1"/><Source value="Custom"/><CustomValues><Text>Open
Closed</Text></CustomValues></ValueList><ValueList><ValueListReference id="2"/><Source value="FromField"/><Field><PrimaryField><FieldReference id="3" name="Status"><TableOccurrenceReference id="1" name="Contact"/></FieldReference></PrimaryField></Field></ValueList></OptionsForValueLists>
<RelationshipCatalog><Relationship id="1"><LeftTable><TableOccurrenceReference id="2" name="Contact__selfJoin"/></LeftTable><RightTable><TableOccurrenceReference id="1" name="Contact"/></RightTable><JoinPredicateList><JoinPredicate type="Equal"><LeftField><FieldReference name="ContactID"><TableOccurrenceReference name="Contact__selfJoin"/></FieldReference></LeftField><RightField><FieldReference name="ContactID"><TableOccurrenceReference name="Contact"/></FieldReference></RightField></JoinPredicate></JoinPredicateList></Relationship></RelationshipCatalog>
<CalcsForCustomFunctions><ObjectList><CustomFunctionCalc><CustomFunctionReference id="1" name="DoubleIt"/><Calculation><Text>n * 2</Text></Calculation></CustomFunctionCalc></ObjectList></CalcsForCustomFunctions>
<ScriptCatalog><Script id="1" name="SendEmail"/></ScriptCatalog><StepsForScripts><Script><ScriptReference id="1" name="SendEmail"/><ObjectList><Step id="89" index="0" name="# (comment)" enable="True"/><Step id="63" index="1" name="Send Mail" enable="True"/></ObjectList></Script></StepsForScripts>
<LayoutCatalog><Layout id="1" name="ContactDetail"><TableOccurrenceReference id="1" name="Contact"/></Layout></LayoutCatalog>
<PrivilegeSetsCatalog><ObjectList><PrivilegeSet id="1" name="[Full Access]"><Description>all</Description></PrivilegeSet><PrivilegeSet id="2" name="[Read-Only Access]"/></ObjectList></PrivilegeSetsCatalog>
<AccountsCatalog><ObjectList><Account id="1" type="FileMaker" enable="True"><AccountName>admin</AccountName><PrivilegeSetReference id="1" name="[Full Access]"/><Description>first</Description></Account></ObjectList></AccountsCatalog>
<ExtendedPrivilegesCatalog><ObjectList><ExtendedPrivilege id="1" name="fmwebdirect"><Description>web</Description><ObjectList><PrivilegeSetReference id="1" name="[Full Access]"/></ObjectList></ExtendedPrivilege><ExtendedPrivilege id="2" name="fmapp"/></ObjectList></ExtendedPrivilegesCatalog>
<CustomMenuCatalog><ObjectList><CustomMenu id="1" name="EditMenu"><Base name="Edit"/><Options browseMode="True" findMode="False" previewMode="True"/><MenuItemList><MenuItem name="Undo" type="Standard"/><MenuItem name="Redo" type="Standard"/></MenuItemList></CustomMenu><CustomMenu id="2" name="EmptyMenu"/></ObjectList></CustomMenuCatalog>
<CustomMenuSetsCatalog><ObjectList><CustomMenuSet id="1" name="DefaultMenuSet"><CustomMenuReference name="EditMenu"/><CustomMenuReference name="EmptyMenu"/></CustomMenuSet></ObjectList></CustomMenuSetsCatalog>
<ThemeCatalog><Theme id="1" name="theme.min" Display="Minimalist Touch" Group="Touch" defaultTheme="True"/></ThemeCatalog>
<FileAccessCatalog><ObjectList><Authorization id="1" type="Local" self="True"><Display>TestSolution</Display></Authorization></ObjectList></FileAccessCatalog>
</AddAction></Structure></FMSaveAsXML>"""

OBJECTS = """<FMSaveAsXML version="2.2" Source="22.0" File="Objects.fmp12"><Structure><AddAction>
<BaseTableCatalog><BaseTable id="1" name="Contacts"/></BaseTableCatalog><TableOccurrenceCatalog><TableOccurrence id="1" name="Contacts"><BaseTableSourceReference><BaseTableReference id="1"/></BaseTableSourceReference></TableOccurrence></TableOccurrenceCatalog>
<FieldsForTables><FieldCatalog><BaseTableReference id="1" name="Contacts"/><ObjectList><Field id="1" name="firstName"/></ObjectList></FieldCatalog></FieldsForTables>
<LayoutCatalog><Layout id="1" name="ContactDetail"><TableOccurrenceReference id="1" name="Contacts"/><PartsList><Part type="Body"><ObjectList><LayoutObject id="1" type="Text" name=""><Text><StyledText><Data>First name</Data></StyledText></Text></LayoutObject>
<LayoutObject id="2" type="Edit Box" name="box"><Bounds top="10" left="120" bottom="30" right="320"/><Field><FieldReference id="1" name="firstName"><TableOccurrenceReference id="1" name="Contacts"/></FieldReference></Field></LayoutObject></ObjectList></Part></PartsList></Layout></LayoutCatalog>
</AddAction></Structure></FMSaveAsXML>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("exports")
    for place, name, text in (("a", "same", V1), ("b", "same", V2), (".", "objects", OBJECTS), (".", "empty", "")):
        (d / place).mkdir(exist_ok=True)
        (d / place / f"{name}.xml").write_text(text)
    return d


@pytest.fixture(scope="module")
def model(spark, folder):
    return cli.load(spark, f"file://{folder}")


def of(df, file):
    return df.where(F.col("file").endswith(file))


def test_edges(model):
    edges = {f: [tuple(r) for r in of(model.references, f).select("sourceDocId", "targetDocId", "relationshipType", "confidence").collect()] for f in ("a/same.xml", "b/same.xml", "objects.xml")}
    assert [len(x) for x in edges.values()] == [42, 12, 8] and all(e[3] == "exact" for x in edges.values() for e in x)
    assert {r.code for r in of(model.warnings, "a/same.xml").collect()} == set() == {r.code for r in of(model.warnings, "b/same.xml").collect()}
    v1, v2, objects = (set(x) for x in edges.values())
    assert {("scriptStep:Create Customer:0002", "field:Customer::Status", "usesField", "exact"), ("scriptStep:Post Invoice:0001", "script:Create Customer", "usesScript", "exact"), ("relationship:Customer_to_Invoice", "field:Invoice::CustomerFK", "usesField", "exact"), ("layout:Invoice Detail", "to:Invoice", "basedOnTableOccurrence", "exact")} <= v1
    assert {("account:admin", "privilegeSet:[Full Access]", "assignedPrivilegeSet", "exact"), ("extPriv:fmwebdirect", "privilegeSet:[Full Access]", "grantedTo", "exact"), ("relationship:Contact__selfJoin__Contact", "field:Contact::ContactID", "usesField", "exact")} <= v2
    assert {("layoutObject:ContactDetail::2", "field:Contacts::firstName", "usesField", "exact"), ("layoutObject:ContactDetail::2", "to:Contacts", "basedOnTableOccurrence", "exact")} <= objects


def test_counts(model):
    n = {f: {r.entityType: r["count"] for r in of(graph.entity_index(model), f).groupBy("entityType").count().collect()} for f in ("a/same.xml", "b/same.xml")}
    assert n["a/same.xml"] == {"table": 2, "field": 9, "tableOccurrence": 3, "relationship": 1, "layout": 2, "layoutObject": 5, "script": 3, "scriptStep": 6, "customFunction": 1, "valueList": 1}
    assert n["b/same.xml"] == {"table": 1, "field": 3, "tableOccurrence": 2, "relationship": 1, "layout": 1, "script": 1, "scriptStep": 2, "customFunction": 1, "valueList": 2, "privilegeSet": 2, "account": 1, "extPriv": 2, "customMenu": 2, "customMenuSet": 1, "theme": 1, "fileRef": 1}
    files = {r.file.rsplit("exports", 1)[1].split("/", 1)[1]: (r.version, r.solution, bool(r.warning)) for r in model.files.collect()}
    assert files == {"a/same.xml": ("19.6.4.402 (build 19.6.4.402)", "SampleSolution", False), "b/same.xml": ("22.0.6", "TestSolution", False), "objects.xml": ("22.0", "Objects", False), "empty.xml": ("unknown", "empty.xml", True)}


def test_details(model):
    one = lambda kind, i: model.entities[kind].where(F.col("docId") == i).first()
    assert one("script", "script:Create Customer").folderPath == "Customer Scripts" and [one("scriptStep", f"scriptStep:Create Customer:{i:04d}").rawText for i in range(3)] == ["Go to Layout [ Customer List ]", "New Record/Request", "Set Field [ Customer::Status ]"]
    assert not one("field", "field:Invoice::Amount").storage["indexed"] and one("field", "field:Customer::Status").autoEnter.asDict() == {"type": "data", "value": "Active", "calculation": None, "no_modify_auto_enter": False}
    assert one("customFunction", "customFunction:DoubleIt").calculation == "n * 2" and one("valueList", "valueList:NameFromField").sourceFieldDocId == "field:Contact::Status" and one("valueList", "valueList:StatusList")["values"] == ["Open", "Closed"]
    assert one("layoutObject", "layoutObject:ContactDetail::2").bounds.asDict() == {"top": 10.0, "left": 120.0, "bottom": 30.0, "right": 320.0}
    assert [r.relationshipType for r in graph.dangling_references(model, model.references).collect()] == [] and {r.docId for r in graph.unused_fields(model, model.references).collect()} >= {"field:Customer::FirstName"}


def test_library(model, folder):
    import quillmesh

    assert quillmesh.load is cli.load
    (r,) = model.entity("field:Customer::Status").collect()
    assert r.dataType == "Text" and model.entity("to:Invoice").first().baseTableDocId == "table:Invoice" and model.entity("nothing:x").count() == 0
    file = r.file
    more = model.with_warning("OWN", "look here", file, "field:Customer::Status")
    assert [(w.code, w.entityDocId) for w in more.warnings.where(F.col("file") == file).orderBy("phase", "place").collect()][-1] == ("OWN", "field:Customer::Status")
    assert more.warnings.count() == model.warnings.count() + 1 and {r.code: r.n for r in graph.warning_histogram(more).collect()}["OWN"] == 1


def test_pages_of_a_folder(model, tmp_path):
    rows = pages.pages(model, "2024-01-01 00:00 UTC")
    export.write_pages(rows, str(tmp_path / "out"))
    made = {os.path.relpath(os.path.join(d, n), tmp_path / "out") for d, _, names in os.walk(tmp_path / "out") for n in names}
    # exports of one name in two folders don't overwrite each other
    assert len(made) == rows.count() and {"a/same.xml/index.md", "b/same.xml/index.md", "objects.xml/index.md"} <= made
    page = (tmp_path / "out/a/same.xml/Scripts/Customer Scripts/Create Customer.md").read_text()
    assert page == """---
docId: script:Create Customer
entityType: script
name: Create Customer
source: same.xml
---

# Script: Create Customer

## Metadata

| Name | Value |
|---|---|
| FMP ID | 1 |
| Folder | Customer Scripts |
| Step Count | 3 |

## Referenced Entities

### Fields

| Field |
|---|
| [Customer::Status](../../Fields/Customer/Status.md) |

### Layouts

| Layout |
|---|
| [Customer List](../../Layouts/Customer List.md) |

## Steps

| # | Enabled | Step |
|---:|---|---|
| 1 | Yes | Go to Layout [ Customer List ] |
| 2 | Yes | New Record/Request |
| 3 | Yes | Set Field [ Customer::Status ] |

## Called By

| Source | Type |
|---|---|
| scriptStep:Post Invoice:0001 | scriptStep |
"""


def test_command_line(spark, folder, tmp_path, capsys):
    xml, out = str(folder / "a" / "same.xml"), str(tmp_path / "docs")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert cli.main(["parse", xml, "--out", str(tmp_path / "m.json")]) == 0
        m = json.loads((tmp_path / "m.json").read_text())
        assert m["source"]["fileMakerVersion"].startswith("19.6") and len(m["references"]) == 42 and m["entities"]["fields"]["field:Customer::LastName"]["validation"]["not_empty"] is True
        assert cli.main(["render", "--model", str(tmp_path / "m.json"), "--out", out]) == 0
        assert os.path.exists(f"{out}/Fields/Customer/Status.md") and os.path.exists(f"{out}/Reports/summary.md")
        with pytest.raises(SystemExit):
            cli.main(["inspect", str(tmp_path / "nothing.xml")])
        capsys.readouterr()
        assert cli.main(["inspect", xml]) == 0 and "references" in capsys.readouterr().out
        assert cli.main(["validate", xml]) == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_executors_without_the_package(tmp_path):
    """Code runs on workers that can't import the package from their folder."""
    (tmp_path / "x.xml").write_text(V1)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from quillmesh.sources.shred import read_exports
print("RECORDS", read_exports(s, "file://{tmp_path}/x.xml").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "RECORDS 3" in got.stdout or int(got.stdout.split("RECORDS ")[1]) > 30, got.stderr[-2000:]
