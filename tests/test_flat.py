"""Records of the large kinds are read as values where a file is parsed: the same as those of their subtrees."""

import pytest

from quillmesh import catalog, designs
from quillmesh.plans import model
from quillmesh.sources import flat, shred
from tests.test_lazy import made  # noqa: F401
from tests.test_lean import ODD
from tests.test_queries import SF

CASES = b"""<FMSaveAsXML xmlns:q="u"><File><Database><RelationshipGraph><TableOccurrenceCatalog><TableOccurrence ID="1" NAME=" T " q:uuid="U"><UUID> v </UUID><BaseTableSourceReference/><BaseTableSourceReference><BaseTableReference id="9"/></BaseTableSourceReference></TableOccurrence></TableOccurrenceCatalog>
<RelationshipCatalog><Relationship id=""><LeftTable ID="1" name=""><TableOccurrenceReference NAME="A"/></LeftTable><RightTable/><Options CreateRelated="True"/><JoinPredicateList><x><JoinPredicate TYPE="2"><LeftField name=""><FieldReference name="f"><TableOccurrenceReference name="A"/></FieldReference></LeftField></JoinPredicate></x>
<Relationship><JoinPredicate/></Relationship><JoinPredicate op=""><RightField NAME="g" table="B"/></JoinPredicate></JoinPredicateList></Relationship></RelationshipCatalog></RelationshipGraph>
<LayoutCatalog><Layout Name="\xc2\xa0L\xe2\x80\x83" tableID=""><TableOccurrenceReference id="1" Name="T"/><Object Type="Field" ID="7"><FieldObj/><FieldObj><Name field="no"/></FieldObj><Field><Name field="no"/></Field><Bounds TOP="1" Left=""/></Object><Object type="Field"><Field><Name NAME="n" tableId="3"/></Field><Text> t <StyledText><Data/></StyledText></Text></Object></Layout></LayoutCatalog>
<ScriptCatalog><Folder/><Group NAME="g"><Folder name="h"><Script name="S"><StepList><Step INDEX="x" Enabled="no"><w><Field table="a"/></w><Calculation>\n c </Calculation></Step></StepList></Script></Folder></Group></ScriptCatalog></Database></File></FMSaveAsXML>"""


@pytest.fixture(scope="module")
def both(spark):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in (ODD | {"cases": CASES}).items()], "path string, content binary").selectExpr("path", "timestamp '2024-01-02' AS modificationTime", "content")
    files = files.unionByName(designs.exports(spark, SF)).coalesce(8).cache()
    return shred.shred(files).cache(), shred.shred(files, flat=True).cache()


@pytest.mark.parametrize("kind", sorted(flat.FLAT))
def test_same_values(both, kind):
    nodes, values = (sorted(map(repr, model._flat(r, kind).collect())) for r in both)
    assert nodes == values and any("cases" in r for r in nodes) == (kind != "stepSet")


def test_spaces_at_ends(spark):
    df = spark.createDataFrame([(x,) for x in (" a ", "a", "", None, " a b ", "é", " é", "a\n", "\t", "~!", " ")], "x string")
    assert all(r[0] == r[1] for r in df.select(model._stripped(df.x), model.strip(df.x)).collect())


def test_other_kinds_keep_their_nodes(both):
    nodes, values = (sorted(map(repr, r.where("kind in ('file', 'table', 'field', 'customFunction')").select(*both[0].columns).collect())) for r in both)
    assert nodes == values


def test_files_are_parsed_once(spark, made):  # noqa: F811
    """Where both large sets of kinds are asked for, all are read in one pass."""
    for name in ("design_backlinks", "design_warnings"):
        made.clear()
        designs._MODELS.clear()
        catalog.QUERIES[name](spark, SF)
        assert len([n for n in made if n.startswith("records/")]) == 1
