"""Sinks and the JSON source: Parquet tables, one JSON document a file with the model's key names, split JSON, page files; and JSON read back."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.graph import backlinks
from ..plans.model import SECTIONS, Model
from ..plans.pages import SCHEMA_VERSION
from .store import Store

#: Kinds that the split export holds.
SPLIT = ("table", "field", "tableOccurrence", "relationship", "layout", "layoutObject", "script", "scriptStep", "customFunction", "valueList", "privilegeSet")
_IDS = {"docId": "string", "entityType": "string"}
_COMMON = {"name": "string", "fmpId": "string"}
#: Columns of each kind in JSON, in order: what follows the id and type.
JSON = {
    "table": {**_COMMON, "uuid": "string", "fields": "array<string>", "tableOccurrences": "array<string>"},
    "field": {
        "name": "string", "qualifiedName": "string", "baseTableDocId": "string", "dataType": "string", "fieldType": "string", "fmpId": "string", "uuid": "string", "calculation": "string",
        "autoEnter": "struct<type:string,value:string,calculation:string,no_modify_auto_enter:boolean>", "validation": "struct<required:boolean,not_empty:boolean,unique:boolean,max_characters:int,message:string>", "storage": "struct<global:boolean,indexed:boolean,maxRepeat:int>",
    },
    "tableOccurrence": {"name": "string", "baseTableDocId": "string", "fmpId": "string", "uuid": "string", "relationships": "array<string>"},
    "relationship": {**_COMMON, "leftTableOccurrenceDocId": "string", "rightTableOccurrenceDocId": "string", "predicates": "array<struct<leftFieldDocId:string,operator:string,rightFieldDocId:string>>", "options": "struct<allowCreateRelated:boolean,deleteRelated:boolean,sortRelated:boolean>"},
    "layout": {**_COMMON, "uuid": "string", "baseTableOccurrenceDocId": "string", "theme": "string", "referencedFields": "array<string>", "layoutObjects": "array<string>"},
    "layoutObject": {
        "layoutDocId": "string", "part": "string", "objectId": "string", "objectType": "string", "kind": "string", "name": "string", "uuid": "string", "bounds": "struct<top:double,left:double,bottom:double,right:double>",
        "fieldDocId": "string", "tableOccurrenceDocId": "string", "rawText": "string",
    },
    "script": {**_COMMON, "uuid": "string", "folderPath": "string", "steps": "array<string>", "referencedFields": "array<string>", "referencedLayouts": "array<string>", "referencedScripts": "array<string>", "warnings": "array<string>"},
    "scriptStep": {"scriptDocId": "string", "index": "int", "stepId": "string", "name": "string", "enabled": "boolean", "rawText": "string", "parameters": "map<string,string>", "references": "array<struct<kind:string,targetDocId:string,role:string,rawText:string>>"},
    "customFunction": {**_COMMON, "uuid": "string", "parameters": "array<string>", "calculation": "string", "references": "array<string>"},
    "valueList": {**_COMMON, "uuid": "string", "listType": "string", "values": "array<string>", "sourceFieldDocId": "string", "secondFieldDocId": "string"},
    "privilegeSet": {**_COMMON, "description": "string"},
    "account": {**_COMMON, "accountType": "string", "enabled": "boolean", "description": "string", "privilegeSetDocId": "string", "privilegeSetName": "string"},
    "extPriv": {**_COMMON, "description": "string", "privilegeSetDocIds": "array<string>"},
    "customMenu": {**_COMMON, "baseMenuName": "string", "installCondition": "string", "browseMode": "boolean", "findMode": "boolean", "previewMode": "boolean", "items": "array<struct<name:string,actionType:string,installCondition:string>>"},
    "customMenuSet": {**_COMMON, "menuDocIds": "array<string>"},
    "theme": {**_COMMON, "displayName": "string", "group": "string", "defaultTheme": "boolean"},
    "fileRef": {**_COMMON, "refType": "string", "isSelf": "boolean"},
}
_REFERENCE = ["sourceDocId", "sourceEntityType", "targetDocId", "targetEntityType", "relationshipType", "role", "confidence", "rawText"]
_OPTIONS = {"ignoreNullFields": "false"}


def entity_json(kind: str, df: DataFrame) -> DataFrame:
    """(file, pos, docId, json) of a kind's entities."""
    have = set(df.columns)
    empty = {"array<string>": F.array().cast("array<string>"), "map<string,string>": F.create_map().cast("map<string,string>")}
    cols = [F.col("docId"), F.lit(kind).alias("entityType"), *[(F.col(c) if c in have else empty[t]).alias(c) for c, t in JSON[kind].items()]]
    if "xpath" in have and kind != "scriptStep":
        cols.append(F.struct(F.col("xpath").alias("path"), F.lit(None).cast("int").alias("line")).alias("sourceXml"))
    text = F.to_json(F.struct(*cols), _OPTIONS)
    if kind == "scriptStep":
        # a reference without raw text has no such key
        text = F.replace(text, F.lit(',"rawText":null}'), F.lit("}"))
    return df.select("file", F.struct("pos.ord", "pos.idx").alias("pos"), "docId", text.alias("json"))


def _joined(df: DataFrame, name: str, order: str, text: Column, opening: str = "{", closing: str = "}") -> DataFrame:
    """(file, name): the rows' JSON pieces of each file in order."""
    got = df.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), ",").alias(name))
    return got.select("file", F.concat(F.lit(opening), name, F.lit(closing)).alias(name))


def _keyed(c: str, json_: str) -> Column:
    k = F.to_json(F.array(c))
    return F.concat(F.substr(k, F.lit(2), F.length(k) - 2), F.lit(":"), F.col(json_))


def json_parts(model: Model) -> DataFrame:
    """(file, entities, split, references, backlinks, warnings) as JSON texts: one row a file, since its JSON is one document."""
    out = model.files.select("file")
    for kind, df in model.entities.items():
        rows = entity_json(kind, df)
        out = out.join(_joined(rows, kind, "pos", _keyed("docId", "json")), "file", "left")
    whole = lambda kinds: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{SECTIONS[k]}":'), F.coalesce(k, F.lit("{}"))) for k in kinds]), F.lit("}"))
    out = out.select("file", whole(SECTIONS).alias("entities"), whole(SPLIT).alias("split"))
    refs = model.references.withColumn("json", F.to_json(F.struct(*_REFERENCE), _OPTIONS))
    warn = model.warnings.withColumn("at", F.struct("phase", "place")).withColumn("json", F.to_json(F.struct("code", "message", "entityDocId", "detail"), _OPTIONS))
    # targets in the order in which they are first referred to
    back = backlinks(model.references).withColumn("json", F.to_json("links", _OPTIONS)).join(model.references.groupBy("file", "targetDocId").agg(F.min("at").alias("at")), ["file", "targetDocId"])
    out = out.join(_joined(refs, "references", "at", F.col("json"), "[", "]"), "file", "left").join(_joined(back, "backlinks", "at", _keyed("targetDocId", "json")), "file", "left").join(_joined(warn, "warnings", "at", F.col("json"), "[", "]"), "file", "left")
    return out.withColumns({"references": F.coalesce("references", F.lit("[]")), "backlinks": F.coalesce("backlinks", F.lit("{}")), "warnings": F.coalesce("warnings", F.lit("[]"))})


def documents(model: Model, generated: str) -> DataFrame:
    """(file, json): each file's whole model."""
    source = F.struct(F.lit("FileMakerSaveAsXML").alias("type"), F.col("fileName"), F.col("version").alias("fileMakerVersion"), F.lit(generated).alias("generatedAt"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("sourceModifiedAt"))
    head = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schemaVersion"), source.alias("source"), F.struct(F.col("solution").alias("name"), F.array().cast("array<string>").alias("files")).alias("solution")), _OPTIONS)
    rows = model.files.join(json_parts(model), "file")
    rest = F.concat(*[x for k in ("entities", "references", "backlinks", "warnings") for x in (F.lit(f',"{k}":'), F.col(k))], F.lit("}"))
    return rows.select("file", F.concat(F.substr(head, F.lit(1), F.length(head) - 1), rest).alias("json"))


def write_tables(model: Model, path: str) -> None:
    """All tables as Parquet below path: the form in which many files are kept."""
    for name, df in {**{f"entities/{k}": v for k, v in model.entities.items()}, "files": model.files, "references": model.references, "warnings": model.warnings, "backlinks": backlinks(model.references)}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_json(df: DataFrame, path: str, column: str = "json") -> None:
    """The single row's JSON, indented by two, as a local file: for the command line, which handles one export."""
    (row,) = df.select(column).collect()
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(row[0]), f, indent=2, ensure_ascii=False)


def write_split_json(model: Model, folder: str) -> None:
    """entities.json, references.json, backlinks.json of a single export."""
    parts = json_parts(model).drop("entities").withColumnRenamed("split", "entities").persist()
    for k in ("entities", "references", "backlinks"):
        write_json(parts, os.path.join(folder, f"{k}.json"), k)
    parts.unpersist()


def write_pages(pages: DataFrame, folder: str) -> None:
    """Each page a file below a folder that all executors share; with several exports each has a folder named by its path below their common one."""
    least, most = pages.agg(F.min("file"), F.max("file")).first()
    # what the first and the last path share, all share
    common = os.path.commonprefix([least or "", most or ""])
    skip = common.rfind("/") + 1

    def run(rows) -> None:
        for r in rows:
            to = os.path.join(folder, *([r.file[skip:]] if least != most else []), r.path)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "w", encoding="utf-8") as f:
                f.write(r.content)

    pages.foreachPartition(run)


def _schema() -> T.StructType:
    def entity(kind: str) -> str:
        cols = {**_IDS, **JSON[kind], **({} if kind == "scriptStep" else {"sourceXml": "struct<path:string,line:int>"})}
        return "struct<" + ",".join(f"`{k}`:{v}" for k, v in cols.items()) + ">"

    entities = ",".join(f"`{section}`:map<string,{entity(kind)}>" for kind, section in SECTIONS.items())
    refs = "array<struct<" + ",".join(f"{c}:string" for c in _REFERENCE) + ">>"
    text = f"schemaVersion string, source struct<type:string,fileName:string,fileMakerVersion:string,generatedAt:string,sourceModifiedAt:string>, solution struct<name:string,files:array<string>>, entities struct<{entities}>, `references` {refs}, warnings array<struct<code:string,message:string,entityDocId:string,detail:string>>"
    return T._parse_datatype_string(text)


def read_documents(spark, path: str, store: Store) -> Model:
    """Models from their JSON documents."""
    docs = spark.read.schema(_schema()).option("multiLine", "true").json(path).withColumn("file", F.input_file_name())
    docs = store.keep("documents", docs)
    zero = F.lit(0)
    place = lambda n: F.struct(F.col(n).alias("ord"), zero.alias("idx"))
    entities = {}
    for kind, section in SECTIONS.items():
        x = docs.select("file", F.posexplode(F.map_entries(f"entities.{section}")).alias("n", "x")).select("file", place("n").alias("pos"), F.col("n").alias("ord"), zero.alias("idx"), F.col("x.value.*"))
        x = x.withColumn("xpath", F.lit(None).cast("string") if kind == "scriptStep" else F.col("sourceXml.path")).drop("sourceXml", "entityType")
        entities[kind] = x.withColumn("table", F.expr("substring(baseTableDocId, 7)")) if kind == "field" else x
    files = docs.select("file", F.try_to_timestamp("source.sourceModifiedAt").alias("modified"), "source.fileName", F.col("source.fileMakerVersion").alias("version"), F.col("solution.name").alias("solution"), F.lit(None).cast("string").alias("warning"))
    at = lambda n: F.struct(zero.alias("step"), F.col(n).alias("ord"), zero.alias("idx"), zero.alias("j"))
    refs = docs.select("file", F.posexplode("references").alias("n", "r")).select("file", at("n").alias("at"), "r.*")
    warn = docs.select("file", F.posexplode("warnings").alias("n", "w")).select("file", zero.alias("phase"), at("n").alias("place"), "w.*")
    kept = store.keep_all({**{f"entities/{k}": v for k, v in entities.items()}, "files": files, "references": refs, "warnings": warn})
    return Model(kept["files"], {k: kept[f"entities/{k}"] for k in SECTIONS}, kept["warnings"].limit(0), store, kept["references"], kept["warnings"])

