"""Relational operators of the design pipeline, for any DataFrame: keyed dedupe, ordered distinct, lookups, edges, backlinks, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last row's values at the first row's place (column "pos"). One shuffle and one sort; keys hardly repeat, so a partial aggregation would save nothing."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({"pos": F.first(F.struct(*order)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_more": F.lead(F.lit(True)).over(w)})
    return rows.where("_more is null").select(*keys, "pos", *[c for c in df.columns if c not in keys])


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct keys with the place where each is first seen."""
    return df.groupBy(*keys).agg(F.min(order).alias("first"))


def semi(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def edge(source: Column, source_type: str, target: Column, target_type: str, kind: str, role: Column | None = None, confidence: Column | None = None, raw: Column | None = None) -> list[Column]:
    """The columns of a reference."""
    text = F.lit(None).cast("string")
    return [
        source.alias("sourceDocId"), F.lit(source_type).alias("sourceEntityType"), target.alias("targetDocId"), F.lit(target_type).alias("targetEntityType"), F.lit(kind).alias("relationshipType"),
        (text if role is None else role).alias("role"), (F.lit("exact") if confidence is None else confidence).alias("confidence"), (text if raw is None else raw).alias("rawText"),
    ]


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def backlinks(references: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """References gathered by target, in order.

    A target's links are one row by definition; where a target may have very many, backlink_rows() keeps them as rows.
    """
    link = F.struct(*order, "sourceDocId", "sourceEntityType", "relationshipType", "role", "confidence")
    out = references.groupBy(*by, "targetDocId").agg(F.sort_array(F.collect_list(link)).alias("links"))
    return out.withColumn("links", F.transform("links", lambda x: F.struct(*[x[c].alias(c) for c in ("sourceDocId", "sourceEntityType", "relationshipType", "role", "confidence")])))


def backlink_rows(references: DataFrame) -> DataFrame:
    """The same as a row a link, whatever the number of links to a target."""
    return references.select("targetDocId", "sourceDocId", "sourceEntityType", "relationshipType", "role", "confidence")


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def counts(**tables: DataFrame) -> DataFrame:
    """(entity, n) of each table, empty ones too."""
    one = next(iter(tables.values())).sparkSession.range(1)
    # a row of nothing for each, so that empty ones are counted too
    rows = [df.select(F.lit(name).alias("entity"), F.lit(1).cast("long").alias("n")) for name, df in tables.items()]
    none = one.select(F.explode(F.array(*[F.lit(name) for name in tables])).alias("entity"), F.lit(0).cast("long").alias("n"))
    return union_all(none, *rows).groupBy("entity").agg(F.sum("n").alias("n"))
