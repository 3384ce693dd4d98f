"""Queries over the driver's tables, one for each operator of the design pipeline, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import relational as R

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, d, name, *columns):
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


@query("SELECT n_nationkey, concat('table:', n_name) AS doc_id FROM nation")
def doc_ids_flat(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", S.doc_id("table", "n_name").alias("doc_id"))


@query("SELECT n_nationkey, concat('field:', r_name, '::', n_name) AS doc_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def doc_ids_qualified(spark, d):
    return _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", S.doc_id("field", "r_name", "n_name").alias("doc_id"))


@query("SELECT l_orderkey, l_linenumber, concat('scriptStep:', l_orderkey, ':', printf('%04d', l_linenumber)) AS doc_id FROM lineitem")
def doc_ids_step(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.numbered("scriptStep", F.col("l_orderkey").cast("string"), F.col("l_linenumber")).alias("doc_id"))


@query("SELECT p_partkey, concat('layoutObject:', p_brand, '::', CASE WHEN p_size > 25 THEN CAST(p_partkey AS VARCHAR) ELSE concat('idx', printf('%04d', p_size)) END) AS doc_id FROM part")
def doc_ids_fallback(spark, d):
    at = F.when(F.col("p_size") > 25, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lit("idx"), F.format_string("%04d", "p_size")))
    return _t(spark, d, "part").select("p_partkey", S.doc_id("layoutObject", "p_brand", at).alias("doc_id"))


@query("SELECT p_partkey, p_name AS name FROM (SELECT p_partkey, trim(p_name) AS p_name FROM part)")
def strip_names(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.strip(F.concat(F.lit(" \t "), "p_name", F.lit(" \n"))).alias("name"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[. ]+', ''), '[. ]+$', ''), ''), '_') AS slug FROM pages""")
def safe_slugs(spark, d):
    return _t(spark, d, "pages").select("page_id", S.safe_slug(F.col("url")).alias("slug"))


@query(r"SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(url, '\', '/'), '/'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM pages")
def folder_parts(spark, d):
    return _t(spark, d, "pages").select("page_id", F.concat_ws("|", S.folder_parts(F.col("url"))).alias("parts"))


@query("""WITH p AS (SELECT n_nationkey AS k, r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT a.k AS a, b.k AS b, concat('[', b.n, '](', CASE WHEN a.r = b.r THEN concat(b.n, '.md') ELSE concat('../', b.r, '/', b.n, '.md') END, ')') AS link,
  concat('../../Tables/', b.r, '.md') AS up FROM p a JOIN p b ON true""")
def relative_links(spark, d):
    p = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), "r_name", "n_name", F.concat(F.lit("Fields/"), "r_name", F.lit("/"), "n_name", F.lit(".md")).alias("path"))
    a, b = p.select(F.col("k").alias("a"), F.col("path").alias("src")), p.select(F.col("k").alias("b"), "r_name", "n_name", F.col("path").alias("dst"))
    up = S.relative_path(F.col("src"), F.concat(F.lit("Tables/"), "r_name", F.lit(".md")))
    # nation and region are fixed in size: every nation's page links to every other's
    return a.join(F.broadcast(b)).select("a", "b", S.md_link(F.col("n_name"), S.relative_path(F.col("src"), F.col("dst"))).alias("link"), up.alias("up"))


_FLAG = "CASE o_orderkey % 7 WHEN 0 THEN 'True' WHEN 1 THEN 'true' WHEN 2 THEN 'False' WHEN 3 THEN '0' WHEN 4 THEN '' WHEN 5 THEN 'No' END"


@query(f"""SELECT o_orderkey, coalesce(f = 'True', false) AS exact, coalesce(lower(f) = 'true', false) AS lowered, lower(coalesce(f, 'True')) NOT IN ('false', '0', 'no') AS on_by_default,
  lower(coalesce(f, 'False')) NOT IN ('false', '0', 'no') AS off_by_default, lower(coalesce(f, '')) NOT IN ('', 'none', 'false') AS indexed FROM (SELECT o_orderkey, {_FLAG} AS f FROM orders)""")
def bool_coercions(spark, d):
    f = F.expr(_FLAG)
    return _t(spark, d, "orders").select("o_orderkey", S.is_true(f).alias("exact"), F.coalesce(F.lower(f) == "true", F.lit(False)).alias("lowered"), S.not_off(f, "True").alias("on_by_default"), S.not_off(f, "False").alias("off_by_default"), S.indexed(f).alias("indexed"))


@query("""SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN regexp_matches(v, '^ *[+-]?[0-9]+ *$') THEN trim(v) END AS INTEGER), 1) AS n FROM
  (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat(' ', o_orderkey, ' ') WHEN 1 THEN concat(o_orderkey, '.5') WHEN 2 THEN 'x' END AS v FROM orders)""")
def int_coercions(spark, d):
    v = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat(' ', o_orderkey, ' ') WHEN 1 THEN concat(o_orderkey, '.5') WHEN 2 THEN 'x' END")
    return _t(spark, d, "orders").select("o_orderkey", S.whole_number(v, 1).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, first_part, l_partkey AS last_part, l_suppkey AS last_supp FROM (
  SELECT *, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS first_part, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1""")
def last_wins_entities(spark, d):
    rows = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return R.last_wins(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", F.col("pos.l_partkey").alias("first_part"), F.col("l_partkey").alias("last_part"), F.col("l_suppkey").alias("last_supp"))


@query("SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role")
def first_seen_distinct(spark, d):
    return R.first_seen(_t(spark, d, "conversations", "conv_id", "role", "turn"), ["conv_id", "role"], "turn")


@query("""SELECT c_custkey, coalesce(n_name, concat('nation:', k)) AS nation, coalesce(r_name, n_name, 'none') AS region FROM
  (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_nationkey + 1000 ELSE c_nationkey END AS k, c_mktsegment FROM customer)
  LEFT JOIN nation ON k = n_nationkey LEFT JOIN region ON CASE WHEN c_mktsegment = 'MACHINERY' THEN n_regionkey + 1000 ELSE n_regionkey END = r_regionkey""")
def lookup_join_chain(spark, d):
    # keys that the lookup tables lack, by a rule on the row that looks up
    key = F.when(F.col("c_acctbal") < 0, F.col("c_nationkey") + 1000).otherwise(F.col("c_nationkey"))
    then = F.when(F.col("c_mktsegment") == "MACHINERY", F.col("n_regionkey") + 1000).otherwise(F.col("n_regionkey"))
    c = _t(spark, d, "customer", "c_custkey", "c_mktsegment", key.alias("k")).join(_t(spark, d, "nation"), F.col("k") == F.col("n_nationkey"), "left").withColumn("then", then).join(_t(spark, d, "region"), F.col("then") == F.col("r_regionkey"), "left")
    return c.select("c_custkey", F.coalesce("n_name", F.concat(F.lit("nation:"), "k")).alias("nation"), F.coalesce("r_name", "n_name", F.lit("none")).alias("region"))


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_edges(spark, d):
    return R.semi(_t(spark, d, "documents", "doc_id", "lang"), _t(spark, d, "labels", "doc_id"), "doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_docs(spark, d):
    return R.anti(_t(spark, d, "documents", "doc_id", "lang"), _t(spark, d, "labels", "doc_id"), "doc_id")


_CONTAINS = """SELECT concat('region:', r_name) AS "sourceDocId", 'region' AS "sourceEntityType", concat('nation:', n_name) AS "targetDocId", 'nation' AS "targetEntityType", 'contains' AS "relationshipType", CAST(NULL AS VARCHAR) AS "role", 'exact' AS "confidence", CAST(NULL AS VARCHAR) AS "rawText" FROM region JOIN nation ON r_regionkey = n_regionkey"""
_EDGES = f"""{_CONTAINS}
UNION ALL SELECT concat('supplier:', s_suppkey), 'supplier', concat('nation:', n_name), 'nation', 'basedOn', NULL, 'exact', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('customer:', c_custkey), 'customer', concat('nation:', k), 'nation', 'usesNation', 'target', CASE WHEN n_nationkey IS NULL THEN 'unresolved' ELSE 'exact' END, c_mktsegment FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN c_nationkey + 1000 ELSE c_nationkey END AS k FROM customer) LEFT JOIN nation ON k = n_nationkey"""


def _contains(spark, d):
    j = _t(spark, d, "region").join(_t(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.select(R.edge(S.doc_id("region", "r_name"), "region", S.doc_id("nation", "n_name"), "nation", "contains"))


def _edges(spark, d):
    nation = _t(spark, d, "nation")
    supplier = _t(spark, d, "supplier", "s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.when(F.col("c_acctbal") < 0, F.col("c_nationkey") + 1000).otherwise(F.col("c_nationkey"))
    customer = _t(spark, d, "customer", "c_custkey", "c_mktsegment", key.alias("k")).join(nation, F.col("k") == F.col("n_nationkey"), "left")
    sure = F.when(F.col("n_nationkey").isNull(), "unresolved").otherwise("exact")
    return R.union_all(
        _contains(spark, d),
        supplier.select(R.edge(S.doc_id("supplier", "s_suppkey"), "supplier", S.doc_id("nation", "n_name"), "nation", "basedOn")),
        customer.select(R.edge(S.doc_id("customer", "c_custkey"), "customer", S.doc_id("nation", F.col("k").cast("string")), "nation", "usesNation", F.lit("target"), sure, F.col("c_mktsegment"))),
    )


@query(_CONTAINS)
def contains_edges(spark, d):
    return _contains(spark, d)


@query(_EDGES)
def edge_union(spark, d):
    return _edges(spark, d)


@query(f'SELECT "relationshipType", "confidence", count(*) AS n FROM ({_EDGES}) GROUP BY ALL')
def reference_confidence(spark, d):
    return _edges(spark, d).groupBy("relationshipType", "confidence").agg(F.count("*").alias("n"))


@query(f'SELECT "targetDocId", "sourceDocId", "sourceEntityType", "relationshipType", "role", "confidence" FROM ({_EDGES})')
def backlinks(spark, d):
    """A row a link, whatever the number of a target's links; gathered ones: design_backlinks."""
    return R.backlink_rows(_edges(spark, d))


@query(f'SELECT "targetDocId", count(*) AS n, count(*) FILTER (WHERE "confidence" = \'unresolved\') AS unresolved FROM ({_EDGES}) GROUP BY 1')
def backlink_counts(spark, d):
    return _edges(spark, d).groupBy("targetDocId").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "unresolved").alias("unresolved"))


@query("""SELECT p_partkey, concat('part:', p_partkey) AS doc_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""")
def unreferenced_entities(spark, d):
    used = _t(spark, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return R.anti(_t(spark, d, "part", "p_partkey"), used, "p_partkey").select("p_partkey", S.doc_id("part", "p_partkey").alias("doc_id"))


_CALC = "concat(c_mktsegment, '::', replace(c_name, '#', '_'), ' + Upper(', c_mktsegment, '::seg_', c_nationkey, ') & if (x)')"


@query(f"""SELECT c_custkey, array_to_string(list_transform(list_zip(regexp_extract_all(t, '([A-Za-z_][A-Za-z0-9_ ]*)::([A-Za-z_][A-Za-z0-9_ ]*)', 1), regexp_extract_all(t, '([A-Za-z_][A-Za-z0-9_ ]*)::([A-Za-z_][A-Za-z0-9_ ]*)', 2)), lambda x: concat(trim(x[1]), '::', trim(x[2]))), '|') AS refs
  FROM (SELECT c_custkey, {_CALC} AS t FROM customer)""")
def calc_field_refs(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.concat_ws("|", F.transform(S.field_refs(F.expr(_CALC)), lambda x: F.concat_ws("::", x["table"], x["field"]))).alias("refs"))


@query(r"""SELECT page_id, name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) AS name FROM pages) GROUP BY page_id, name""")
def calc_function_calls(spark, d):
    return _t(spark, d, "pages", "page_id", "html").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(S.CALL), 1)).alias("name")).groupBy("page_id", "name").agg(F.count("*").alias("n"))


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id, href""")
def markup_attrs(spark, d):
    return _t(spark, d, "pages", "page_id", "html").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages")) + " UNION ALL SELECT 'nothing', count(*) FROM region WHERE false")
def entity_counts(spark, d):
    tables = {t: _t(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages")}
    return R.counts(**tables, nothing=tables["region"].where("false"))


@query("""SELECT code, count(*) AS n FROM (SELECT 'NO_LABEL' AS code FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'SHORT_TEXT' FROM documents WHERE n_chars < 100
  UNION ALL SELECT 'LOW_QUALITY' FROM labels WHERE quality = 0) GROUP BY code""")
def warning_histogram(spark, d):
    docs, labels = _t(spark, d, "documents", "doc_id", "n_chars"), _t(spark, d, "labels")
    code = lambda df, c: df.select(F.lit(c).alias("code"))
    return R.histogram(R.union_all(code(R.anti(docs, labels, "doc_id"), "NO_LABEL"), code(docs.where("n_chars < 100"), "SHORT_TEXT"), code(labels.where("quality = 0"), "LOW_QUALITY")), "code")


@query(f"""SELECT count(*) FILTER (WHERE "confidence" = 'exact') AS exact, count(*) FILTER (WHERE "confidence" = 'parsed') AS parsed, count(*) FILTER (WHERE "confidence" = 'unresolved') AS unresolved, count(*) AS total FROM ({_EDGES})""")
def confidence_histogram(spark, d):
    return _edges(spark, d).agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in ("exact", "parsed", "unresolved")], F.count("*").alias("total"))


@query("""SELECT n_name AS name, row_number() OVER (ORDER BY lower(n_name), n_nationkey) AS rank, concat('- [', n_name, '](', n_name, '.md)') AS line FROM nation""")
def section_index(spark, d):
    # nation is fixed in size; a section's pages are ranked by a global sort elsewhere (plans.pages)
    w = Window.orderBy(F.lower("n_name"), "n_nationkey")
    return _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.row_number().over(w).cast("long").alias("rank"), F.concat(F.lit("- ["), "n_name", F.lit("]("), "n_name", F.lit(".md)")).alias("line"))


@query("SELECT conv_id, turn + 1 AS number, role FROM conversations")
def steps_numbered(spark, d):
    return _t(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("number"), "role")


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN role WHEN role = 'user' THEN concat(role, ' [ ', conv_id, '::', turn, ' ]') ELSE concat(role, ' [ ', substr(text, 1, 80), ' ]') END AS raw FROM conversations""")
def step_raw_text(spark, d):
    inner = F.when(F.col("role") == "user", F.concat_ws("::", "conv_id", "turn")).otherwise(F.substring("text", 1, 80))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", F.col("role")).otherwise(F.concat("role", F.lit(" [ "), inner, F.lit(" ]"))).alias("raw"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def empty_parents(spark, d):
    return R.anti(_t(spark, d, "orders", "o_orderkey"), _t(spark, d, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").where("l_returnflag = 'R'"), "o_orderkey")


@query("SELECT r_name, count(*) AS n, string_agg(n_name, ', ' ORDER BY lower(n_name), n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def group_pages(spark, d):
    j = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.sort_array(F.collect_list(F.struct(F.lower("n_name").alias("l"), F.col("n_name").alias("n"))))
    return j.groupBy("r_name").agg(F.count("*").alias("n"), F.concat_ws(", ", F.transform(names, lambda x: x.n)).alias("names"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'not a time' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M UTC') END AS shown FROM orders""")
def iso_dates(spark, d):
    iso = F.when(F.col("o_orderkey") % 3 == 0, F.lit("not a time")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return _t(spark, d, "orders").select("o_orderkey", S.iso_minute(iso).alias("shown"))


@query(r"""SELECT item_id, CASE WHEN length(text) <= 125 THEN text ELSE concat(regexp_replace(substr(text, 1, 117), '(?s)^(.*) [^ ]*$', '\1'), '...') END AS short FROM benchmark""")
def shortened_texts(spark, d):
    return _t(spark, d, "benchmark").select("item_id", S.shorten(F.col("text"), 120).alias("short"))


@query("""SELECT o_orderpriority AS op, count(*) AS n FROM (SELECT CASE code WHEN 0 THEN '=' WHEN 1 THEN '!=' WHEN 2 THEN '<' WHEN 3 THEN '<=' WHEN 4 THEN '>' WHEN 5 THEN '>=' WHEN 6 THEN 'cartesian' ELSE lower(o_orderpriority) END AS o_orderpriority FROM (SELECT o_orderkey % 9 AS code, o_orderpriority FROM orders)) GROUP BY 1""")
def join_operators(spark, d):
    from .plans.model import operator_name

    code = F.when(F.col("o_orderkey") % 9 < 7, (F.col("o_orderkey") % 9).cast("string")).otherwise(F.col("o_orderpriority"))
    return R.histogram(_t(spark, d, "orders").select(operator_name(code).alias("op")), "op")
