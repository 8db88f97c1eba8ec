"""Registered queries and their SQL oracles: every operator over XML made from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.functions import values as V
from xylem.operators import dtd, edit, navigate, serialize, xinclude
from xylem.plans.xpath import xpath
from xylem.sources import corpora, encodings, shred
from xylem.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Items as the orders corpus has them, in SQL.
ITEMS = """WITH i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
    count(*) OVER (PARTITION BY l_orderkey) AS m, l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status,
    CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) """
PARTS = """WITH p AS (SELECT p_partkey AS doc_id, p_name AS name, '  ' || replace(p_name, ' ', '  ') || ' ' AS raw, p_brand AS brand, p_size AS size,
    CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part) """
CUSTOMERS = "WITH c AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey AS id, c_mktsegment AS seg, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS bal FROM customer) "


def register(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def path(name: str, corpus: str, expression: str, oracle: str, **options) -> None:
    """An expression whose result is (doc_id, value)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return xpath(corpora.shredded(spark, sf_dir, corpus), expression, **options).select("doc_id", "value")

    register(name, oracle)(run)


def item_path(name: str, expression: str, select: str) -> None:
    path(name, "orders", expression, ITEMS + select)


@register("xpath_returned_items", ITEMS + "SELECT doc_id, count(*) AS n, CAST(sum(qty) AS DOUBLE) AS total FROM i WHERE flag = 'R' GROUP BY doc_id")
def returned_items(spark, sf_dir):
    found = xpath(corpora.shredded(spark, sf_dir, "orders"), "//item[@flag='R']/qty")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(V.to_number(F.col("value"))).alias("total"))


# axes
item_path("axis_child", "/order/item/qty", "SELECT doc_id, qty::VARCHAR AS value FROM i")
item_path("axis_descendant", "/descendant::cents", "SELECT doc_id, cents::VARCHAR AS value FROM i")
item_path("axis_attribute", "//item/@flag", "SELECT doc_id, flag AS value FROM i")
item_path("axis_parent", "//qty[. > 45]/parent::item/@n", "SELECT doc_id, n::VARCHAR AS value FROM i WHERE qty > 45")
item_path("axis_self", "//item/self::item/qty", "SELECT doc_id, qty::VARCHAR AS value FROM i")
item_path("axis_ancestor", "count(//cents/ancestor::*)", "SELECT doc_id, count(*) + 1.0::DOUBLE AS value FROM i GROUP BY doc_id")
item_path("axis_ancestor_or_self", "count(//cents/ancestor-or-self::*)", "SELECT doc_id, 2 * count(*) + 1.0::DOUBLE AS value FROM i GROUP BY doc_id")
item_path("axis_descendant_or_self", "count(//item/descendant-or-self::node())", "SELECT doc_id, 5.0::DOUBLE * count(*) AS value FROM i GROUP BY doc_id")
item_path("axis_following_sibling", "//item/following-sibling::item[1]/qty", "SELECT doc_id, qty::VARCHAR AS value FROM i WHERE n > 1")
item_path("axis_preceding_sibling", "//item[last()]/preceding-sibling::item[1]/qty", "SELECT doc_id, qty::VARCHAR AS value FROM i WHERE n = m - 1")
item_path("axis_following", "count(//item[1]/following::*)", "SELECT doc_id, 3.0::DOUBLE * (count(*) - 1) AS value FROM i GROUP BY doc_id")
item_path("axis_preceding", "count(//item[last()]/preceding::*)", "SELECT doc_id, 3.0::DOUBLE * (count(*) - 1) AS value FROM i GROUP BY doc_id")
path("axis_namespace", "geography", "count(//g:region[1]/namespace::*)", "SELECT 1::BIGINT AS doc_id, 3.0::DOUBLE AS value", match="local")
# predicates
item_path("predicate_position", "/order/item[2]/@line", "SELECT doc_id, line::VARCHAR AS value FROM i WHERE n = 2")
item_path("predicate_last", "/order/item[last()]/cents", "SELECT doc_id, cents::VARCHAR AS value FROM i WHERE n = m")
item_path("predicate_position_range", "/order/item[position() < 3]/qty", "SELECT doc_id, qty::VARCHAR AS value FROM i WHERE n < 3")
item_path("predicate_chain", "//item[@flag='R'][2]/@n", ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM i WHERE flag = 'R') SELECT doc_id, n::VARCHAR AS value FROM r WHERE k = 2")
item_path("predicate_boolean", "//item[@flag='R' and qty > 30 or @status='F' and not(qty > 5)]/@n", "SELECT doc_id, n::VARCHAR AS value FROM i WHERE flag = 'R' AND qty > 30 OR status = 'F' AND NOT qty > 5")
item_path("predicate_exists", "/order[item/qty[. = 50]]/@id", "SELECT doc_id, doc_id::VARCHAR AS value FROM i WHERE qty = 50 GROUP BY doc_id")
item_path("predicate_not_exists", "/order[not(item[@flag='R'])]/@id", "SELECT doc_id, doc_id::VARCHAR AS value FROM i GROUP BY doc_id HAVING count(*) FILTER (flag = 'R') = 0")
item_path("filter_expression", "(//item)[2]/qty", "SELECT doc_id, qty::VARCHAR AS value FROM i WHERE n = 2")
item_path("compare_any_pair", "boolean(//item[@n=1]/qty = //item[@n > 1]/qty)", "SELECT a.doc_id, max(CASE WHEN a.qty = b.qty THEN 1 ELSE 0 END) = 1 AS value FROM i a LEFT JOIN i b ON a.doc_id = b.doc_id AND b.n > 1 WHERE a.n = 1 GROUP BY a.doc_id")
item_path("compare_not_equal", "//qty != //item[1]/qty", "SELECT doc_id, count(DISTINCT qty) > 1 AS value FROM i GROUP BY doc_id")
item_path("compare_nodes_less", "//item[1]/cents < //item[last()]/cents", "SELECT doc_id, max(CASE WHEN n = 1 THEN cents END) < max(CASE WHEN n = m THEN cents END) AS value FROM i GROUP BY doc_id")
item_path("union", "//item[@flag='R']/qty | //item[qty > 25]/qty | //item[1]/cents", "SELECT doc_id, qty::VARCHAR AS value FROM i WHERE flag = 'R' OR qty > 25 UNION ALL SELECT doc_id, cents::VARCHAR FROM i WHERE n = 1")
# aggregation and node functions
item_path("function_count", "count(//item)", "SELECT doc_id, count(*)::DOUBLE AS value FROM i GROUP BY doc_id")
item_path("function_sum", "sum(//cents)", "SELECT doc_id, sum(cents)::DOUBLE AS value FROM i GROUP BY doc_id")
item_path("function_name", "name(/order/*[1]/@*[2])", "SELECT DISTINCT doc_id, 'line' AS value FROM i")
item_path("function_string_first", "string(//qty)", "SELECT doc_id, qty::VARCHAR AS value FROM i WHERE n = 1")
item_path("string_value_element", "string(/order/item[1])", "SELECT doc_id, qty::VARCHAR || cents::VARCHAR AS value FROM i WHERE n = 1")
item_path("arithmetic", "(sum(//cents) - 2 * count(//item)) div 4 + -1", "SELECT doc_id, (sum(cents) - 2.0::DOUBLE * count(*)) / 4 - 1 AS value FROM i GROUP BY doc_id")
item_path("modulo", "sum(//qty) mod 7", "SELECT doc_id, (sum(qty)::BIGINT % 7)::DOUBLE AS value FROM i GROUP BY doc_id")
item_path("variables", "//item[qty > $least]/@n", "SELECT doc_id, n::VARCHAR AS value FROM i WHERE qty > 40")
QUERIES["variables"] = lambda spark, sf_dir: xpath(corpora.shredded(spark, sf_dir, "orders"), "//item[qty > $least]/@n", variables={"least": 40}).select("doc_id", "value")
path("function_id", "customers", "id(//c[1]/@id)/name", CUSTOMERS + "SELECT doc_id, min_by(name, id) AS value FROM c GROUP BY doc_id")
path("function_lang", "geography", "count(//nation[lang('en')])", "SELECT 1::BIGINT AS doc_id, count(*)::DOUBLE AS value FROM nation WHERE n_regionkey % 2 = 0", match="local")
path("function_namespace_uri", "geography", "namespace-uri(/world/*[1])", "SELECT 1::BIGINT AS doc_id, 'urn:geo' AS value", match="local")
path("namespaces_by_uri", "geography", "//x:region/@id", "SELECT 1::BIGINT AS doc_id, 'r' || r_regionkey AS value FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)", namespaces={"x": "urn:geo"})
path("prefix_match", "geography", "//g:region/nation[last()]", "SELECT 1::BIGINT AS doc_id, max_by(n_name, n_nationkey) AS value FROM nation GROUP BY n_regionkey")
# string, number and boolean functions, one per query
for _name, _expr, _sql in (
    ("normalize_space", "normalize-space(name)", "name"),
    ("concat", "concat(brand, '-', size)", "brand || '-' || size"),
    ("starts_with", "starts-with(normalize-space(name), 'small')", "starts_with(name, 'small')"),
    ("contains", "contains(brand, '1')", "contains(brand, '1')"),
    ("substring_before", "substring-before(normalize-space(name), ' ')", "CASE WHEN contains(name, ' ') THEN split_part(name, ' ', 1) ELSE '' END"),
    ("substring_after", "substring-after(brand, '#')", "CASE WHEN contains(brand, '#') THEN substr(brand, strpos(brand, '#') + 1) ELSE '' END"),
    ("substring", "substring(brand, 2, 3)", "substr(brand, 2, 3)"),
    ("string_length", "string-length(name)", "length(raw)::DOUBLE"),
    ("translate", "translate(brand, 'Brand#', 'bR')", "replace(replace(replace(replace(replace(replace(brand, 'r', 'R'), 'a', ''), 'n', ''), 'd', ''), '#', ''), 'B', 'b')"),
    ("number", "number(size) + 0.5", "size + 0.5::DOUBLE"),
    ("string_of_number", "string(cents div 8)", None),
    ("floor", "floor(cents div 7)", "floor(cents / 7.0::DOUBLE)"),
    ("ceiling", "ceiling(cents div 7)", "ceil(cents / 7.0::DOUBLE)"),
    ("round", "round(cents div 10)", "floor(cents / 10.0::DOUBLE + 0.5)"),
    ("boolean", "boolean(size[. > 25])", "size > 25"),
    ("not", "not(size > 25)", "NOT size > 25"),
    ("true_false", "true() and not(size > 25) or false()", "size <= 25"),
    ("unary_minus", "-size", "-size::DOUBLE"),
    ("nan_compare", "number(name) = number(name) or number(name) != size and size > 25", "size > 25"),
    ("division_by_zero", "size div 0 > 1000000", "size > 0"),
):
    path(f"function_{_name}", "parts", _expr, PARTS + f"SELECT doc_id, {_sql or '0'} AS value FROM p")
ORACLES["function_string_of_number"] = PARTS + "SELECT doc_id, regexp_replace(CAST(cents::DECIMAL(18, 3) / 8 AS DECIMAL(18, 3))::VARCHAR, '\\.?0+$', '') AS value FROM p"


@register("function_custom", PARTS + "SELECT doc_id, upper(brand) || '!' AS value FROM p")
def custom_function(spark, sf_dir):
    shout = lambda s: F.concat(F.upper(s), F.lit("!"))
    return xpath(corpora.shredded(spark, sf_dir, "parts"), "shout(brand)", functions={"shout": shout}).select("doc_id", "value")


# scans
@register("parse_status_pages", "SELECT 'PARSE' AS status, count(*) AS n FROM pages")
def parse_status_pages(spark, sf_dir):
    return corpora.shredded(spark, sf_dir, "pages").documents.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("parse_nodes", ITEMS + "SELECT doc_id, 1 + 3 + 9 * count(*) AS n, sum(length(qty::VARCHAR) + length(cents::VARCHAR))::BIGINT AS chars FROM i GROUP BY doc_id")
def parse_nodes(spark, sf_dir):
    n = corpora.shredded(spark, sf_dir, "orders").nodes
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("kind") == "text", F.length("value"))).alias("chars"))


@register("parse_errors", "SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'OK' ELSE 'PARSE' END AS status FROM orders")
def parse_errors(spark, sf_dir):
    """Well-formed and broken documents side by side."""
    o = corpora.table(spark, sf_dir, "orders")
    bad = ["<a><b/></a>", "<a><b></a></b>", "<a><b>", "<a/><b/>", "<a x='1' x='2'/>"]
    return shred.shred(o.select(F.col("o_orderkey").alias("doc_id"), F.element_at(F.array(*map(F.lit, bad)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("xml"))).documents.select("doc_id", "status")


@register("parse_fragments", "SELECT p_partkey AS doc_id, 1 + p_size::BIGINT AS n FROM part")
def parse_fragments(spark, sf_dir):
    p = corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<a>1</a>text"), F.expr("repeat('<b/>', p_size)")).alias("xml"))
    return shred.shred_fragments(p).nodes.where("kind = 'element' AND level = 2").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@register("parse_drop_space", "SELECT p_partkey AS doc_id, p_size::BIGINT AS n FROM part")
def parse_drop_space(spark, sf_dir):
    p = corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<a>\n"), F.expr("repeat('  <b>x</b>\\n', p_size)"), F.lit("</a>")).alias("xml"))
    return shred.shred(p, drop_space=True).nodes.where("kind = 'text'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@register("entities", "SELECT doc_id, coalesce(text, '') AS value FROM documents")
def entities(spark, sf_dir):
    """Escaped text comes back as it was (without carriage returns, which XML normalises)."""
    return xpath(corpora.shredded(spark, sf_dir, "prose"), "string(/doc/p)").select("doc_id", "value")


@register("encodings", "SELECT p_partkey AS doc_id, p_name || ' é' AS value, e AS encoding FROM part, (VALUES ('utf-8'), ('utf-16'), ('iso-8859-1'), ('cp037')) t(e)")
def decode_bytes(spark, sf_dir):
    p = corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<a>"), "p_name", F.lit(" é</a>")).alias("xml"))
    out = None
    for e in ("utf-8", "utf-16", "iso-8859-1", "cp037"):
        text = encodings.decode(encodings.encode(p, e))
        one = text.select("doc_id", F.regexp_extract("xml", ">(.*)<", 1).alias("value"), F.lit(e).alias("encoding"))
        out = one if out is None else out.union(one)
    return out


# navigation
@register("navigate_siblings", ITEMS + "SELECT doc_id, n::VARCHAR AS value, lead(n) OVER (PARTITION BY doc_id ORDER BY n)::VARCHAR AS next FROM i")
def siblings(spark, sf_dir):
    n = corpora.shredded(spark, sf_dir, "orders").nodes
    a = navigate.attribute(n.where("kind = 'attribute' OR name = 'item'"), "n")
    s = navigate.sibling(n.where("name = 'item'"), 1, "same")
    v = a.select(F.col("doc_id").alias("v_doc"), F.col("pre").alias("v_pre"), F.col("value").alias("next"))
    j = s.join(a, ["doc_id", "pre"]).join(v, (F.col("doc_id") == F.col("v_doc")) & (F.col("sibling_pre") == F.col("v_pre")), "left")
    return j.select("doc_id", "value", "next")


@register("navigate_child_counts", ITEMS + "SELECT doc_id, count(*) AS n FROM i GROUP BY doc_id")
def child_counts(spark, sf_dir):
    return navigate.child_counts(corpora.shredded(spark, sf_dir, "orders").nodes).where("pre = 1").select("doc_id", "n")


@register("navigate_paths", ITEMS + "SELECT doc_id, CASE WHEN m > 1 THEN '/order/item[' || n || ']/qty' ELSE '/order/item/qty' END AS path FROM i")
def node_paths(spark, sf_dir):
    n = corpora.shredded(spark, sf_dir, "orders").nodes
    want = n.where("name = 'qty' AND kind = 'element'").select("doc_id", "pre")
    return navigate.node_paths(n).join(want, ["doc_id", "pre"]).select("doc_id", "path")


@register("navigate_post_order", ITEMS + "SELECT doc_id, 5 * n AS visit FROM i")
def post_order(spark, sf_dir):
    return navigate.traverse(corpora.shredded(spark, sf_dir, "orders").nodes, post=True).where("name = 'item'").select("doc_id", F.col("visit").cast("long").alias("visit"))


@register("navigate_typed", ITEMS + "SELECT doc_id, n AS value, -1::BIGINT AS missing FROM i")
def typed(spark, sf_dir):
    a = navigate.attribute(corpora.shredded(spark, sf_dir, "orders").nodes.where("kind = 'attribute' OR name = 'item'"), "n")
    return a.select("doc_id", navigate.typed(F.col("value"), "int", 0).alias("value"), navigate.typed(F.lit("x"), "int", -1).alias("missing"))


@register("navigate_find_child", ITEMS + "SELECT doc_id, min(n)::VARCHAR AS value FROM i WHERE flag = 'R' GROUP BY doc_id")
def find_child(spark, sf_dir):
    n = corpora.shredded(spark, sf_dir, "orders").nodes
    found = navigate.find_child(n, "item", "flag", "R").select("doc_id", F.col("child_pre").alias("c_pre"))
    return found.join(navigate.attribute(n, "n").withColumnRenamed("pre", "c_pre"), ["doc_id", "c_pre"]).select("doc_id", "value")


@register("navigate_child_value", ITEMS + "SELECT doc_id, qty::VARCHAR AS value FROM i WHERE n = 1")
def child_value(spark, sf_dir):
    return navigate.child_value(corpora.shredded(spark, sf_dir, "orders").nodes).where("pre = 1").select("doc_id", "value")


# output
_XML = ITEMS + """, x AS (SELECT doc_id, string_agg('<item n="' || n || '" line="' || line || '" flag="' || flag || '" status="' || status || '"><qty>' || qty || '</qty><cents>' || cents || '</cents></item>', '' ORDER BY n) AS items FROM i GROUP BY doc_id) """


@register("serialize", _XML + "SELECT doc_id, '<order id=\"' || o_orderkey || '\" status=\"' || o_orderstatus || '\">' || items || '</order>' AS xml FROM x JOIN orders ON doc_id = o_orderkey")
def serialize_orders(spark, sf_dir):
    return serialize.serialize(corpora.shredded(spark, sf_dir, "orders"))


@register("serialize_subtrees", ITEMS + "SELECT doc_id, '<qty>' || qty || '</qty>' AS xml FROM i WHERE qty > 45")
def serialize_subtrees(spark, sf_dir):
    x = corpora.shredded(spark, sf_dir, "orders")
    return serialize.serialize(x, xpath(x, "//qty[. > 45]").select("doc_id", "pre")).select("doc_id", "xml")


@register("canonical_digest", _XML.replace("n=\"' || n || '\" line=\"' || line || '\" flag=\"' || flag || '\" status=\"' || status || '\"", "flag=\"' || flag || '\" line=\"' || line || '\" n=\"' || n || '\" status=\"' || status || '\"") + "SELECT doc_id, sha256('<order id=\"' || o_orderkey || '\" status=\"' || o_orderstatus || '\">' || items || '</order>') AS digest FROM x JOIN orders ON doc_id = o_orderkey")
def canonical_digest(spark, sf_dir):
    return serialize.digest(corpora.shredded(spark, sf_dir, "orders"))


@register("exclusive_canonical", "SELECT 1::BIGINT AS doc_id, count(DISTINCT n_regionkey) AS declarations FROM nation")
def exclusive(spark, sf_dir):
    text = serialize.canonical(corpora.shredded(spark, sf_dir, "geography"), exclusive=True)
    return text.select("doc_id", F.regexp_count("xml", F.lit('xmlns:g="urn:geo"')).cast("long").alias("declarations"))


@register("json", PARTS + """SELECT doc_id, '{"name":"part","attributes":{"id":"' || doc_id || '"},"text":"","children":[{"name":"name","attributes":{},"text":"' || raw || '","children":[]},{"name":"brand","attributes":{},"text":"' || brand || '","children":[]},{"name":"size","attributes":{},"text":"' || size || '","children":[]},{"name":"cents","attributes":{},"text":"' || cents || '","children":[]}]}' AS json FROM p""")
def json_parts(spark, sf_dir):
    return serialize.to_json(corpora.shredded(spark, sf_dir, "parts"))


# events
@register("events", ITEMS + "SELECT doc_id, e AS event, k * count(*) + c AS n FROM i, (VALUES ('start_element', 3, 1), ('end_element', 3, 1), ('characters', 2, 0), ('start_document', 0, 1), ('end_document', 0, 1)) t(e, k, c) GROUP BY doc_id, e, k, c")
def event_counts(spark, sf_dir):
    return events.events(corpora.shredded(spark, sf_dir, "orders")).groupBy("doc_id", "event").agg(F.count(F.lit(1)).alias("n"))


@register("events_stream", ITEMS + "SELECT doc_id, e AS event, k * count(*) + c AS n FROM i, (VALUES ('start_element', 3, 1), ('end_element', 3, 1), ('start_document', 0, 1), ('end_document', 0, 1)) t(e, k, c) GROUP BY doc_id, e, k, c UNION ALL SELECT doc_id, 'characters', sum(length(qty::VARCHAR) + length(cents::VARCHAR))::BIGINT FROM i GROUP BY doc_id")
def event_stream(spark, sf_dir):
    """The same documents in chunks of 37 characters through Structured Streaming; text, which comes in pieces, counts by its characters."""
    out = events.stream_all(spark, events.chunked(corpora.orders(spark, sf_dir), 37))
    return out.groupBy(F.col("stream_id").alias("doc_id"), "event").agg(F.sum(F.when(F.col("event") == "characters", F.length("text")).otherwise(1)).alias("n"))


# validation
_DTD = """<!ELEMENT order (item+)><!ELEMENT item (qty, cents)><!ELEMENT qty (#PCDATA)><!ELEMENT cents (#PCDATA)>
<!ATTLIST order id CDATA #REQUIRED status (O|F) #IMPLIED><!ATTLIST item n NMTOKEN #REQUIRED flag (A|N|R) 'N' line ID #IMPLIED seal CDATA #IMPLIED>"""


@register("dtd_validate", ITEMS + """SELECT doc_id, 'enumeration' AS rule, 1::BIGINT AS n FROM (SELECT DISTINCT doc_id FROM i) JOIN orders ON doc_id = o_orderkey WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT doc_id, 'id', count(*) - count(DISTINCT line) FROM i GROUP BY doc_id HAVING count(*) > count(DISTINCT line)""")
def dtd_validate(spark, sf_dir):
    found = dtd.validate(corpora.shredded(spark, sf_dir, "orders"), dtd.parse_dtd(_DTD))
    return found.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@register("dtd_content", "SELECT c_nationkey::BIGINT AS doc_id, count(*) AS n FROM customer GROUP BY 1")
def dtd_content(spark, sf_dir):
    """Every <c> lacks the order of content that is asked for."""
    model = dtd.parse_dtd("<!ELEMENT customers (c)*><!ELEMENT c (bal, name)><!ELEMENT bal (#PCDATA)><!ELEMENT name (#PCDATA)>")
    return dtd.validate(corpora.shredded(spark, sf_dir, "customers"), model).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@register("dtd_idref", "SELECT o_custkey % 25 AS doc_id, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 25 = o_custkey % 25 AND c_custkey % 2 = 0) GROUP BY 1")
def dtd_idref(spark, sf_dir):
    """Customers with even keys as IDs, orders as references to customers."""
    c = corpora.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select((F.col("c_custkey") % 25).alias("doc_id"), F.concat(F.lit("<c id='k"), "c_custkey", F.lit("'/>")).alias("m"))
    o = corpora.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("doc_id"), F.concat(F.lit("<o c='k"), "o_custkey", F.lit("'/>")).alias("m"))
    docs = c.union(o).groupBy("doc_id").agg(F.concat(F.lit("<d>"), F.array_join(F.array_sort(F.collect_list("m")), ""), F.lit("</d>")).alias("xml"))
    found = dtd.validate(shred.shred(docs), dtd.parse_dtd("<!ATTLIST c id ID #REQUIRED><!ATTLIST o c IDREF #REQUIRED>"))
    return found.where("rule = 'idref'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# inclusion and edits
@register("xinclude", "SELECT n_nationkey::BIGINT AS doc_id, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def include(spark, sf_dir):
    n = corpora.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit('<n xmlns:xi="http://www.w3.org/2001/XInclude"><xi:include href="r'), "n_regionkey", F.lit('.xml"/></n>')).alias("xml"))
    r = corpora.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey", F.lit(".xml")).alias("uri"), F.concat(F.lit("<r>"), "r_name", F.lit("</r>")).alias("xml"))
    return xpath(xinclude.resolve(shred.shred(n), r), "string(/n/r)").select("doc_id", "value")


@register("edit_remove", ITEMS + "SELECT doc_id, count(*)::DOUBLE AS value FROM i WHERE flag <> 'R' GROUP BY doc_id UNION ALL SELECT doc_id, 0.0 FROM i GROUP BY doc_id HAVING count(*) FILTER (flag <> 'R') = 0")
def edit_remove(spark, sf_dir):
    x = corpora.shredded(spark, sf_dir, "orders")
    return xpath(edit.remove(x, xpath(x, "//item[@flag='R']")), "count(//item)").select("doc_id", "value")


@register("edit_set_attribute", PARTS + "SELECT doc_id, 'yes' AS value FROM p WHERE size > 25")
def edit_set_attribute(spark, sf_dir):
    x = corpora.shredded(spark, sf_dir, "parts")
    return xpath(edit.set_attribute(x, xpath(x, "/part[size > 25]"), "large", "yes"), "/part/@large").select("doc_id", "value")


@register("edit_insert", PARTS + "SELECT doc_id, brand || 'new' AS value FROM p")
def edit_insert(spark, sf_dir):
    x = corpora.shredded(spark, sf_dir, "parts")
    return xpath(edit.insert(x, xpath(x, "/part/brand"), "after", "<added>new</added>"), "concat(brand, brand/following-sibling::*[1])").select("doc_id", "value")


@register("edit_copy", PARTS + "SELECT doc_id, 2.0::DOUBLE AS value FROM p")
def edit_copy(spark, sf_dir):
    x = corpora.shredded(spark, sf_dir, "parts")
    return xpath(edit.copy(x, xpath(x, "/part/brand"), xpath(x, "/part")), "count(//brand)").select("doc_id", "value")
