"""Registered queries over documents with every kind of node, over files, and over what edits, inclusion and validation leave, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from xylem.catalog import CUSTOMERS, ITEMS, PARTS, path, register
from xylem.functions import tables
from xylem.operators import dtd, edit, navigate, serialize, xinclude
from xylem.plans.xpath import xpath
from xylem.session import Workspace
from xylem.sources import corpora, encodings, files, shred
from xylem.streaming import events

#: The notes corpus in SQL.
NOTES = "WITH p AS (SELECT p_partkey AS doc_id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size FROM part) "
_TEXT = "'line one' || chr(10) || 'line two'"


def note_path(name: str, expression: str, select: str, **options) -> None:
    path(name, "notes", expression, NOTES + select, **options)


# node tests and names
note_path("test_text", "/k:note/text()", f"SELECT doc_id, {_TEXT} AS value FROM p UNION ALL SELECT doc_id, '<' || type || '>' FROM p")
note_path("test_comment", "//comment()", "SELECT doc_id, name AS value FROM p")
note_path("test_instruction", "//processing-instruction('size')", "SELECT doc_id, size::VARCHAR AS value FROM p")
note_path("test_any_instruction", "count(//processing-instruction()) + size", "SELECT doc_id, 2.0::DOUBLE + 'NaN'::DOUBLE AS value FROM p")
note_path("test_node", "concat(count(/k:note/node()), '-', div/mod)", "SELECT doc_id, '7-' || size AS value FROM p")
note_path("test_prefix_any", "//k:*/@id", "SELECT doc_id, 'n' || doc_id AS value FROM p")
note_path("test_keyword_names", "/k:note/div[@and = '1' and mod > 25]/mod", "SELECT doc_id, size::VARCHAR AS value FROM p WHERE size > 25")
note_path("function_local_name", "concat(local-name(*[1]), local-name(@*[2]), local-name(), brand)", "SELECT doc_id, 'brandsizenote' AS value FROM p")
note_path("function_local_name_filter", "//*[local-name() = 'brand' or . = 25]", "SELECT doc_id, brand AS value FROM p UNION ALL SELECT doc_id, size::VARCHAR FROM p, (VALUES ('div'), ('mod')) t(e) WHERE size = 25")
note_path("namespace_of_element", "//namespace::k[. = 'urn:k'][../@id]", "SELECT doc_id, 'urn:k' AS value FROM p")
note_path("namespaces_by_uri_many", "//x:brand[. = 'Brand#2'] | //y:mod[. < 5]", "SELECT doc_id, brand AS value FROM p WHERE brand = 'Brand#2' UNION ALL SELECT doc_id, size::VARCHAR FROM p WHERE size < 5", namespaces={"x": "urn:k", "y": "urn:n"})
note_path("entities_internal", "string(//or)", "SELECT doc_id, brand || '&' || brand AS value FROM p")
path("compare_le", "parts", "size <= 25", PARTS + "SELECT doc_id, size <= 25 AS value FROM p")
path("compare_ge", "parts", "cents >= 100000 and 25 >= size", PARTS + "SELECT doc_id, cents >= 100000 AND size <= 25 AS value FROM p")
path("function_translate_computed", "parts", "translate(concat(brand, size), substring(brand, 1, 3), string(size))", PARTS + "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(brand || size, 'a', CASE WHEN size > 99 THEN substr(size::VARCHAR, 3, 1) ELSE '' END, 'g'), 'r', CASE WHEN size > 9 THEN substr(size::VARCHAR, 2, 1) ELSE '' END, 'g'), 'B', substr(size::VARCHAR, 1, 1), 'g') AS value FROM p")
path("function_lang_many", "prose", "boolean(/doc/p[lang('en')])", "SELECT doc_id, coalesce(lang, '') = 'en' AS value FROM documents")


# scans
@register("parse_metadata", NOTES + "SELECT doc_id, '1.0' AS version, 'UTF-8' AS encoding, CASE WHEN size % 2 = 0 THEN 'yes' ELSE 'no' END AS standalone, true AS had_decl, 'note' AS root_name, 'note' AS dt_name, '-//N//' || size AS public_id, 'note.dtd' AS system_id FROM p")
def metadata(spark, sf_dir):
    d = corpora.shredded(spark, sf_dir, "notes").documents
    return d.select("doc_id", "version", "encoding", "standalone", "had_decl", "root_name", F.col("doctype.name").alias("dt_name"), F.col("doctype.public_id").alias("public_id"), F.col("doctype.system_id").alias("system_id"))


@register("parse_lines", NOTES + "SELECT doc_id, name, 4 + size % 4 + CASE WHEN name = 'or' THEN 1 ELSE 0 END AS line FROM (SELECT doc_id, size FROM p), (VALUES ('mod'), ('or')) t(name)")
def lines(spark, sf_dir):
    return corpora.shredded(spark, sf_dir, "notes").nodes.where("name IN ('mod', 'or')").select("doc_id", "name", "line")


@register("parse_outside_root", NOTES + "SELECT doc_id, kind, name, value FROM (SELECT doc_id, 'pi' AS kind, 'out' AS name, name || ' x' AS value FROM p)")
def outside_root(spark, sf_dir):
    """Instructions outside of the root are nodes, comments there are not."""
    return corpora.shredded(spark, sf_dir, "notes").nodes.where("parent_pre = 0 AND kind <> 'element'").select("doc_id", "kind", "name", "value")


#: Documents that break in different ways, and the reason for each.
_BROKEN = (
    ("<a><b></a></b>", "a close tag that does not match"), ("<a><b>", "an element that is not closed"), ("<a/><b/>", "more than one root element"), ("<a/>t", "text outside the root"), ("<a x='1' x='2'/>", "an attribute that repeats"),
    ("<a b=c/>", "markup that is not well-formed"), ("</a>", "a close tag without an open one"), ("<a><?xml version='1.0'?></a>", "a declaration that is not at the start"), ("<a><!DOCTYPE b></a>", "a document type inside the root"),
    ("", "no root element"), ("<a/><![CDATA[x]]>", "CDATA outside the root"), ("<a>&nope;</a>", None), ("﻿<!-- c --><a/><?p q?>", None),
)
_REASONS = "(VALUES " + ", ".join(f"({i}, {'NULL' if r is None else repr(r)})" for i, (_, r) in enumerate(_BROKEN)) + ") t(k, error)"


@register("parse_reasons", f"SELECT o_orderkey AS doc_id, error, CASE WHEN error IS NULL THEN 'OK' ELSE 'PARSE' END AS status FROM orders JOIN {_REASONS} ON o_orderkey % {len(_BROKEN)} = k")
def reasons(spark, sf_dir):
    o = corpora.table(spark, sf_dir, "orders")
    one = F.element_at(F.array(*[F.lit(d) for d, _ in _BROKEN]), (F.col("o_orderkey") % len(_BROKEN) + 1).cast("int"))
    return shred.shred(o.select(F.col("o_orderkey").alias("doc_id"), one.alias("xml"))).documents.select("doc_id", "error", "status")


@register("parse_strict", NOTES + "SELECT doc_id, CASE WHEN size > 25 THEN 'an unknown entity' END AS error, CASE WHEN size > 25 THEN 1 + size % 3 END AS error_line FROM p")
def strict(spark, sf_dir):
    p = corpora.table(spark, sf_dir, "part")
    xml = F.concat(F.lit("<a>&#65;&lt;"), F.expr("repeat('\\r\\n', p_size % 3)"), F.lit("<b>"), F.when(F.col("p_size") > 25, "&nope;").otherwise("&amp;"), F.lit("</b></a>"))
    return shred.shred(p.select(F.col("p_partkey").alias("doc_id"), xml.alias("xml")), strict=True).documents.select("doc_id", "error", "error_line")


@register("parse_depth", NOTES + "SELECT doc_id, CASE WHEN 8 * size > 256 THEN 'too deep' END AS error FROM p")
def depth(spark, sf_dir):
    p = corpora.table(spark, sf_dir, "part")
    return shred.shred(p.select(F.col("p_partkey").alias("doc_id"), F.expr("concat(repeat('<a>', 8 * p_size), repeat('</a>', 8 * p_size))").alias("xml")), save=False).documents.select("doc_id", "error")


@register("load_files", "SELECT n_nationkey::VARCHAR AS key, n_name || ' é' AS name FROM nation")
def load_files(spark, sf_dir):
    """Documents written as files, one each, in another encoding, and read again."""
    n = corpora.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("<n>"), "n_name", F.lit(" é</n>")).alias("xml"))
    where = Workspace(spark, "files").path("nations")
    files.save_xml(n, where, "ISO-8859-1")
    return xpath(shred.shred(files.load_xml(spark, where, "ISO-8859-1").withColumn("doc_id", F.col("doc_id").cast("long"))), "string(/n)").select(F.col("doc_id").cast("string").alias("key"), F.col("value").alias("name"))


@register("table_function", "SELECT n_nationkey AS k, 'n' AS root, n_name AS value FROM nation")
def table_function(spark, sf_dir):
    n = corpora.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("<n k='"), "n_nationkey", F.lit("'><x/>"), "n_name", F.lit("</n>")).alias("xml"))
    found = n.lateralJoin(tables.XmlNodes(F.col("xml").outer()))
    by = found.groupBy("n_nationkey").agg(F.max(F.when((F.col("kind") == "element") & (F.col("level") == 1), F.col("name"))).alias("root"), F.max(F.when(F.col("kind") == "text", F.col("value"))).alias("value"))
    return by.select(F.col("n_nationkey").alias("k"), "root", "value")


# navigation
@register("navigate_typed_text", NOTES + "SELECT doc_id, size::BIGINT AS i, size / 2.0::DOUBLE AS d, size > 25 AS b FROM p")
def typed_text(spark, sf_dir):
    p = corpora.table(spark, sf_dir, "part")
    t = lambda c, kind, default=None: navigate.typed_text(c, kind, default)
    half, word = (F.col("p_size") / 2).cast("string"), F.when(F.col("p_size") > 25, "x").otherwise("false")
    return p.select(F.col("p_partkey").alias("doc_id"), t(F.concat(F.lit("0x"), F.hex("p_size")), "int").alias("i"), t(half, "double").alias("d"), t(word, "bool").alias("b"))


@register("navigate_children", ITEMS + "SELECT doc_id, max(CASE WHEN n = 1 THEN qty END)::VARCHAR AS first, max(CASE WHEN n = m THEN cents END)::VARCHAR AS last, count(*) AS n FROM i GROUP BY doc_id")
def children(spark, sf_dir):
    """The first child of the first item, the last child of the last, and attributes by counting."""
    n = corpora.shredded(spark, sf_dir, "orders").nodes
    text = n.where("kind = 'element'").select(F.col("doc_id").alias("t_doc"), F.col("pre").alias("t_pre"), "leaf")

    def leaf(edges, name):
        e = edges.withColumnsRenamed({"doc_id": "e_doc", "child_pre": "e_pre"}).select("e_doc", "e_pre")
        inner = navigate.edge_child(n, last=name == "last").join(e, (F.col("doc_id") == F.col("e_doc")) & (F.col("pre") == F.col("e_pre")), "left_semi")
        return inner.join(text, (F.col("doc_id") == F.col("t_doc")) & (F.col("child_pre") == F.col("t_pre"))).select(F.col("doc_id").alias(f"{name}_doc"), F.col("leaf").alias(name))

    root = navigate.edge_child(n).where("pre = 1"), navigate.edge_child(n, last=True, name="item").where("pre = 1")
    each = navigate.attribute_counts(n).where("pre > 1 AND n > 0").groupBy("doc_id").agg((F.sum("n") / 4).cast("long").alias("n"))
    return each.join(leaf(root[0], "first"), F.col("doc_id") == F.col("first_doc")).join(leaf(root[1], "last"), F.col("doc_id") == F.col("last_doc")).select("doc_id", "first", "last", "n")


@register("navigate_nth_child", ITEMS + "SELECT doc_id, n::VARCHAR AS value FROM i WHERE n = 3")
def nth_child(spark, sf_dir):
    n = corpora.shredded(spark, sf_dir, "orders").nodes
    return navigate.nth_child(n.where("level = 2 AND kind = 'element'"), 2).select("doc_id", F.col("attrs")["n"].alias("value"))


@register("navigate_namespace", NOTES + "SELECT doc_id, prefix, uri FROM p, (VALUES ('', 'urn:n'), ('k', 'urn:k'), ('z', NULL)) t(prefix, uri)")
def lookup(spark, sf_dir):
    x = corpora.shredded(spark, sf_dir, "notes")
    mod = x.nodes.where("name = 'mod'")
    out = None
    for prefix in ("", "k", "z"):
        one = navigate.lookup_namespace(x.ns_decls, mod, prefix).select("doc_id", F.lit(prefix).alias("prefix"), "uri")
        out = one if out is None else out.union(one)
    return out


@register("navigate_hash", ITEMS + "SELECT doc_id, 4 + 9 * count(*) AS nodes, 4 + 9 * count(*) AS hashes FROM i GROUP BY doc_id")
def hashes(spark, sf_dir):
    return navigate.node_hash(corpora.shredded(spark, sf_dir, "orders").nodes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("hash").alias("hashes"))


# output
_BODY = """'<k:note id="n' || doc_id || '" k:size="' || size || '" xmlns="urn:n" xmlns:k="urn:k"><?size ' || size || '?><!--' || name || '--><k:brand>' || brand || '</k:brand><div and="1"><mod>' || size || '</mod></div>' || 'line one' || chr(10) || 'line two<![CDATA[<' || type || '>]]><or>' || brand || '&amp;' || brand || '</or></k:note>'"""


@register("serialize_kinds", NOTES + f"""SELECT doc_id, '<?xml version="1.0" encoding="UTF-8" standalone="' || CASE WHEN size % 2 = 0 THEN 'yes' ELSE 'no' END || '"?>' || chr(10) || '<!DOCTYPE note PUBLIC "-//N//' || size || '" "note.dtd" [<!ENTITY brand "' || brand || '"><!ENTITY twice "&brand;&amp;&brand;">]>' || chr(10) || '<?out ' || name || ' x?>' || {_BODY} AS xml FROM p""")
def serialize_kinds(spark, sf_dir):
    return serialize.serialize(corpora.shredded(spark, sf_dir, "notes"))


@register("serialize_indent", PARTS + """SELECT doc_id, '<part id="' || doc_id || '">' || chr(10) || '  <name>' || raw || '</name>' || chr(10) || '  <brand>' || brand || '</brand>' || chr(10) || '  <size>' || size || '</size>' || chr(10) || '  <cents>' || cents || '</cents>' || chr(10) || '</part>' AS xml FROM p""")
def serialize_indent(spark, sf_dir):
    return serialize.serialize(corpora.shredded(spark, sf_dir, "parts"), indent=2)


_CANONICAL = """'<?out ' || name || ' x?>' || chr(10) || '<k:note{0} id="n' || doc_id || '" k:size="' || size || '"><?size ' || size || '?>' || {2} || '<k:brand>' || brand || '</k:brand><div{1} and="1"><mod>' || size || '</mod></div>' || 'line one' || chr(10) || 'line two&lt;' || type || '&gt;<or{1}>' || brand || '&amp;' || brand || '</or></k:note>'"""


@register("canonical_comments", NOTES + "SELECT doc_id, " + _CANONICAL.format(' xmlns="urn:n" xmlns:k="urn:k"', "", "'<!--' || name || '-->'") + " AS xml FROM p")
def canonical_comments(spark, sf_dir):
    return serialize.canonical(corpora.shredded(spark, sf_dir, "notes"), comments=True)


@register("canonical_exclusive", NOTES + "SELECT doc_id, " + _CANONICAL.format(' xmlns:k="urn:k"', ' xmlns="urn:n"', "''") + " AS xml FROM p")
def canonical_exclusive(spark, sf_dir):
    return serialize.canonical(corpora.shredded(spark, sf_dir, "notes"), exclusive=True)


@register("canonical_inclusive_prefixes", NOTES + "SELECT doc_id, " + _CANONICAL.format(' xmlns="urn:n" xmlns:k="urn:k"', "", "''") + " AS xml FROM p")
def canonical_inclusive(spark, sf_dir):
    return serialize.canonical(corpora.shredded(spark, sf_dir, "notes"), exclusive=True, inclusive_prefixes=("#default",))


# events
_EVENTS = f"""SELECT doc_id, event, n, text FROM p, LATERAL (VALUES ('start_document', 1, NULL), ('start_prefix_mapping', 2, 'urn:nurn:k'), ('start_element', 5, NULL), ('end_element', 5, NULL), ('end_prefix_mapping', 2, NULL), ('processing_instruction', 2, name || ' x' || size),
    ('comment', 1, name), ('cdata', 1, '<' || type || '>'), ('characters', NULL, brand || size || {_TEXT} || brand || '&' || brand), ('end_document', 1, NULL)) t(event, n, text)"""


def _by_event(found, key):
    """Counts and joined text of each kind of event; text comes in any number of pieces."""
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", "text"))))
    g = found.groupBy(F.col(key).alias("doc_id"), "event").agg(F.count(F.lit(1)).cast("int").alias("n"), F.nullif(F.array_join(F.transform(parts, lambda x: x["text"]), ""), F.lit("")).alias("text"))
    return g.select("doc_id", "event", F.when(F.col("event") != "characters", F.col("n")).alias("n"), "text")


@register("events_kinds", NOTES + _EVENTS)
def events_kinds(spark, sf_dir):
    return _by_event(events.events(corpora.shredded(spark, sf_dir, "notes")), "doc_id")


@register("events_kinds_stream", NOTES + _EVENTS)
def events_kinds_stream(spark, sf_dir):
    """In chunks of 23 characters, dealt over files without order."""
    return _by_event(events.stream_all(spark, events.chunked(corpora.notes(spark, sf_dir), 23).repartition(7)), "stream_id")


@register("events_errors_stream", NOTES + "SELECT doc_id, 'a close tag that does not match' AS error, (1 + size % 3)::INTEGER AS line, 4 AS col FROM p WHERE size > 25")
def events_errors_stream(spark, sf_dir):
    p = corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<a>"), F.expr("repeat('\\r\\n', p_size % 3)"), F.when(F.col("p_size") % 3 > 0, "   ").otherwise(""), F.when(F.col("p_size") > 25, "</b>").otherwise("</a>")).alias("xml"))
    out = events.stream_all(spark, events.chunked(p, 2)).where("event = 'error'")
    return out.select(F.col("stream_id").alias("doc_id"), F.col("text").alias("error"), "line", "col")


# validation
_RULES = """<!ENTITY % in 'INCLUDE'><!ENTITY % out 'IGNORE'><!ENTITY % leaf '(#PCDATA)'><!NOTATION gif SYSTEM 'gif'><!ENTITY pic SYSTEM 'p.gif' NDATA gif><!ENTITY txt 'plain'>
<!ELEMENT r (e*)><![%in;[<!ELEMENT e EMPTY>]]><![%out;[<!ELEMENT e ANY>]]><!ELEMENT e ANY><!ELEMENT leaf %leaf;>
<!ATTLIST e need CDATA #REQUIRED fix CDATA #FIXED 'f' pic ENTITY #IMPLIED pics ENTITIES #IMPLIED how NOTATION (gif|png) #IMPLIED tok NMTOKEN #IMPLIED toks NMTOKENS #IMPLIED><!ATTLIST e need CDATA #IMPLIED>"""
#: What is wrong with a document's one <e>, and the rule that says so; undeclared elements and attributes are not.
_WRONG = (
    ("<e need='1'/>", None), ("<e/>", "required"), ("<e need='1' fix='g'/>", "fixed"), ("<e need='1' fix='f'/>", None), ("<e need='1'>text</e>", "content"), ("<e need='1'><x/></e>", "content"), ("<e need='1' pic='txt'/>", "entity"),
    ("<e need='1' pic='pic'/>", None), ("<e need='1' pics='pic nope'/>", "entity"), ("<e need='1' how='png'/>", "notation"), ("<e need='1' how='gif'/>", None), ("<e need='1' tok='a b'/>", "nmtoken"), ("<e need='1' toks=' a  b '/>", None),
    ("<e need='1' other='?'/>", None), ("<u/>", "content"),
)


@register("dtd_rules", f"SELECT o_orderkey AS doc_id, rule FROM orders JOIN (VALUES {', '.join(f'({i}, {r!r})' for i, (_, r) in enumerate(_WRONG) if r)}) t(k, rule) ON o_orderkey % {len(_WRONG)} = k")
def dtd_rules(spark, sf_dir):
    """Parameter entities, sections, first declarations, empty content, required and fixed attributes, entities and notations."""
    o = corpora.table(spark, sf_dir, "orders")
    one = F.element_at(F.array(*[F.lit(d) for d, _ in _WRONG]), (F.col("o_orderkey") % len(_WRONG) + 1).cast("int"))
    x = shred.shred(o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("<r>"), one, F.lit("</r>")).alias("xml")))
    return dtd.validate(x, dtd.parse_dtd(_RULES)).select("doc_id", "rule")


@register("dtd_valid", f"SELECT o_orderkey AS doc_id, o_orderkey % {len(_WRONG)} IN ({', '.join(str(i) for i, (_, r) in enumerate(_WRONG) if not r)}) AS valid FROM orders")
def dtd_valid(spark, sf_dir):
    o = corpora.table(spark, sf_dir, "orders")
    one = F.element_at(F.array(*[F.lit(d) for d, _ in _WRONG]), (F.col("o_orderkey") % len(_WRONG) + 1).cast("int"))
    x = shred.shred(o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("<r>"), one, F.lit("</r>")).alias("xml")))
    return dtd.is_valid(x, dtd.parse_dtd(_RULES)).select("doc_id", "valid")


# inclusion
def _including(spark, sf_dir, include):
    n = corpora.table(spark, sf_dir, "nation")
    return shred.shred(n.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit('<n xmlns:xi="http://www.w3.org/2001/XInclude">'), include, F.lit("</n>")).alias("xml")))


def _regions(spark, sf_dir):
    r = corpora.table(spark, sf_dir, "region")
    return r.select(F.concat(F.lit("r"), "r_regionkey", F.lit(".xml")).alias("uri"), F.concat(F.lit("<r><k>"), "r_regionkey", F.lit("</k><v id='v'>"), "r_name", F.lit("</v></r>")).alias("xml"))


def _href():
    return F.concat(F.lit('<xi:include href="r'), F.col("n_regionkey").cast("string"), F.lit('.xml"'))


@register("xinclude_element", "SELECT n_nationkey::BIGINT AS doc_id, r_name || r_name || r_regionkey AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def include_element(spark, sf_dir):
    """By child sequence, by id and by xpointer()."""
    parts = F.concat(*[F.concat(_href(), F.lit(f' xpointer="{p}"/>')) for p in ("element(/1/2)", "v", "xpointer(//k)")])
    return xpath(xinclude.resolve(_including(spark, sf_dir, parts), _regions(spark, sf_dir)), "concat(/n/v[1], /n/v[2], /n/k)").select("doc_id", "value")


@register("xinclude_fallback", "SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_regionkey < 2 THEN r_regionkey || r_name ELSE 'none' END AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def include_fallback(spark, sf_dir):
    some = _regions(spark, sf_dir).where("uri IN ('r0.xml', 'r1.xml')")
    return xpath(xinclude.resolve(_including(spark, sf_dir, F.concat(_href(), F.lit("><xi:fallback>no<f>ne</f></xi:fallback></xi:include>"))), some), "string(/n)").select("doc_id", "value")


@register("xinclude_text", "SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_regionkey < 4 THEN r_name || ' é <' ELSE 'unread' END AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def include_text(spark, sf_dir):
    """Text in an encoding that the include names; what it cannot read is a missing resource."""
    r = corpora.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey", F.lit(".xml")).alias("uri"), F.concat("r_name", F.lit(" é <")).alias("xml"))
    latin = F.when(F.col("n_regionkey") < 4, "iso-8859-1").otherwise("us-ascii")
    include = F.concat(_href(), F.lit(' parse="text" encoding="'), latin, F.lit('"><xi:fallback>unread</xi:fallback></xi:include>'))
    return xpath(xinclude.resolve(_including(spark, sf_dir, include), encodings.encode(r, "iso-8859-1")), "string(/n)").select("doc_id", "value")


# edits
def _edited(name, corpus, oracle, targets, change, expression):
    def run(spark, sf_dir):
        x = corpora.shredded(spark, sf_dir, corpus)
        return xpath(change(x, xpath(x, targets)), expression).select("doc_id", "value")

    register(name, oracle)(run)


_edited("edit_rename", "parts", PARTS + "SELECT doc_id, brand || CASE WHEN size > 25 THEN '1' ELSE '0' END AS value FROM p", "/part[size > 25]/brand", lambda x, t: edit.rename(x, t, "label"), "concat(label, brand, count(label))")
_edited("edit_set_value", "notes", NOTES + "SELECT doc_id, 'changed' AS value FROM p", "//comment()", lambda x, t: edit.set_value(x, t, "changed"), "//comment()")
_edited("edit_set_text", "parts", PARTS + "SELECT doc_id, 'a < b' || size AS value FROM p", "/part/brand", lambda x, t: edit.set_text(x, t, "a < b"), "concat(brand, size)")
_edited("edit_remove_attribute", "orders", ITEMS + "SELECT doc_id, 3.0::DOUBLE * count(*) AS value FROM i GROUP BY doc_id", "//item", lambda x, t: edit.remove_attribute(x, t, "line"), "count(//item/@*)")
_edited("edit_remove_children", "orders", ITEMS + "SELECT doc_id, 2.0::DOUBLE * count(*) FILTER (flag <> 'R') AS value FROM i GROUP BY doc_id", "//item[@flag = 'R']", lambda x, t: edit.remove_children(x, t), "count(//item/*)")
_edited("edit_prepend", "parts", PARTS + "SELECT doc_id, 'new' || raw AS value FROM p", "/part/name", lambda x, t: edit.insert(x, t, "prepend", "<first>new</first>"), "string(/part/name)")
_edited("edit_define_namespace", "parts", PARTS + "SELECT doc_id, 'urn:z' AS value FROM p WHERE size > 25", "/part[size > 25]", lambda x, t: edit.define_namespace(x, t, "z", "urn:z"), "/part/namespace::z")
_edited("edit_remove_namespace", "customers_spaced", CUSTOMERS + "SELECT doc_id, count(*) FILTER (seg <> 'BUILDING')::DOUBLE AS value FROM c GROUP BY doc_id", "//c[@seg = 'BUILDING']", lambda x, t: edit.remove_namespace(x, t, "s"), "count(//c/namespace::s)")
