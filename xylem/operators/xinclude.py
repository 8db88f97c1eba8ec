"""XInclude: includes replaced by resources (uri, xml), round by round, with joins on the address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.functions.values import escape_text
from xylem.operators import serialize as S
from xylem.operators.edit import _spans, _with, _without
from xylem.plans.xpath import xpath
from xylem.session import Workspace
from xylem.sources.encodings import decode
from xylem.sources.shred import Shredded, held, shred, with_namespaces

URI = "http://www.w3.org/2001/XInclude"
#: Rounds of inclusion, the depth of includes within included text; what still includes then goes in circles.
MOST_ROUNDS = 32
#: Different xpointer() expressions in a collection's includes: each is a plan of its own.
MOST_POINTERS = 1000


def includes(xml: Shredded) -> DataFrame:
    """(doc_id, pre, href, parse, xpointer, encoding) of every include element."""
    e = with_namespaces(xml.nodes.where("kind = 'element' AND name = 'include'"), xml.ns_decls).where(F.col("ns_uri") == URI).select("doc_id", "pre")
    a = xml.nodes.where("kind = 'attribute' AND prefix IS NULL").select(F.col("doc_id").alias("a_doc"), F.col("parent_pre").alias("own"), "name", "value")
    get = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    j = e.join(a, (F.col("doc_id") == F.col("a_doc")) & (F.col("pre") == F.col("own")), "left").groupBy("doc_id", "pre")
    return j.agg(get("href").alias("href"), F.coalesce(get("parse"), F.lit("xml")).alias("parse"), get("xpointer").alias("xpointer"), get("encoding").alias("encoding"))


def _ordinals(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, steps): the child sequence of every element, such as /1/3."""
    e = nodes.where("kind = 'element'")
    up = e.select(F.col("doc_id").alias("u_doc"), F.col("pre").alias("u_pre"), F.col("last").alias("u_last"), F.col("elem_ord").alias("u_ord"))
    j = e.join(up, (F.col("doc_id") == F.col("u_doc")) & (F.col("pre") >= F.col("u_pre")) & (F.col("pre") <= F.col("u_last")))
    parts = F.array_sort(F.collect_list(F.struct("u_pre", "u_ord")))
    return j.groupBy("doc_id", "pre").agg(F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda x: x["u_ord"].cast("string")), "/")).alias("steps"))


def _selected(resources: DataFrame, xml: Shredded, wanted: DataFrame, work: Workspace) -> DataFrame:
    """(uri, pointer, text): each wanted (uri, pointer) of a well-formed resource as XML text; a pointer that finds nothing gives the root."""
    named = resources.select(F.xxhash64("uri").alias("r_doc"), "uri")
    good = xml.documents.where("status = 'OK'").select(F.col("doc_id").alias("g_doc"))
    asked = wanted.where("pointer IS NOT NULL").select(F.col("uri").alias("w_uri"), "pointer").distinct()
    with_doc = asked.join(named, F.col("w_uri") == F.col("uri")).select("r_doc", "pointer")
    ids = xml.nodes.where("kind = 'attribute' AND (name = 'id')").select(F.col("doc_id").alias("i_doc"), F.col("parent_pre").alias("pre"), "value")
    hits = with_doc.join(ids, (F.col("r_doc") == F.col("i_doc")) & (F.col("pointer") == F.col("value"))).select("r_doc", "pointer", "pre")
    steps = _ordinals(xml.nodes)
    element = with_doc.withColumn("path", F.regexp_extract("pointer", r"element\(([^)]*)\)", 1)).where("path <> ''")
    hits = hits.union(element.join(steps, (F.col("r_doc") == F.col("doc_id")) & (F.col("path") == F.col("steps"))).select("r_doc", "pointer", "pre"))
    pointers = asked.where(r"pointer RLIKE 'xpointer\\(.*\\)'").select("pointer").distinct().limit(MOST_POINTERS + 1).collect()
    if len(pointers) > MOST_POINTERS:
        raise ValueError(f"includes with more than {MOST_POINTERS} different xpointer() expressions")
    for (pointer,) in pointers:
        expression = pointer[pointer.index("xpointer(") + 9 : pointer.rindex(")")]
        some = xpath(xml, expression).where("kind = 'element'").select(F.col("doc_id").alias("r_doc"), F.lit(pointer).alias("pointer"), "pre")
        hits = hits.union(some)
    roots = xml.nodes.where("parent_pre = 0 AND kind = 'element'").select(F.col("doc_id").alias("o_doc"), F.col("pre").alias("o_pre"))
    texts = S.serialize(xml, hits.select(F.col("r_doc").alias("doc_id"), "pre").union(roots)).withColumnsRenamed({"doc_id": "t_doc", "pre": "t_pre", "xml": "t"})
    parts = hits.distinct().join(texts, (F.col("r_doc") == F.col("t_doc")) & (F.col("pre") == F.col("t_pre")))
    chosen = parts.groupBy("r_doc", "pointer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "t"))), lambda x: x["t"]), "").alias("part")).withColumnsRenamed({"r_doc": "p_doc", "pointer": "p"})
    root_text = roots.join(texts, (F.col("o_doc") == F.col("t_doc")) & (F.col("o_pre") == F.col("t_pre"))).select("o_doc", F.col("t").alias("whole"))
    every = wanted.select("uri", "pointer").distinct().withColumnsRenamed({"uri": "w_uri"}).join(named, F.col("w_uri") == F.col("uri")).join(good, F.col("r_doc") == F.col("g_doc"))
    every = every.join(root_text, F.col("r_doc") == F.col("o_doc")).join(chosen, (F.col("r_doc") == F.col("p_doc")) & F.col("pointer").eqNullSafe(F.col("p")), "left")
    return work.save(every.select("uri", "pointer", F.coalesce("part", "whole").alias("text")), "selected")


def resolve(xml: Shredded, resources: DataFrame) -> Shredded:
    """All includes resolved. Without a resource, the content of a fallback stands instead; without that either, the include goes.

    A document that still includes after MOST_ROUNDS keeps its includes. No href is no include. Text resources are escaped. Resources are
    (uri, xml), or bytes (uri, data): then an include of text is read by its ``encoding`` (UTF-8 without one), and bytes that it cannot read
    are a missing resource.
    """
    work = Workspace(xml.nodes.sparkSession, "xinclude")
    data = resources.select("uri", "data") if "data" in resources.columns else None
    resources = work.save(resources.select("uri", "xml") if data is None else decode(data).select("uri", "xml"), "resources")
    targets = held(shred(resources.select(F.xxhash64("uri").alias("doc_id"), "xml")), work)
    for _ in range(MOST_ROUNDS):
        xml = held(xml, work)  # read many times below
        found = work.save(includes(xml).where("href IS NOT NULL"), "includes")
        if not found.head(1):
            break
        pieces = found.select("doc_id", "pre", F.substring_index("href", "#", 1).alias("uri"), "parse", F.coalesce("xpointer", F.nullif(F.regexp_extract("href", "#(.*)$", 1), F.lit(""))).alias("pointer"), F.coalesce("encoding", F.lit("utf-8")).alias("encoding"))
        selected = _selected(resources, targets, pieces.where("parse = 'xml'"), work).withColumnsRenamed({"uri": "s_uri", "pointer": "s_pointer"})
        as_xml = pieces.where("parse = 'xml'").join(selected, (F.col("uri") == F.col("s_uri")) & F.col("pointer").eqNullSafe(F.col("s_pointer")), "left").select("doc_id", "pre", "text")
        texts = pieces.where("parse = 'text'")
        if data is None:
            raw = resources.select(F.col("uri").alias("s_uri"), escape_text(F.col("xml")).alias("text"))
            as_text = texts.join(raw, F.col("uri") == F.col("s_uri"), "left").select("doc_id", "pre", "text")
        else:
            read = decode(texts.select("uri", "encoding").distinct().join(data, "uri").withColumnsRenamed({"uri": "s_uri", "encoding": "s_encoding"}), column="s_encoding")
            as_text = texts.join(read, (F.col("uri") == F.col("s_uri")) & (F.col("encoding") == F.col("s_encoding")), "left").select("doc_id", "pre", escape_text(F.col("xml")).alias("text"))
        fallback = xml.nodes.where("kind = 'element' AND name = 'fallback'").select(F.col("doc_id").alias("f_doc"), F.col("parent_pre").alias("f_own"), F.col("pre").alias("f_pre"), F.col("level").alias("f_level"))
        inner = xml.nodes.where("kind NOT IN ('attribute', 'document')").join(fallback, (F.col("doc_id") == F.col("f_doc")) & (F.col("parent_pre") == F.col("f_pre"))).select("doc_id", "f_own", "pre")
        inner_text = S.serialize(xml, inner.select("doc_id", "pre")).withColumnsRenamed({"doc_id": "x_doc", "pre": "x_pre", "xml": "x"})
        backs = inner.join(inner_text, (F.col("doc_id") == F.col("x_doc")) & (F.col("pre") == F.col("x_pre"))).groupBy(F.col("doc_id").alias("b_doc"), F.col("f_own").alias("b_pre")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "x"))), lambda v: v["x"]), "").alias("back"))
        filled = as_xml.union(as_text).join(backs, (F.col("doc_id") == F.col("b_doc")) & (F.col("pre") == F.col("b_pre")), "left").select("doc_id", F.col("pre").alias("at"), F.lit(0).alias("side"), F.lit(-1.0).alias("depth"), F.coalesce("text", "back", F.lit("")).alias("s"))
        filled = work.save(filled, "filled")
        parents = xml.nodes.select(F.col("doc_id").alias("n_doc"), F.col("pre").alias("n_pre"), F.col("parent_pre").alias("own"))
        extra = filled.join(parents, (F.col("doc_id") == F.col("n_doc")) & (F.col("at") == F.col("n_pre"))).select("doc_id", "at", "side", "depth", "own", "s")
        spans = _spans(xml, found)
        xml = _with(xml, _without(xml.nodes, spans), _without(xml.ns_decls, spans, "owner_pre"), extra)
    return xml
