"""Node tables back to text: plain, indented and canonical XML, and JSON.

Each node gives a piece where it opens and, for elements, one where it closes; pieces are put in order within a document and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.functions.values import escape_attribute, escape_text
from xylem.sources.shred import Shredded, by_merge


def _qname(c: str = "") -> Column:
    return F.concat_ws(":", f"{c}prefix", f"{c}name")


def _join(pieces: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Pieces (keys, at, side, depth, s) joined in order: openings by place, closings after all that lies within, inner ones first."""
    parts = F.array_sort(F.collect_list(F.struct("at", "side", "depth", "s")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias(out))


def _canonical_attribute(s: Column) -> Column:
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        s = F.replace(s, F.lit(raw), F.lit(shown))
    return s


def _canonical_text(s: Column) -> Column:
    return F.replace(escape_text(s), F.lit("\r"), F.lit("&#xD;"))


def serialize(xml: Shredded, nodes: DataFrame | None = None, declaration: bool = False, indent: int = 0, extra: DataFrame | None = None) -> DataFrame:
    """(doc_id, xml) of every document; with ``nodes`` (doc_id, pre), (doc_id, pre, xml) of those subtrees.

    The declaration is written if asked for or if the source had one, then the document type. Empty elements are ``<e/>``; attributes come before
    namespace declarations. ``extra`` (doc_id, at, side, depth, own, s) are pieces to put in, see ``edit``. ``indent`` puts elements of element-only content on lines of their own.
    """
    attr = xml.nodes.where("kind = 'attribute'").select("doc_id", F.col("parent_pre").alias("own"), F.col("pre").alias("k"), F.concat(F.lit(" "), _qname(), F.lit('="'), escape_attribute(F.col("value")), F.lit('"')).alias("s"))
    name = F.concat(F.lit(" xmlns"), F.when(F.col("prefix") != "", F.concat(F.lit(":"), "prefix")).otherwise(""))
    decl = xml.ns_decls.select("doc_id", F.col("owner_pre").alias("own"), (F.lit(1 << 30) + F.row_number().over(Window.partitionBy("doc_id", "owner_pre").orderBy("prefix"))).alias("k"), F.concat(name, F.lit('="'), escape_attribute(F.col("uri")), F.lit('"')).alias("s"))
    return _write(xml, attr.unionByName(decl), nodes, declaration, indent, extra)


def _write(xml: Shredded, tails: DataFrame, nodes: DataFrame | None, declaration: bool, indent: int, extra: DataFrame | None = None) -> DataFrame:
    tails = tails.groupBy(F.col("doc_id").alias("t_doc"), "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), "").alias("tail"))
    n = xml.nodes.where("kind NOT IN ('attribute', 'document')")
    inside = n.select("doc_id", "parent_pre", F.col("kind").isin("text", "cdata").alias("chars"))
    if extra is not None:
        inside = inside.union(extra.where("own IS NOT NULL").select("doc_id", "own", F.lit(True)))
    kids = inside.groupBy(F.col("doc_id").alias("c_doc"), F.col("parent_pre").alias("c_pre")).agg(F.max("chars").alias("mixed"))
    n = n.join(tails, (F.col("doc_id") == F.col("t_doc")) & (F.col("pre") == F.col("own")), "left").join(by_merge(kids), (F.col("doc_id") == F.col("c_doc")) & (F.col("pre") == F.col("c_pre")), "left")
    full = F.col("mixed").isNotNull()
    q, tail = _qname(), F.coalesce("tail", F.lit(""))
    opened = (
        F.when(F.col("kind") == "element", F.concat(F.lit("<"), q, tail, F.when(full, ">").otherwise("/>"))).when(F.col("kind") == "text", escape_text(F.col("value")))
        .when(F.col("kind") == "cdata", F.concat(F.lit("<![CDATA["), "value", F.lit("]]>"))).when(F.col("kind") == "comment", F.concat(F.lit("<!--"), "value", F.lit("-->")))
        .otherwise(F.concat(F.lit("<?"), "name", F.when(F.col("value") != "", F.concat(F.lit(" "), "value")).otherwise(""), F.lit("?>")))
    )
    closed = F.concat(F.lit("</"), q, F.lit(">"))
    if indent:
        up = kids.select(F.col("c_doc").alias("u_doc"), F.col("c_pre").alias("u_pre"), F.col("mixed").alias("u_mixed"))
        n = n.join(by_merge(up), (F.col("doc_id") == F.col("u_doc")) & (F.col("parent_pre") == F.col("u_pre")), "left")
        line = F.concat(F.lit("\n"), F.repeat(F.lit(" " * indent), F.col("level") - 1))
        opened = F.concat(F.when((F.col("level") > 1) & ~F.coalesce("u_mixed", F.lit(False)), line).otherwise(""), opened)
        closed = F.concat(F.when(~F.coalesce("mixed", F.lit(True)), line).otherwise(""), closed)
    piece = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("side"), F.col("level").cast("double").alias("depth"), opened.alias("s")), F.struct(F.col("last").alias("at"), F.lit(1).alias("side"), (-F.col("level")).cast("double").alias("depth"), F.when((F.col("kind") == "element") & full, closed).otherwise("").alias("s")))
    rows = n.select("doc_id", "pre", F.explode(piece).alias("p")).select("doc_id", "pre", "p.*")
    if extra is not None:
        rows = rows.union(extra.select("doc_id", F.col("at").alias("pre"), "at", "side", "depth", "s"))
    if nodes is not None:
        spans = nodes.select("doc_id", "pre").distinct().join(xml.nodes.select(F.col("doc_id").alias("w_doc"), F.col("pre").alias("w_pre"), "last"), (F.col("doc_id") == F.col("w_doc")) & (F.col("pre") == F.col("w_pre")))
        spans = spans.select(F.col("w_doc"), F.col("w_pre"), F.col("last").alias("w_last"))
        inner = rows.join(by_merge(spans), (F.col("doc_id") == F.col("w_doc")) & (F.col("pre") >= F.col("w_pre")) & (F.col("pre") <= F.col("w_last")))
        return _join(inner, ["w_doc", "w_pre"], "xml").withColumnsRenamed({"w_doc": "doc_id", "w_pre": "pre"})
    body = _join(rows, ["doc_id"], "body")
    d = xml.documents.where("status = 'OK'")
    head = F.when(F.col("had_decl") | F.lit(declaration), F.concat(F.lit('<?xml version="'), F.coalesce("version", F.lit("1.0")), F.lit('"'), F.coalesce(F.concat(F.lit(' encoding="'), "encoding", F.lit('"')), F.lit("")), F.coalesce(F.concat(F.lit(' standalone="'), "standalone", F.lit('"')), F.lit("")), F.lit("?>\n"))).otherwise("")
    ids = F.coalesce(F.concat(F.lit(' PUBLIC "'), "doctype.public_id", F.lit('" "'), "doctype.system_id", F.lit('"')), F.concat(F.lit(' SYSTEM "'), "doctype.system_id", F.lit('"')), F.lit(""))
    dt = F.when(F.col("doctype").isNotNull(), F.concat(F.lit("<!DOCTYPE "), "doctype.name", ids, F.coalesce(F.concat(F.lit(" ["), "doctype.internal_subset", F.lit("]")), F.lit("")), F.lit(">\n"))).otherwise("")
    return d.join(body.withColumnRenamed("doc_id", "b_doc"), F.col("doc_id") == F.col("b_doc")).select("doc_id", F.concat(head, dt, "body").alias("xml"))


def canonical(xml: Shredded, comments: bool = False, exclusive: bool = False, inclusive_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, xml) in canonical form (Canonical XML 1.0), or in exclusive canonical form with a list of prefixes to treat inclusively."""
    esc = _canonical_attribute
    uris = xml.ns_decls.select(F.col("doc_id").alias("u_doc"), "owner_pre", "owner_last", F.col("prefix").alias("u_prefix"), "uri")
    a = xml.nodes.where("kind = 'attribute'")
    near = a.where("prefix IS NOT NULL").join(uris, (F.col("doc_id") == F.col("u_doc")) & (F.col("prefix") == F.col("u_prefix")) & (F.col("parent_pre") >= F.col("owner_pre")) & (F.col("parent_pre") <= F.col("owner_last")))
    near = near.groupBy(F.col("doc_id").alias("n_doc"), F.col("pre").alias("n_pre")).agg(F.max_by("uri", "owner_pre").alias("uri"))
    a = a.join(near, (F.col("doc_id") == F.col("n_doc")) & (F.col("pre") == F.col("n_pre")), "left")
    attr = a.select("doc_id", F.col("parent_pre").alias("own"), F.struct(F.lit(1), F.coalesce("uri", F.when(F.col("prefix") == "xml", "http://www.w3.org/XML/1998/namespace"), F.lit("")), "name").alias("k"), F.concat(F.lit(" "), _qname(), F.lit('="'), esc(F.col("value")), F.lit('"')).alias("s"))
    shown = _exclusive(xml, inclusive_prefixes) if exclusive else _inclusive(xml)
    name = F.concat(F.lit(" xmlns"), F.when(F.col("prefix") != "", F.concat(F.lit(":"), "prefix")).otherwise(""))
    decl = shown.select("doc_id", "own", F.struct(F.lit(0), F.col("prefix"), F.lit("")).alias("k"), F.concat(name, F.lit('="'), esc(F.col("uri")), F.lit('"')).alias("s"))
    tails = attr.union(decl).groupBy(F.col("doc_id").alias("t_doc"), "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), "").alias("tail"))
    n = xml.nodes.where("kind NOT IN ('attribute', 'document')" + ("" if comments else " AND kind <> 'comment'"))
    n = n.join(tails, (F.col("doc_id") == F.col("t_doc")) & (F.col("pre") == F.col("own")), "left")
    q = _qname()
    root = xml.nodes.where("parent_pre = 0 AND kind = 'element'").select(F.col("doc_id").alias("r_doc"), F.col("pre").alias("r_pre"))
    n = n.join(root, F.col("doc_id") == F.col("r_doc"))
    outer = (F.col("parent_pre") == 0) & (F.col("kind") != "element")
    before, after = F.when(outer & (F.col("pre") > F.col("r_pre")), "\n").otherwise(""), F.when(outer & (F.col("pre") < F.col("r_pre")), "\n").otherwise("")
    opened = (
        F.when(F.col("kind") == "element", F.concat(F.lit("<"), q, F.coalesce("tail", F.lit("")), F.lit(">"))).when(F.col("kind").isin("text", "cdata"), _canonical_text(F.col("value")))
        .when(F.col("kind") == "comment", F.concat(before, F.lit("<!--"), "value", F.lit("-->"), after)).otherwise(F.concat(before, F.lit("<?"), "name", F.when(F.col("value") != "", F.concat(F.lit(" "), "value")).otherwise(""), F.lit("?>"), after))
    )
    closed = F.when(F.col("kind") == "element", F.concat(F.lit("</"), q, F.lit(">"))).otherwise("")
    piece = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("side"), F.col("level").alias("depth"), opened.alias("s")), F.struct(F.col("last").alias("at"), F.lit(1).alias("side"), (-F.col("level")).alias("depth"), closed.alias("s")))
    return _join(n.select("doc_id", F.explode(piece).alias("p")).select("doc_id", "p.*"), ["doc_id"], "xml")


def _inclusive(xml: Shredded) -> DataFrame:
    """Declarations that change what is in scope: (doc_id, own, prefix, uri)."""
    d = xml.ns_decls
    up = d.select(F.col("doc_id").alias("u_doc"), F.col("owner_pre").alias("u_pre"), F.col("owner_last").alias("u_last"), F.col("prefix").alias("u_prefix"), F.col("uri").alias("u_uri"))
    j = d.join(up, (F.col("doc_id") == F.col("u_doc")) & (F.col("prefix") == F.col("u_prefix")) & (F.col("u_pre") < F.col("owner_pre")) & (F.col("u_last") >= F.col("owner_pre")), "left")
    g = j.groupBy("doc_id", F.col("owner_pre").alias("own"), "prefix", "uri").agg(F.max_by("u_uri", "u_pre").alias("above"))
    return g.where("NOT (coalesce(above, '') = uri)").drop("above")


def _exclusive(xml: Shredded, inclusive: tuple[str, ...]) -> DataFrame:
    """Declarations of visibly used prefixes where the nearest element that shows the prefix has another URI."""
    e = xml.nodes.where("kind IN ('element', 'attribute')")
    used = e.where("kind = 'element' OR prefix IS NOT NULL").select("doc_id", F.when(F.col("kind") == "element", F.col("pre")).otherwise(F.col("parent_pre")).alias("own"), F.coalesce("prefix", F.lit("")).alias("prefix")).where("prefix <> 'xml'").distinct()
    spans = xml.nodes.where("kind = 'element'").select(F.col("doc_id").alias("s_doc"), F.col("pre").alias("s_pre"), F.col("last").alias("s_last"))
    used = used.join(spans, (F.col("doc_id") == F.col("s_doc")) & (F.col("own") == F.col("s_pre"))).select("doc_id", "own", F.col("s_last").alias("own_last"), "prefix")
    d = xml.ns_decls.select(F.col("doc_id").alias("d_doc"), "owner_pre", "owner_last", F.col("prefix").alias("d_prefix"), "uri")
    near = used.join(d, (F.col("doc_id") == F.col("d_doc")) & (F.col("prefix") == F.col("d_prefix")) & (F.col("own") >= F.col("owner_pre")) & (F.col("own") <= F.col("owner_last")), "left")
    near = near.groupBy("doc_id", "own", "own_last", "prefix").agg(F.coalesce(F.max_by("uri", "owner_pre"), F.lit("")).alias("uri"))
    up = near.select(F.col("doc_id").alias("u_doc"), F.col("own").alias("u_own"), F.col("own_last").alias("u_last"), F.col("prefix").alias("u_prefix"), F.col("uri").alias("u_uri"))
    j = near.join(by_merge(up), (F.col("doc_id") == F.col("u_doc")) & (F.col("prefix") == F.col("u_prefix")) & (F.col("u_own") < F.col("own")) & (F.col("u_last") >= F.col("own")), "left")
    out = j.groupBy("doc_id", "own", "prefix", "uri").agg(F.max_by("u_uri", "u_own").alias("above")).where("coalesce(above, '') <> uri").drop("above")
    if inclusive:
        listed = F.col("prefix").isin(["" if p == "#default" else p for p in inclusive])
        out = out.where(~listed).union(_inclusive(xml).where(listed).select("doc_id", "own", "prefix", "uri"))
    return out


def digest(xml: Shredded, bits: int = 256, **options) -> DataFrame:
    """(doc_id, digest) of the canonical form."""
    return canonical(xml, **options).select("doc_id", F.sha2("xml", bits).alias("digest"))


def to_json(xml: Shredded) -> DataFrame:
    """(doc_id, json): {name, attributes, text, children} of the root, built level by level from the deepest."""
    e = xml.nodes.where("kind = 'element'").select("doc_id", "pre", "parent_pre", "level", "name")
    a = xml.nodes.where("kind = 'attribute'").groupBy(F.col("doc_id").alias("a_doc"), F.col("parent_pre").alias("a_pre")).agg(F.array_sort(F.collect_list(F.struct("child_ord", _qname().alias("n"), "value"))).alias("a"))
    t = xml.nodes.where("kind IN ('text', 'cdata')").groupBy(F.col("doc_id").alias("t_doc"), F.col("parent_pre").alias("t_pre")).agg(F.array_sort(F.collect_list(F.struct("pre", "value"))).alias("t"))
    e = e.join(a, (F.col("doc_id") == F.col("a_doc")) & (F.col("pre") == F.col("a_pre")), "left").join(t, (F.col("doc_id") == F.col("t_doc")) & (F.col("pre") == F.col("t_pre")), "left")
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    attrs = F.array_join(F.transform(F.coalesce("a", F.array().cast("array<struct<child_ord:int,n:string,value:string>>")), lambda x: F.concat(quoted(x["n"]), F.lit(":"), quoted(x["value"]))), ",")
    text = F.array_join(F.transform(F.coalesce("t", F.array().cast("array<struct<pre:int,value:string>>")), lambda x: x["value"]), "")
    e = e.select("doc_id", "pre", "parent_pre", "level", F.concat(F.lit('{"name":'), quoted(F.col("name")), F.lit(',"attributes":{'), attrs, F.lit('},"text":'), quoted(text), F.lit(',"children":[')).alias("head"))
    # opening and closing pieces in document order make the nested text; a comma stands before every child but the first
    spans = xml.nodes.where("kind = 'element'").select(F.col("doc_id").alias("s_doc"), F.col("pre").alias("s_pre"), "last", "elem_ord")
    e = e.join(spans, (F.col("doc_id") == F.col("s_doc")) & (F.col("pre") == F.col("s_pre")))
    piece = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("side"), F.col("level").alias("depth"), F.concat(F.when((F.col("elem_ord") > 1) & (F.col("level") > 1), ",").otherwise(""), "head").alias("s")), F.struct(F.col("last").alias("at"), F.lit(1).alias("side"), (-F.col("level")).alias("depth"), F.lit("]}").alias("s")))
    return _join(e.select("doc_id", F.explode(piece).alias("p")).select("doc_id", "p.*"), ["doc_id"], "json")
