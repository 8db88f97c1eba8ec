"""Documents to node tables with built-in expressions: one regular-expression pass, one shuffle by document, windows.

``nodes`` numbers every node of a document in document order: the document itself (0), elements, their attributes right after
them, text, CDATA, comments and processing instructions. ``last`` is the highest number in a node's subtree, so a descendant of x has
``pre`` in (x.pre, x.last]. A document that is not well-formed has a row in ``documents`` with the reason and no nodes.

Element rows also have ``attrs``, a map from an attribute's name as written to its value, and ``leaf``, the string-value of an element
that holds nothing or one piece of text (else null), so that most predicates need no join.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xylem.functions.values import unescape
from xylem.session import Workspace

_NAME = r"[^\s<>/!?=\"'&]+"
_ATTRIBUTE = rf"\s+{_NAME}\s*+=\s*+(?:\"[^\"<]*+\"|'[^'<]*+')"
DOCTYPE = r"<!DOCTYPE(?:[^\[<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:\[(?:<!--(?s:.*?)-->|<\?(?s:.*?)\?>|\"[^\"]*+\"|'[^']*+'|[^\]\"'])*+\]\s*+)?+>"
#: Alternatives in order; possessive loops, so that long tags need no stack. The last takes what fits nothing.
TOKEN = (
    r"<!--(?s:.*?)-->|<!\[CDATA\[(?s:.*?)\]\]>|<\?(?s:.*?)\?>"
    rf"|{DOCTYPE}"
    rf"|</{_NAME}\s*+>|<{_NAME}(?:{_ATTRIBUTE})*+\s*+/?+>|[^<]++|<"
)
MAX_DEPTH = 256
NODE_COLUMNS = ["doc_id", "pre", "last", "level", "parent_pre", "child_ord", "elem_ord", "kind", "name", "prefix", "value", "line", "attrs", "leaf"]
#: Names of elements that hold more than one piece of text are remembered up to so many.
MOST_COMPLEX = 1000


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` for joins by sort and merge. Spark takes the size of a table from its files, and node tables compress so well that what passes for
    a few megabytes can be hundreds in memory: broadcast, it would fill the driver. The hint holds up to the next join or union."""
    return df.hint("merge")


@dataclass
class Shredded:
    """The tables of a collection, never broadcast. ``complex_names``: names of all elements that lack a ``leaf``, where that is known."""

    documents: DataFrame
    nodes: DataFrame
    ns_decls: DataFrame
    complex_names: frozenset[str] | None = None

    def __post_init__(self):
        self.documents, self.nodes, self.ns_decls = by_merge(self.documents), by_merge(self.nodes), by_merge(self.ns_decls)


def held(xml: Shredded, work: Workspace) -> Shredded:
    """The collection at rest: its tables written once, for many queries."""
    nodes = work.save(xml.nodes, "nodes")
    names = [r.name for r in nodes.where("kind = 'element' AND leaf IS NULL").select("name").distinct().limit(MOST_COMPLEX + 1).collect()]  # of the vocabulary's size, and bounded
    return Shredded(work.save(xml.documents, "documents"), nodes, work.save(xml.ns_decls, "ns_decls"), frozenset(names) if len(names) <= MOST_COMPLEX else None)


def _prefix(q: Column) -> Column:
    return F.when(q.contains(":"), F.substring_index(q, ":", 1))


def _local(q: Column) -> Column:
    return F.when(q.contains(":"), F.substring_index(q, ":", -1)).otherwise(q)


def tokens(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """(doc_id, pos, tok, kind) of the markup and text of each document, ends of lines normalised; dealt by document."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(xml_col), F.lit("")), "^﻿", ""), "\r\n?", "\n")
    # whole documents are dealt, not their tokens: what follows keeps this partitioning
    t = docs.repartition(id_col).select(F.col(id_col).alias("doc_id"), F.posexplode_outer(F.regexp_extract_all(text, F.lit(TOKEN), 0)).alias("pos", "tok"))
    tok = F.col("tok")
    blank = ~tok.rlike(r"[^ \t\n\r]")
    kind = (
        F.when(tok.isNull(), "none").when(tok.startswith("<!--"), "comment").when(tok.startswith("<![CDATA["), "cdata")
        .when(tok.rlike(r"^<\?xml[\s?]"), "xmldecl").when(tok.startswith("<?"), "pi").when(tok.startswith("<!DOCTYPE"), "doctype")
        .when(tok.startswith("</"), "close").when(tok == "<", "bad").when(tok.startswith("<") & tok.endswith("/>"), "empty").when(tok.startswith("<"), "open")
        .when(blank, "space").otherwise("text")
    )
    return t.withColumn("kind", kind)


def shred(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", drop_space: bool = False, strict: bool = False, entities: dict[str, str] | None = None, max_depth: int = MAX_DEPTH, save: bool = True) -> Shredded:
    """Shred (id, xml) rows. ``drop_space`` drops white-space-only text; ``strict`` makes unknown entities an error; ``entities`` adds internal ones.
    Those that a document's own type declares are expanded too, in text and attribute values; text that refers to one in circles keeps all such references.

    Ids must be unique. Null or empty xml is a document without a root. With ``save`` the token table is written once and read by
    all three tables.
    """
    work = Workspace(docs.sparkSession, "shred")
    t = tokens(docs, id_col, xml_col)
    tok, kind = F.col("tok"), F.col("kind")
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc_id")
    tag = kind.isin("open", "empty")
    qname = F.when(tag | (kind == "close"), F.regexp_extract(tok, rf"^</?({_NAME})", 1)).when(kind == "pi", F.regexp_extract(tok, r"^<\?([^\s?]*)", 1))
    pairs = F.when(tag, F.regexp_extract_all(tok, F.lit(rf"{_NAME}\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+')"), 0)).otherwise(F.array().cast("array<string>"))
    name_of = lambda x: F.regexp_extract(x, rf"^({_NAME})\s*=", 1)
    value_of = lambda x: F.regexp_extract(x, r"(?s)=\s*[\"'](.*)[\"']$", 1)
    every = F.transform(pairs, lambda x: F.struct(name_of(x).alias("name"), value_of(x).alias("value")))
    t = t.withColumns({"qname": qname, "pairs": every})
    t = t.withColumns({
        "attrs": F.filter("pairs", lambda x: ~x["name"].rlike("^xmlns(:|$)")),
        "decls": F.filter("pairs", lambda x: x["name"].rlike("^xmlns(:|$)")),
        "step": F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0),
    })
    # one shuffle by document; all windows below keep it
    t = t.withColumns({"depth": F.coalesce(F.sum("step").over(before), F.lit(0)), "line": F.lit(1) + F.coalesce(F.sum(F.length("tok") - F.length(F.replace("tok", F.lit("\n")))).over(before), F.lit(0))})
    t = t.withColumn("level", F.when(kind == "close", F.col("depth")).otherwise(F.col("depth") + 1))
    inside = F.col("depth") > 0
    is_text = kind.isin("text", "space")
    node = tag | (is_text & inside & ((kind == "text") | F.lit(not drop_space))) | (kind.isin("comment", "cdata") & inside) | (kind == "pi")
    t = t.withColumn("node", node)
    t = t.withColumn("weight", F.when(F.col("node"), F.lit(1) + F.size("attrs")).otherwise(0))
    t = t.withColumn("pre", (F.coalesce(F.sum("weight").over(before), F.lit(0)) + 1).cast("int"))
    pair = Window.partitionBy("doc_id", "level", kind.isin("open", "close")).orderBy("pos")
    nxt = lambda c: F.lead(c).over(pair)
    t = t.withColumns({"close_kind": nxt(kind), "close_name": nxt(F.col("qname")), "close_pre": nxt(F.col("pre"))})
    unknown = F.lit(False)
    if strict:
        known = "|".join(["lt", "gt", "amp", "quot", "apos", "#[0-9]+", "#x[0-9A-Fa-f]+", *(entities or {})])
        unknown = (is_text | tag) & tok.rlike(rf"&(?!(?:{known});)")
    root = tag & ~inside
    error = (
        F.when(kind == "bad", "markup that is not well-formed")
        .when((kind == "close") & (F.col("depth") <= 0), "a close tag without an open one")
        .when((kind == "open") & ((F.col("close_kind") != "close") | F.col("close_kind").isNull()), "an element that is not closed")
        .when((kind == "open") & (F.col("close_name") != F.col("qname")), "a close tag that does not match")
        .when((kind == "text") & ~inside, "text outside the root")
        .when((kind == "cdata") & ~inside, "CDATA outside the root")
        .when(tag & (F.size(F.array_distinct(F.transform("pairs", lambda x: x["name"]))) != F.size("pairs")), "an attribute that repeats")
        .when(tag & (F.col("level") > max_depth), "too deep")
        .when((kind == "xmldecl") & (F.col("pos") > 0), "a declaration that is not at the start")
        .when((kind == "doctype") & inside, "a document type inside the root")
        .when(unknown, "an unknown entity")
    )
    t = t.withColumn("error", error)
    roots = F.sum(F.when(root, 1).otherwise(0)).over(whole)
    found = F.min(F.when(F.col("error").isNotNull(), F.struct("pos", "line", "error"))).over(whole)
    problem = F.coalesce(found["error"], F.when(roots == 0, "no root element").when(roots > 1, "more than one root element"))
    t = t.withColumns({"problem": problem, "error_line": found["line"], "root_qname": F.first(F.when(root, F.col("qname")), True).over(whole), "total": F.sum("weight").over(whole).cast("int")})
    t = t.drop("pairs", "step", "error", "close_kind", "close_name")
    if save:
        t = work.save(t, "tokens")
    declaring = t.where("kind = 'doctype' AND contains(tok, '<!ENTITY')")
    own = None
    if not save or declaring.head(1):
        own = work.save(declaring.select("doc_id", "tok").mapInPandas(_declared, f"e_doc {t.schema['doc_id'].dataType.simpleString()}, own map<string,string>"), "entities")
    return Shredded(_documents(t), _nodes(t, entities, own), _decls(t, entities, own))


def _declared(frames):
    """(document, reference to text) of the internal general entities that document types declare; null where one goes in circles."""
    from xylem.operators.dtd import internal_entities

    for f in frames:
        yield pd.DataFrame({"e_doc": f["doc_id"], "own": [{f"&{k};": v for k, v in internal_entities(tok).items()} for tok in f["tok"]]})


def _with_own(t: DataFrame, own: DataFrame | None) -> tuple[DataFrame, Column | None]:
    """``t`` with its document's own entities, if any document has some."""
    if own is None:
        return t, None
    return t.join(by_merge(own), F.col("doc_id") == F.col("e_doc"), "left").drop("e_doc"), F.col("own")


def _documents(t: DataFrame) -> DataFrame:
    """(doc_id, status, error, error_line, root_name, version, encoding, standalone, had_decl, doctype) of every document."""
    decl = F.max(F.when(F.col("kind") == "xmldecl", F.col("tok")))
    doctype = F.min_by("tok", F.when(F.col("kind") == "doctype", F.col("pos")))
    g = t.groupBy("doc_id").agg(F.first("problem").alias("error"), F.first("error_line").alias("error_line"), F.first("root_qname").alias("root"), decl.alias("decl"), doctype.alias("dt"))
    get = lambda k: F.nullif(F.regexp_extract("decl", rf"{k}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    part = lambda p, i=1: F.nullif(F.regexp_extract("dt", p, i), F.lit(""))
    public = r"^<!DOCTYPE\s+\S+\s+PUBLIC\s+[\"']([^\"']*)[\"']\s+[\"']([^\"']*)[\"']"
    struct = F.when(F.col("dt").isNotNull(), F.struct(part(r"^<!DOCTYPE\s+([^\s>\[]+)").alias("name"), part(public).alias("public_id"), F.coalesce(part(public, 2), part(r"^<!DOCTYPE\s+\S+\s+SYSTEM\s+[\"']([^\"']*)[\"']")).alias("system_id"), part(r"(?s)\[(.*)\]\s*>$").alias("internal_subset")))
    return g.select("doc_id", F.when(F.col("error").isNull(), "OK").otherwise("PARSE").alias("status"), "error", "error_line", F.when(F.col("error").isNull(), _local(F.col("root"))).alias("root_name"), get("version").alias("version"), get("encoding").alias("encoding"), get("standalone").alias("standalone"), F.col("decl").isNotNull().alias("had_decl"), struct.alias("doctype"))


def _nodes(t: DataFrame, entities, own_entities: DataFrame | None) -> DataFrame:
    kind, tok = F.col("kind"), F.col("tok")
    good, declared = _with_own(t.where("problem IS NULL AND node"), own_entities)
    size = F.size("attrs")
    last = F.when(kind == "open", F.col("close_pre") - 1).when(kind == "empty", F.col("pre") + size).otherwise(F.col("pre"))
    value = (
        F.when(kind == "comment", F.expr("substring(tok, 5, length(tok) - 7)")).when(kind == "cdata", F.expr("substring(tok, 10, length(tok) - 12)"))
        .when(kind == "pi", F.regexp_extract(tok, r"(?s)^<\?[^\s?]+\s?(.*)\?>$", 1)).when(kind.isin("text", "space"), unescape(tok, entities, declared))
    )
    named = F.when(kind.isin("open", "empty"), "element").when(kind.isin("text", "space"), "text").otherwise(kind)
    attrs = F.transform("attrs", lambda x: F.struct(x["name"].alias("q"), unescape(F.translate(x["value"], "\n\t", "  "), entities, declared).alias("v")))
    base = good.select("doc_id", "pre", last.cast("int").alias("last"), "level", named.alias("kind"), "qname", value.alias("value"), "line", attrs.alias("attrs"))
    # one shuffle by document serves this and the windows below
    after = Window.partitionBy("doc_id").orderBy("pre")
    following = lambda c: F.lead(c).over(after)
    single = (following("pre") == F.col("last")) & following("kind").isin("text", "cdata")
    leaf = F.when(F.col("kind") == "element", F.when(F.col("last") == F.col("pre") + F.size("attrs"), "").when(single, following("value")))
    base = base.withColumn("leaf", leaf)
    # the parent is the latest element a level above: each element also stands where its children look for it
    seen = base.withColumn("at", F.explode(F.when(F.col("kind") == "element", F.array(F.col("level") - 1, F.col("level"))).otherwise(F.array(F.col("level") - 1))))
    look = Window.partitionBy("doc_id", "at").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    up = F.last(F.when((F.col("kind") == "element") & (F.col("level") == F.col("at")), F.col("pre")), True).over(look)
    own = seen.withColumn("parent_pre", F.coalesce(up, F.lit(0))).where("at = level - 1").drop("at")
    sib = Window.partitionBy("doc_id", "parent_pre").orderBy("pre")
    own = own.withColumn("child_ord", F.row_number().over(sib)).withColumn("elem_ord", F.when(F.col("kind") == "element", F.sum(F.when(F.col("kind") == "element", 1).otherwise(0)).over(sib)).cast("int"))
    parts = lambda q: (F.when(F.col("kind") == "pi", q).otherwise(_local(q)), F.when(F.col("kind") != "pi", _prefix(q)))
    itself = F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("q"), F.lit(None).cast("string").alias("v"))
    each = F.transform("attrs", lambda x, i: F.struct((i + 1).alias("i"), x["q"].alias("q"), x["v"].alias("v")))
    rows = own.withColumn("a", F.explode(F.concat(F.array(itself), each)))
    i, isattr = F.col("a.i"), F.col("a.i") > 0
    q = F.coalesce("a.q", "qname")
    local, prefix = parts(q)
    out = rows.select(
        "doc_id", (F.col("pre") + i).cast("int").alias("pre"), F.when(isattr, F.col("pre") + i).otherwise(F.col("last")).cast("int").alias("last"), F.when(isattr, F.col("level") + 1).otherwise(F.col("level")).cast("int").alias("level"),
        F.when(isattr, F.col("pre")).otherwise(F.col("parent_pre")).cast("int").alias("parent_pre"), F.when(isattr, i).otherwise(F.col("child_ord")).cast("int").alias("child_ord"), F.when(~isattr, F.col("elem_ord")).cast("int").alias("elem_ord"),
        F.when(isattr, "attribute").otherwise(F.col("kind")).alias("kind"), local.alias("name"), prefix.alias("prefix"), F.coalesce("a.v", "value").alias("value"), F.col("line").cast("int").alias("line"),
        F.when(~isattr & (F.col("kind") == "element"), F.map_from_entries("attrs")).alias("attrs"), F.when(~isattr, F.col("leaf")).alias("leaf"),
    )
    top = t.where("problem IS NULL AND pos = 0").select("doc_id", F.lit(0).alias("pre"), F.col("total").alias("last"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("parent_pre"), F.lit(1).alias("child_ord"), F.lit(None).cast("int").alias("elem_ord"), F.lit("document").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("line"), F.lit(None).cast("map<string,string>").alias("attrs"), F.lit(None).cast("string").alias("leaf"))
    return out.union(top)


def _decls(t: DataFrame, entities, own: DataFrame | None) -> DataFrame:
    """(doc_id, owner_pre, owner_last, prefix, uri); the default namespace has an empty prefix."""
    rows, declared = _with_own(t.where("problem IS NULL AND size(decls) > 0"), own)
    last = F.when(F.col("kind") == "open", F.col("close_pre") - 1).otherwise(F.col("pre") + F.size("attrs"))
    x = rows.select("doc_id", F.col("pre").alias("owner_pre"), last.cast("int").alias("owner_last"), F.explode("decls").alias("d"), *(["own"] if own is not None else []))
    return x.select("doc_id", "owner_pre", "owner_last", F.when(F.col("d.name") == "xmlns", "").otherwise(F.substring_index("d.name", ":", -1)).alias("prefix"), unescape(F.col("d.value"), entities, declared).alias("uri"))


def with_namespaces(nodes: DataFrame, ns_decls: DataFrame) -> DataFrame:
    """``nodes`` with ``ns_uri``: the nearest declaration of the prefix on the element or above it; unprefixed attributes have none."""
    n = nodes.withColumn("_p", F.when(F.col("kind") == "element", F.coalesce("prefix", F.lit(""))).when(F.col("kind") == "attribute", F.col("prefix")))
    d = ns_decls.select(F.col("doc_id").alias("d_doc"), "owner_pre", "owner_last", F.col("prefix").alias("d_prefix"), "uri")
    near = n.where("_p IS NOT NULL").join(d, (F.col("doc_id") == F.col("d_doc")) & (F.col("_p") == F.col("d_prefix")) & (F.col("pre") >= F.col("owner_pre")) & (F.col("pre") <= F.col("owner_last")))
    near = near.groupBy(F.col("doc_id").alias("n_doc"), F.col("pre").alias("n_pre")).agg(F.nullif(F.max_by("uri", "owner_pre"), F.lit("")).alias("ns_uri"))
    out = n.join(by_merge(near), (F.col("doc_id") == F.col("n_doc")) & (F.col("pre") == F.col("n_pre")), "left").drop("n_doc", "n_pre", "_p")
    return out.withColumn("ns_uri", F.when(F.col("prefix") == "xml", "http://www.w3.org/XML/1998/namespace").otherwise(F.col("ns_uri")))


def shred_fragments(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", **options) -> Shredded:
    """Like ``shred`` for fragments: several top elements and text are allowed; they stand below an element named ``#document-fragment``."""
    s = shred(docs.withColumn(xml_col, F.concat(F.lit("<document-fragment>"), xml_col, F.lit("</document-fragment>"))), id_col, xml_col, **options)
    name = F.when((F.col("pre") == 1) & (F.col("kind") == "element"), "#document-fragment").otherwise(F.col("name"))
    return Shredded(s.documents, s.nodes.withColumn("name", name), s.ns_decls, s.complex_names)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, xml) of each file at ``path``, one document a file, ids by the hash of the path."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("path"), F.col("value").alias("xml"))
