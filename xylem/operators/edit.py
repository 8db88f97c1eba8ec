"""Edits of documents: each takes a collection and target nodes (doc_id, pre) and gives the edited collection.

Edits change rows or put pieces of text between the pieces that serialization makes; the result is shredded anew, which numbers
all nodes again and reports an edit that breaks a document. Sources are never changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.functions.values import escape_text
from xylem.operators.serialize import serialize
from xylem.sources.shred import Shredded, by_merge, shred


def _with(xml: Shredded, nodes: DataFrame | None = None, ns_decls: DataFrame | None = None, extra: DataFrame | None = None) -> Shredded:
    changed = Shredded(xml.documents, xml.nodes if nodes is None else nodes, xml.ns_decls if ns_decls is None else ns_decls)
    return shred(serialize(changed, extra=extra))


def _hit(df: DataFrame, targets: DataFrame, pre: str = "pre", how: str = "left_semi") -> DataFrame:
    t = targets.select(F.col("doc_id").alias("t_doc"), F.col("pre").alias("t_pre")).distinct()
    return df.join(by_merge(t), (F.col("doc_id") == F.col("t_doc")) & (F.col(pre) == F.col("t_pre")), how)


def _spans(xml: Shredded, targets: DataFrame) -> DataFrame:
    return _hit(xml.nodes, targets).select(F.col("doc_id").alias("s_doc"), F.col("pre").alias("s_pre"), F.col("last").alias("s_last"), F.col("level").alias("s_level"), F.col("parent_pre").alias("s_parent"))


def _without(df: DataFrame, spans: DataFrame, pre: str = "pre", own: bool = True) -> DataFrame:
    """Rows outside the spans (with ``own`` False, the spans' tops and their attributes stay)."""
    low = F.col(pre) >= F.col("s_pre") if own else F.col(pre) > F.col("s_pre")
    return df.join(by_merge(spans), (F.col("doc_id") == F.col("s_doc")) & low & (F.col(pre) <= F.col("s_last")), "left_anti")


def remove(xml: Shredded, targets: DataFrame) -> Shredded:
    """Without the targets and all below them; attributes too can be targets."""
    spans = _spans(xml, targets)
    return _with(xml, _without(xml.nodes, spans), _without(xml.ns_decls, spans, "owner_pre"))


def remove_children(xml: Shredded, targets: DataFrame) -> Shredded:
    spans = _spans(xml, targets)
    mine = _hit(xml.nodes.where("kind = 'attribute'"), targets, "parent_pre")
    return _with(xml, _without(xml.nodes, spans, own=False).union(mine), _without(xml.ns_decls, spans, "owner_pre", own=False))


def rename(xml: Shredded, targets: DataFrame, name: str) -> Shredded:
    prefix, _, local = name.rpartition(":")
    marked = _hit(xml.nodes.withColumn("hit", F.lit(True)), targets).select("doc_id", "pre", "hit").withColumnsRenamed({"doc_id": "h_doc", "pre": "h_pre"})
    n = xml.nodes.join(marked, (F.col("doc_id") == F.col("h_doc")) & (F.col("pre") == F.col("h_pre")), "left")
    n = n.withColumn("name", F.when(F.col("hit"), local).otherwise(F.col("name"))).withColumn("prefix", F.when(F.col("hit"), F.lit(prefix or None)).otherwise(F.col("prefix")))
    return _with(xml, n.select(*xml.nodes.columns))


def set_value(xml: Shredded, targets: DataFrame, value: str) -> Shredded:
    """New content of text, CDATA, comment, instruction or attribute nodes."""
    marked = _hit(xml.nodes, targets).select(F.col("doc_id").alias("h_doc"), F.col("pre").alias("h_pre"))
    n = xml.nodes.join(marked, (F.col("doc_id") == F.col("h_doc")) & (F.col("pre") == F.col("h_pre")), "left")
    return _with(xml, n.withColumn("value", F.when(F.col("h_doc").isNotNull(), value).otherwise(F.col("value"))).select(*xml.nodes.columns))


def set_attribute(xml: Shredded, targets: DataFrame, name: str, value: str | bool | float) -> Shredded:
    """The attribute gets the value; where there is none, it comes last."""
    text = ("true" if value else "false") if isinstance(value, bool) else str(value)
    prefix, _, local = name.rpartition(":")
    is_it = (F.col("kind") == "attribute") & (F.col("name") == local) & F.col("prefix").eqNullSafe(F.lit(prefix or None))
    e = _hit(xml.nodes.where("kind = 'element'"), targets).select(F.col("doc_id").alias("h_doc"), F.col("pre").alias("h_pre"))
    n = xml.nodes.join(e, (F.col("doc_id") == F.col("h_doc")) & (F.col("parent_pre") == F.col("h_pre")) & is_it, "left")
    n = n.withColumn("value", F.when(F.col("h_doc").isNotNull(), text).otherwise(F.col("value"))).select(*xml.nodes.columns)
    have = xml.nodes.where(is_it).select(F.col("doc_id").alias("a_doc"), F.col("parent_pre").alias("a_pre"))
    lack = _hit(xml.nodes.where("kind = 'element'"), targets).join(by_merge(have), (F.col("doc_id") == F.col("a_doc")) & (F.col("pre") == F.col("a_pre")), "left_anti")
    row = {"pre": F.lit((1 << 31) - 1), "last": F.lit((1 << 31) - 1), "level": F.col("level") + 1, "parent_pre": F.col("pre"), "child_ord": F.lit(999999), "elem_ord": F.lit(None).cast("int"), "kind": F.lit("attribute"), "name": F.lit(local), "prefix": F.lit(prefix or None).cast("string"), "value": F.lit(text)}
    return _with(xml, n.union(lack.select(*[row.get(c, F.col(c)).alias(c) for c in xml.nodes.columns])))


def remove_attribute(xml: Shredded, targets: DataFrame, name: str | None = None) -> Shredded:
    """Without that attribute of the targets, or without any."""
    mine = xml.nodes.where("kind = 'attribute'" + ("" if name is None else f" AND concat_ws(':', prefix, name) = '{name}'"))
    return remove(xml, _hit(mine, targets, "parent_pre").select("doc_id", "pre"))


def insert(xml: Shredded, targets: DataFrame, where: str, fragment: str | Column) -> Shredded:
    """``fragment`` (XML text, or a column of the targets) before, after, or as first ("prepend") or last ("append") content of each target."""
    text = (F.lit(fragment) if isinstance(fragment, str) else fragment).alias("s")
    t = targets.select(F.col("doc_id").alias("t_doc"), F.col("pre").alias("t_pre"), text)
    j = xml.nodes.join(t, (F.col("doc_id") == F.col("t_doc")) & (F.col("pre") == F.col("t_pre")))
    level = F.col("level").cast("double")
    at, side, depth, own = {
        "before": (F.col("pre"), 0, F.lit(-1.0), F.lit(None)),
        "prepend": (F.col("pre"), 0, level + 0.5, F.col("pre")),
        "append": (F.col("last"), 1, -level - 0.5, F.col("pre")),
        "after": (F.col("last"), 1, -level + 0.5, F.lit(None)),
    }[where]
    return _with(xml, extra=j.select("doc_id", at.alias("at"), F.lit(side).alias("side"), depth.alias("depth"), own.cast("int").alias("own"), "s"))


def set_text(xml: Shredded, targets: DataFrame, text: str) -> Shredded:
    """All content replaced by text."""
    done = remove_children(xml, targets)
    # numbers change below the targets only where content went; find them again by their place among elements
    return insert(done, _again(xml, done, targets), "append", escape_text(F.lit(text)))


def _again(before: Shredded, after: Shredded, targets: DataFrame) -> DataFrame:
    """Targets in an edited collection that lost only what was inside of targets: by rank among elements outside of targets' content."""
    spans = _spans(before, targets)
    kept = _without(before.nodes.where("kind = 'element'"), spans, own=False).select("doc_id", "pre")
    rank = lambda df: df.selectExpr("doc_id AS r_doc", "pre AS r_pre", "row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS r")
    old = _hit(rank(kept).withColumnsRenamed({"r_doc": "doc_id", "r_pre": "pre"}), targets)
    new = rank(after.nodes.where("kind = 'element'").select("doc_id", "pre")).withColumnRenamed("r", "r2")
    return old.join(by_merge(new), (F.col("doc_id") == F.col("r_doc")) & (F.col("r") == F.col("r2"))).select("doc_id", F.col("r_pre").alias("pre"))


def copy(xml: Shredded, sources: DataFrame, targets: DataFrame, where: str = "append") -> Shredded:
    """Deep copies of ``sources`` (doc_id, pre: one per document) at the targets of the same document."""
    text = serialize(xml, sources).select(F.col("doc_id").alias("f_doc"), F.col("xml").alias("f_xml"))
    t = targets.join(by_merge(text), F.col("doc_id") == F.col("f_doc")).select("doc_id", "pre", "f_xml")
    return insert(xml, t, where, F.col("f_xml"))


def define_namespace(xml: Shredded, targets: DataFrame, prefix: str, uri: str) -> Shredded:
    e = _hit(xml.nodes.where("kind = 'element'"), targets)
    new = e.select("doc_id", F.col("pre").alias("owner_pre"), F.col("last").alias("owner_last"), F.lit(prefix).alias("prefix"), F.lit(uri).alias("uri"))
    rest = _hit(xml.ns_decls.where(F.col("prefix") == prefix), targets, "owner_pre", "left_anti").unionByName(xml.ns_decls.where(F.col("prefix") != prefix))
    return _with(xml, ns_decls=rest.unionByName(new))


def remove_namespace(xml: Shredded, targets: DataFrame, prefix: str) -> Shredded:
    rest = _hit(xml.ns_decls.where(F.col("prefix") == prefix), targets, "owner_pre", "left_anti")
    return _with(xml, ns_decls=rest.unionByName(xml.ns_decls.where(F.col("prefix") != prefix)))
