"""XML collections made from relational tables, so that every query over them has a relational twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xylem.functions.values import escape_attribute, escape_text
from xylem.session import Workspace
from xylem.sources.shred import Shredded, held, shred

_HELD: dict[tuple, tuple[Workspace, Shredded]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tag(name: str, content: Column | str = "", **attributes: Column) -> Column:
    """<name a="..">content</name>; content is markup already."""
    parts = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        parts += [F.lit(f' {k.replace("__", ":")}="'), escape_attribute(v.cast("string")), F.lit('"')]
    return F.concat(*parts, F.lit(">"), F.lit(content) if isinstance(content, str) else content, F.lit(f"</{name}>"))


def joined(order: list, markup: Column) -> Column:
    """Markup of a group's rows in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, markup.alias("m")))), lambda x: x["m"]), "")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One <order> with its <item>s per order that has any."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    i = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))
    item = tag("item", F.concat(tag("qty", F.col("l_quantity").cast("long").cast("string")), tag("cents", cents("l_extendedprice").cast("string"))), n=F.col("n"), line=F.col("l_linenumber"), flag=F.col("l_returnflag"), status=F.col("l_linestatus"))
    items = i.groupBy("l_orderkey").agg(joined(["n"], item).alias("items"))
    o = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("doc_id"), tag("order", F.col("items"), id=F.col("o_orderkey"), status=F.col("o_orderstatus")).alias("xml"))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document: <world> of <region>s of <nation>s, in a namespace."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(joined(["n_nationkey"], tag("nation", escape_text(F.col("n_name")), id=F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))).alias("nations"))
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    one = r.agg(joined(["r_regionkey"], tag("g:region", F.col("nations"), id=F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), xml__lang=F.when(F.col("r_regionkey") % 2 == 0, "en-GB").otherwise("fr"))).alias("regions"))
    return one.select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit('<world xmlns="urn:world" xmlns:g="urn:geo">'), "regions", F.lit("</world>")).alias("xml"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small document per part, with spare white space around the name."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("doc_id"), tag("part", F.concat(tag("name", F.concat(F.lit("  "), F.replace(escape_text(F.col("p_name")), F.lit(" "), F.lit("  ")), F.lit(" "))), tag("brand", escape_text(F.col("p_brand"))), tag("size", F.col("p_size").cast("string")), tag("cents", cents("p_retailprice").cast("string"))), id=F.col("p_partkey")).alias("xml"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One <customers> per nation."""
    c = table(spark, sf_dir, "customer")
    one = tag("c", F.concat(tag("name", escape_text(F.col("c_name"))), tag("bal", cents("c_acctbal").cast("string"))), id=F.concat(F.lit("c"), F.col("c_custkey").cast("string")), seg=F.col("c_mktsegment"))
    return c.groupBy("c_nationkey").agg(joined(["c_custkey"], one).alias("m")).select(F.col("c_nationkey").cast("long").alias("doc_id"), tag("customers", F.col("m")).alias("xml"))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One <doc> per text, escaped."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tag("doc", tag("p", escape_text(F.coalesce("text", F.lit("")))), xml__lang=F.coalesce("lang", F.lit(""))).alias("xml"))


def customers_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One <customers> per nation, a namespace declared on every <c>."""
    c = table(spark, sf_dir, "customer")
    one = tag("c", "", xmlns__s=F.lit("urn:s"), seg=F.col("c_mktsegment"))
    return c.groupBy("c_nationkey").agg(joined(["c_custkey"], one).alias("m")).select(F.col("c_nationkey").cast("long").alias("doc_id"), tag("customers", F.col("m")).alias("xml"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per part with every kind of node: mark, declaration, document type with entities, instructions, comments, namespaces, CDATA."""
    p = table(spark, sf_dir, "part")
    size, end = F.col("p_size").cast("string"), F.lit("\r\n")
    pieces = [
        F.when(F.col("p_size") % 3 == 0, "\ufeff").otherwise(""), F.lit('<?xml version="1.0" encoding="UTF-8" standalone="'), F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no"), F.lit('"?>'), end,
        F.lit('<!DOCTYPE note PUBLIC "-//N//'), size, F.lit('" "note.dtd" [<!ENTITY brand "'), F.col("p_brand"), F.lit('"><!ENTITY twice "&brand;&amp;&brand;">]>'), end,
        F.lit("<!-- out --><?out "), F.col("p_name"), F.lit(" x?>"), end, F.lit("<k:note"), F.expr("repeat('\\r\\n', p_size % 4)"), F.lit(' xmlns="urn:n" xmlns:k="urn:k" id="n'), F.col("p_partkey").cast("string"), F.lit('" k:size="'), size, F.lit('"><?size '), size,
        F.lit("?><!--"), F.col("p_name"), F.lit('--><k:brand>&brand;</k:brand><div and="1"><mod>'), size, F.lit("</mod></div>line one"), end, F.lit("line two<![CDATA[<"), F.col("p_type"), F.lit(">]]><or>&twice;</or></k:note>"), end, F.lit("<!-- after -->"),
    ]
    return p.select(F.col("p_partkey").alias("doc_id"), F.concat(*pieces).alias("xml"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages: none is well-formed XML."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml"))


CORPORA = {f.__name__: f for f in (orders, geography, parts, customers, customers_spaced, notes, prose, pages)}


def shredded(spark: SparkSession, sf_dir: str, corpus: str) -> Shredded:
    """A corpus's tables, made and written once per session and folder: the collection at rest that queries run over."""
    key = (spark.sparkContext.applicationId, sf_dir, corpus)
    if key not in _HELD or _HELD[key][0].released:
        work = Workspace(spark, corpus)
        _HELD[key] = work, held(shred(CORPORA[corpus](spark, sf_dir)), work)
    return _HELD[key][1]
