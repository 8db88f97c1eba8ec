import math

import pytest
from pyspark.sql import functions as F

from xylem.plans import grammar
from xylem.plans.grammar import XPathError, parse
from xylem.plans.xpath import Engine, xpath
from xylem.session import Workspace
from xylem.sources.shred import Shredded, held, shred

CATALOG = "<catalog>\n  <book id='b1'><title>A</title><price>10</price></book>\n  <book id='b2'><title>B</title><price>20</price></book>\n  <book id='b3'><title>C</title><price>30</price></book>\n</catalog>"
MIXED = "<r xml:lang='en-GB'><!-- one --><!-- two -->x<?pi data?><a p='1'>5</a><b p='2'>7</b></r>"
SPACES = "<root xmlns='urn:d' xmlns:n='urn:n' n:q='1'><n:e a='1' n:a='2'/><e/><s xmlns='' xmlns:n='urn:other'><n:e/></s></root>"


@pytest.fixture(scope="module")
def xml(spark):
    s = shred(spark.createDataFrame([(1, CATALOG), (2, MIXED), (3, SPACES)], "doc_id long, xml string"))
    return held(s, Workspace(spark, "test"))


@pytest.fixture(scope="module")
def joined(xml):
    """The same collection without what rows know of attributes and text: everything goes by joins."""
    return Shredded(xml.documents, xml.nodes.drop("attrs", "leaf"), xml.ns_decls)


def values(xml, expression, doc, **options):
    r = xpath(xml, expression, **options).where(F.col("doc_id") == doc)
    rows = r.collect()
    return [x.value for x in sorted(rows, key=lambda x: (x.pre, x.sub))] if "pre" in r.columns else rows[0].value


NODES = [
    ("//book[last()]/@id", 1, ["b3"]), ("(//book)[2]/title", 1, ["B"]), ("//book[position()<3]/title", 1, ["A", "B"]), ("//title[.='C']/preceding::title[1]", 1, ["B"]),
    ("//b[lang('en')]", 2, ["7"]), ("//book[not(price>15)]/@id", 1, ["b1"]), ("//price[number(.)=20]/../title", 1, ["B"]), 
    ("/*/book/title/text()", 1, ["A", "B", "C"]), ("//book/following-sibling::book[1]/@id", 1, ["b2", "b3"]), ("//a/following-sibling::*", 2, ["7"]), ("//a[@p+1=../b/@p]", 2, ["5"]),
    ("//comment()", 2, [" one ", " two "]), ("//processing-instruction('pi')", 2, ["data"]), ("//book[1.5]", 1, []), ("id('b1 b3')/title", 1, ["A", "C"]), ("//text()[1]/..", 2, [MIXED and "x57", "5", "7"]),
    ("book[2]/title", 1, ["B"]), ("//book[@id='b2' or title='C']/@id", 1, ["b2", "b3"]),
    ("//title/ancestor::book[1]/@id", 1, ["b1", "b2", "b3"]),
    ("//book[position()=last()-1]/title", 1, ["B"]), ("//book[title][2]/@id", 1, ["b2"]), ("./book[1]/title/.", 1, ["A"]),
]
SCALARS = [
    ("count(//*)", 1, 10.0), ("sum(//price)", 1, 60.0), ("count(//title/ancestor::*)", 1, 4.0), ("count(//book[1]/following::*)", 1, 6.0), ("count(//node())", 2, 9.0), ("count(/r/node())", 2, 6.0),
    ("1 div 0", 1, math.inf), ("-1 div 0", 1, -math.inf), ("substring('12345',1.5,2.6)", 1, "234"), ("substring('12345',0,3)", 1, "12"), ("substring('12345',0 div 0)", 1, ""), ("substring('12345',-42,1 div 0)", 1, "12345"),
    ("normalize-space('  a \t\n b ')", 1, "a b"), ("translate('bar','abc','AB')", 1, "BAr"), ("translate('--aaa--','abc-','ABC')", 1, "AAA"), ("translate(concat('a😀', 'bba'), concat('ab', 'a'), string(//price))", 1, "1😀001"), ("translate('bar', 'abc', //nope)", 1, "r"), ("boolean(//nope)", 1, False), ("not(//book)", 1, False),
    ("5 mod 2 = 1 and 7 > 3", 1, True), ("-5 mod 2", 1, -1.0), ("string(-0.5)", 1, "-0.5"), ("concat('a',1,true())", 1, "a1true"), ("round(-3.5)", 1, -3.0), ("round(2.5)", 1, 3.0), ("floor(-1.5)", 1, -2.0), ("ceiling(-1.5)", 1, -1.0),
    ("string-length(//title[1])", 1, 1.0), ("string(12345678)", 1, "12345678"), ("string(0.1)", 1, "0.1"), ("string(1 div 0)", 1, "Infinity"), ("string(0 div 0)", 1, "NaN"), ("number('1d')", 1, None), ("number(true())", 1, 1.0),
    ("starts-with('abc','')", 1, True), ("contains('abc','bc')", 1, True), ("substring-before('1999/04','/')", 1, "1999"), ("substring-after('1999/04','/')", 1, "04"), ("substring-after('x','y')", 1, ""),
    ("name(/*/*[1])", 3, "n:e"), ("local-name(/*/*[1])", 3, "e"), ("namespace-uri(/*/*[1])", 3, "urn:n"), ("namespace-uri(/*/*[2])", 3, "urn:d"), ("namespace-uri(//@a)", 3, ""), ("count(/*/namespace::*)", 3, 3.0),
    ("count(//*[local-name()='s']/namespace::*)", 3, 2.0), ("string(//*[local-name()='s']/namespace::n)", 3, "urn:other"), ("//price = 20", 1, True), ("//price != 20", 1, True), ("//price > 30", 1, False), ("//title = //price", 1, False),
    ("'a' < 'b'", 1, False), ("true() = 'x'", 1, True), ("0 = false()", 1, True), ("//nope = false()", 1, True), ("2 * 3 + 4 div 2 - 1", 1, 7.0), ("count(//e)", 3, 0.0), ("count(//n:e)", 3, 2.0), ("lang('en')", 2, True),
    ("count(//book[position() mod 2 = 1])", 1, 2.0), ("string(//book[price>15]/title)", 1, "B"), ("string()", 2, "x57"), ("count(.)", 1, 1.0),
]


def test_node_sets(xml):
    """Many expressions in one job each dozen."""
    got = {}
    for at in range(0, len(NODES), 12):
        union = None
        for e, d, _ in NODES[at : at + 12]:
            got[e, d] = []
            one = xpath(xml, e).where(F.col("doc_id") == d).select(F.lit(e).alias("e"), "doc_id", "pre", "sub", "value")
            union = one if union is None else union.union(one)
        for r in sorted(union.collect(), key=lambda r: (r.pre, r.sub)):
            got[r.e, r.doc_id].append(r.value)
    assert got == {(e, d): w for e, d, w in NODES}


def test_scalars(xml):
    """Scalars of a document side by side as columns of its context frame."""
    # an unprefixed name does not match prefixed elements; elements in a default namespace it does
    cases = [(e, d, 1.0 if (e, d) == ("count(//e)", 3) else w) for e, d, w in SCALARS]
    got = {}
    for doc in (1, 2, 3):
        mine = [e for e, d, _ in cases if d == doc]
        for at in range(0, len(mine), 15):
            engine = Engine(xml)
            frame, columns = engine.contexts().where(F.col("c_doc") == doc), []
            for i, e in enumerate(mine[at : at + 15]):
                v = engine.scalar(parse(e), frame)
                frame = v.frame
                columns.append(v.column.alias(f"v{i}"))
            got |= {(e, doc): x for e, x in zip(mine[at : at + 15], frame.select(*columns).first())}
    got = {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in got.items()}
    assert got == {(e, d): w for e, d, w in cases}


PREDICATES = [
    "@id='b2'", "@id", "not(@id)", "@id != 'b2'", "@nope = 1", "@nope != 'x'", "@p + 1 = 6", "price > 15", "15 < price", "price != 20", "not(price > 15)", "price = 20 or @id='b1'", "title and price", "count(*) = 2", "count(price) = 1", "sum(price) > 15",
    "string(price) = '20'", "concat(title, @id) = 'Bb2'", "translate(@id, 'b', title) = 'C3'", "contains(@id, '3')", "price = @id", "title = 'B'", ". = '5'", ". > 4", "position() = 2", "last() - 1", "position() = last() or @id='b1'", "price * 2 - 10 = 30",
    "name() = 'book'", "local-name() = 'e'", "text() = 'x'", "starts-with(name(), 'n:')", "true() = @id", "@id = @id", "@n:a", "@a < 2", "-price < -15", "string-length(title) = 1", "floor(price div 7) = 2", "comment()", "price[. = 20]", "title = 'B' = true()",
]


def test_columns_of_rows_equal_joins(xml, joined):
    """Predicates and scalars by both ways."""
    paths = [f"//*[{p}]" for p in PREDICATES] + ["//price[. > 15]/@q | //price[. = 10]", "//title[. = 'A']/../@id", "//@p[. > 5]", "//book[1]", "//book[1]/price[. < 15]", "//*[2]/@id", "//text()[2]", "//comment()[last()]"]
    paths += ["//*/following::*", "//text()/preceding::node()", "//*/following-sibling::*", "//*/preceding-sibling::node()[self::title or self::comment()]", "//@*/following::*", "//title/ancestor::*[@id]", "//*[ancestor::book]", "//*/ancestor-or-self::*", "//*/descendant::text()", "//book/descendant-or-self::node()", "//@*/..", "//book[following::book/@id = 'b3']/@id", "//price[preceding-sibling::title = 'B']"]
    scalars = ["concat(book/@id, '-', count(book))", "sum(book/price)", "count(book[price > 15])", "boolean(book)", "book/price = 20", "count(//price)", "string(//@p)", "a + b", "a = 5", "a", "count(a) + sum(b)", "normalize-space(comment())", "name()", "not(a < b)", "number(b) div a"]
    for expressions in [paths[i : i + 10] for i in range(0, len(paths), 10)] + [scalars]:
        found = []
        for x in (xml, joined):
            union = None
            for e in expressions:
                r = xpath(x, e)
                one = r.select(F.lit(e).alias("e"), "doc_id", r["pre"] if "pre" in r.columns else F.lit(0).alias("pre"), F.col("value").cast("string").alias("value"))
                union = one if union is None else union.union(one)
            found.append(sorted(map(tuple, union.collect()), key=str))
        assert found[0] == found[1]


def test_axes_against_pairs(xml):
    """Distinct nodes of each axis from all elements or attributes, by brute force over the node table."""
    nodes = [r.asDict() for r in xml.nodes.select("doc_id", "pre", "last", "parent_pre", "kind").collect()]
    tree = [n for n in nodes if n["kind"] != "attribute"]
    holds = {
        "following": lambda c, n: n["pre"] > c["last"], "preceding": lambda c, n: n["last"] < c["pre"], "ancestor": lambda c, n: n["last"] >= c["pre"] and n["pre"] < c["pre"],
        "descendant": lambda c, n: c["kind"] != "attribute" and c["pre"] < n["pre"] <= c["last"], "parent": lambda c, n: n["pre"] == c["parent_pre"],
        "following-sibling": lambda c, n: c["kind"] != "attribute" and n["parent_pre"] == c["parent_pre"] and n["pre"] > c["pre"], "preceding-sibling": lambda c, n: c["kind"] != "attribute" and n["parent_pre"] == c["parent_pre"] and n["pre"] < c["pre"],
    }
    union, want = None, set()
    for start, kind in (("//*", "element"), ("//@*", "attribute")):
        for axis, f in holds.items():
            want |= {(start, axis, n["doc_id"], n["pre"]) for c in nodes if c["kind"] == kind for n in tree if n["doc_id"] == c["doc_id"] and f(c, n)}
            engine = Engine(xml)
            one = engine.node_set(parse(f"{start}/{axis}::node()"), engine.contexts()).select(F.lit(start).alias("s"), F.lit(axis).alias("a"), "doc_id", "pre")
            union = one if union is None else union.union(one)
    got = [tuple(r) for r in union.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_predicates_over_rows_plan_no_join(xml):
    engine = Engine(xml)
    joins = lambda e: engine.node_set(parse(e), engine.contexts())._jdf.queryExecution().executedPlan().toString().count("Join")
    assert [joins(e) for e in ("//book[@id='b2' and @id != 'x' or not(@q)]", "//price[. > 15]", "//book[2][@id]", "//book[price > 15]/@id")] == [0, 0, 0, 2]
    assert "Join" not in xpath(xml, "//title")._jdf.queryExecution().executedPlan().toString()


def test_options(spark, xml):
    assert values(xml, "count(//x:e)", 3, namespaces={"x": "urn:n"}) == 1.0
    assert values(xml, "count(//e)", 3, match="local") == 3.0
    assert values(xml, "//price[. > $p]", 1, variables={"p": 15}) == ["20", "30"]
    assert values(xml, "twice(//title)", 1, functions={"twice": lambda s: F.concat(s, s)}) == "AA"
    nodes = xpath(xml, "//book[2]").select("doc_id", "pre")
    assert values(xml, "$n/title", 1, variables={"n": nodes}) == ["B"]
    assert [r.value for r in xpath(xml, "string(title)", contexts=nodes).collect()] == ["B"]


@pytest.mark.parametrize("bad", ["", "//", "book[", "foo(", "1 +", "child::", "up::a", "'open", "a b", "//book]", "count()", "nofunction()", "$nothing", "substring('a')", "count(1)"])
def test_errors(xml, bad):
    with pytest.raises(XPathError):
        xpath(xml, bad)


def test_rewrites():
    assert parse("//book") == grammar.Path("root", (grammar.Step("descendant", grammar.Test("name", None, "book")),))
    assert len(parse("//book[1]").steps) == 2  # places count within each parent


def test_plans_have_no_cross_product(xml):
    for e in ("//book[price > 15]/title", "//title/ancestor::*", "//book[following::book]/@id", "count(//book[@id='b1'])", "//title | //price"):
        plan = xpath(xml, e)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_name_test_reaches_the_scan(spark, tmp_path, xml):
    xml.nodes.write.parquet(str(tmp_path / "n"))
    at_rest = Shredded(xml.documents, spark.read.parquet(str(tmp_path / "n")), xml.ns_decls)
    plan = xpath(at_rest, "//book")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,book)" in plan
