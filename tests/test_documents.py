import pytest

from xylem.operators import dtd, edit, navigate, serialize, xinclude
from xylem.plans.xpath import xpath
from xylem.sources import encodings
from xylem.sources.shred import Shredded, shred, shred_fragments
from xylem.streaming import events


def make(spark, *docs, **options):
    return shred(spark.createDataFrame(list(enumerate(docs, 1)), "doc_id long, xml string"), **options)


def texts(x, **options):
    return [r.xml for r in serialize.serialize(x, **options).orderBy("doc_id").collect()]


def test_status(spark):
    docs = {
        "<a/>": None, "<a><b></a></b>": "a close tag that does not match", "<a><b>": "an element that is not closed", None: "no root element", "": "no root element", "<a/><b/>": "more than one root element",
        "<a/>t": "text outside the root", "<a x='1' x='2'/>": "an attribute that repeats", "<a b=c/>": "markup that is not well-formed", "</a>": "a close tag without an open one", "<p:a></q:a>": "a close tag that does not match",
        "<a>" * 300 + "</a>" * 300: "too deep", "<a b='<'/>": "markup that is not well-formed", "﻿<?xml version='1.0'?>\r\n<!-- c --><a/><?p q?>": None, "<!DOCTYPE a [<!ENTITY x ']>'>]><a/>": None,
        "<a " + " ".join(f"b{i}='>{i}'" for i in range(3000)) + "/>": None, "<a><!--" + "x" * 200_000 + "--></a>": None,
    }
    got = [(r.status, r.error) for r in make(spark, *docs).documents.orderBy("doc_id").collect()]
    assert got == [("OK" if w is None else "PARSE", w) for w in docs.values()]


def test_values(spark):
    x = make(spark, "<a b='x&#65;&lt;&nope;\n'>A &amp; B&#233;&#x1F600;&quot;<![CDATA[<&amp;]]>\r\n<?t  d?></a>")
    got = [(r.kind, r.name, r.value) for r in x.nodes.orderBy("pre").collect()]
    assert got == [("document", None, None), ("element", "a", None), ("attribute", "b", "xA<&nope; "), ("text", None, 'A & Bé\U0001f600"'), ("cdata", None, "<&amp;"), ("text", None, "\n"), ("pi", "t", " d")]
    assert make(spark, "<a>&nope;</a>", strict=True).documents.first().error == "an unknown entity"
    assert make(spark, "<a>&mine;</a>", entities={"mine": "M"}).nodes.where("kind = 'text'").first().value == "M"
    assert make(spark, "<a> <b> x </b> </a>", drop_space=True).nodes.where("kind = 'text'").count() == 1


def test_entities_of_the_internal_subset(spark):
    deep = "".join(f"<!ENTITY e{i} '{i}&e{i + 1};'>" for i in range(14)) + "<!ENTITY e14 'end'>"
    x = make(
        spark, "<!DOCTYPE a [<!ENTITY who \"W &amp; &#65;\"><!ENTITY twice '&who;&who;'><!-- <!ENTITY no 'x'> --><!ENTITY who 'second'>]><a n='&twice;' xmlns:p='urn:&who;'>&twice;&no;&lt;</a>",
        "<!DOCTYPE a [<!ENTITY x '&y;'><!ENTITY y '&x;'><!ENTITY z 'Z'>]><a><b>&z;</b><c>&z;&x;&lt;</c></a>", "<a>&who;</a>", f"<!DOCTYPE a [{deep}]><a>&e0;</a>",
    )
    got = {}
    for r in x.nodes.where("value IS NOT NULL").orderBy("doc_id", "pre").collect():
        got.setdefault(r.doc_id, []).append(r.value)
    w = "W & A"
    assert got == {1: [w * 2, w * 2 + "&no;<"], 2: ["Z", "&z;&x;<"], 3: ["&who;"], 4: ["0123456789" + "10&e11;"]}
    assert x.ns_decls.first().uri == "urn:" + w


def test_leaf_values_and_attribute_maps(spark):
    x = make(spark, "<a x='1' n:y='&lt;'><b/><c></c><d>t&amp;</d><e><![CDATA[<]]></e><f>1<!-- c -->2</f><g><h>i</h></g></a>", "<a> </a>")
    got = [(r.name, r.leaf, r.attrs) for r in x.nodes.where("kind = 'element'").orderBy("doc_id", "pre").collect()]
    assert got == [("a", None, {"x": "1", "n:y": "<"}), ("b", "", {}), ("c", "", {}), ("d", "t&", {}), ("e", "<", {}), ("f", None, {}), ("g", None, {}), ("h", "i", {}), ("a", " ", {})]
    assert make(spark, "<a> </a>", drop_space=True).nodes.where("kind = 'element'").first().leaf == ""


def test_metadata(spark):
    d = make(spark, "<?xml version='1.1' encoding=\"UTF-8\" standalone='yes'?><!DOCTYPE r PUBLIC 'p' \"s\" [<!ELEMENT r ANY>]><n:r xmlns:n='u'/>").documents.first()
    assert (d.version, d.encoding, d.standalone, d.had_decl, d.root_name) == ("1.1", "UTF-8", "yes", True, "r")
    assert tuple(d.doctype) == ("r", "p", "s", "<!ELEMENT r ANY>")


def test_fragments(spark):
    x = shred_fragments(spark.createDataFrame([(1, "<a/>t<b/>")], "doc_id long, xml string"))
    assert [(r.kind, r.name) for r in x.nodes.where("level = 2").orderBy("pre").collect()] == [("element", "a"), ("text", None), ("element", "b")]


def test_round_trip_of_random_trees(spark):
    import random

    rng = random.Random(4)

    def tree(depth):
        name = rng.choice("abc")
        attrs = "".join(f' {k}="{rng.randrange(9)}&amp;"' for k in rng.sample("xyz", rng.randrange(3)))
        inner = "".join(rng.choice([lambda: tree(depth - 1), lambda: "t&lt;", lambda: "<!--c-->", lambda: "<![CDATA[<]]>", lambda: "<?p d?>"])() for _ in range(rng.randrange(4))) if depth else ""
        return f"<{name}{attrs}>{inner}</{name}>" if inner else f"<{name}{attrs}/>"

    docs = [tree(5) for _ in range(40)]
    assert texts(make(spark, *docs)) == docs


def test_serialize_and_canonical(spark):
    x = make(spark, "<?xml version='1.0'?><?p a?><r b='2' a='1&amp;&#9;' xmlns:q='u' xmlns='d'><q:c q:z='1'/>t&gt;&#13;<!-- k --><![CDATA[<&]]><e xmlns='d'><f/></e></r><!-- end -->")
    assert serialize.canonical(x).first().xml == '<?p a?>\n<r xmlns="d" xmlns:q="u" a="1&amp;&#x9;" b="2"><q:c q:z="1"></q:c>t&gt;&#xD;&lt;&amp;<e><f></f></e></r>'
    assert serialize.canonical(x, exclusive=True).first().xml == '<?p a?>\n<r xmlns="d" a="1&amp;&#x9;" b="2"><q:c xmlns:q="u" q:z="1"></q:c>t&gt;&#xD;&lt;&amp;<e><f></f></e></r>'
    assert 'xmlns:q="u" a=' in serialize.canonical(x, exclusive=True, inclusive_prefixes=("q",)).first().xml
    assert texts(make(spark, "<a><b><c/></b><b>x</b></a>"), indent=2) == ["<a>\n  <b>\n    <c/>\n  </b>\n  <b>x</b>\n</a>"]
    assert serialize.to_json(make(spark, "<a k='v\"'><b>x</b><c/></a>")).first().json == '{"name":"a","attributes":{"k":"v\\""},"text":"","children":[{"name":"b","attributes":{},"text":"x","children":[]},{"name":"c","attributes":{},"text":"","children":[]}]}'


def test_navigation(spark):
    x = make(spark, "<a n='07' f='1e1' t='yes'><b/>t<c/><b>0x1F</b></a>")
    n = x.nodes.cache()
    path = {r.pre: r.path for r in navigate.node_paths(n).collect()}
    assert set(path.values()) >= {"/a", "/a/b[1]", "/a/c", "/a/b[2]", "/a/text()", "/a/b[2]/text()"}
    name = {r.pre: r.name for r in n.where("kind = 'element'").collect()}
    named = lambda df: {(name[r.pre], name.get(r.sibling_pre)) for r in df.where("pre > 1").collect()}
    assert named(navigate.sibling(n)) == {("b", "c"), ("c", "b"), ("b", None)}
    assert named(navigate.sibling(n, -1, "b")) == {("b", None), ("c", "b"), ("b", "b")}
    assert navigate.child_counts(n).where("pre = 1").first().n == 3 and navigate.attribute_counts(n).where("pre = 1").first().n == 3
    assert navigate.edge_child(n, last=True).first().child_pre == max(name)
    assert [navigate.attribute(n, k).where("pre = 1").first().value for k in ("n", "f", "t", "no")] == ["07", "1e1", "yes", None]
    got = spark.range(1).select(navigate.typed(navigate.F.lit("07"), "int"), navigate.typed(navigate.F.lit("1e1"), "double"), navigate.typed(navigate.F.lit("yes"), "bool"), navigate.typed(navigate.F.lit("7x"), "int", 3), navigate.typed_text(navigate.F.lit("0x1F"), "int"), navigate.typed_text(navigate.F.lit("any"), "bool")).first()
    assert tuple(got) == (7, 10.0, True, 3, 31, True)
    assert navigate.child_value(n).where("pre = 1").first().value is None
    assert [r.name for r in navigate.traverse(n, post=True).where("kind = 'element'").orderBy("visit").collect()] == ["b", "c", "b", "a"]


def test_edits(spark):
    x = make(spark, "<a><b x='1'><c/>t</b><b/></a>")
    x = Shredded(x.documents, x.nodes.cache(), x.ns_decls)
    b = xpath(x, "//b").select("doc_id", "pre")
    one = xpath(x, "//b[1]").select("doc_id", "pre")
    assert texts(edit.remove(x, one)) == ["<a><b/></a>"]
    assert texts(edit.remove_children(x, one)) == ['<a><b x="1"/><b/></a>']
    assert texts(edit.set_attribute(x, b, "x", True)) == ['<a><b x="true"><c/>t</b><b x="true"/></a>']
    assert texts(edit.rename(x, b, "q:n")) == ['<a><q:n x="1"><c/>t</q:n><q:n/></a>']
    assert texts(edit.set_text(x, b, "hi<")) == ['<a><b x="1">hi&lt;</b><b>hi&lt;</b></a>']
    assert texts(edit.insert(x, one, "before", "<n/>")) == ['<a><n/><b x="1"><c/>t</b><b/></a>']
    assert texts(edit.insert(x, b, "after", "<n/>")) == ['<a><b x="1"><c/>t</b><n/><b/><n/></a>']
    assert texts(edit.insert(x, b, "prepend", "<n/>")) == ['<a><b x="1"><n/><c/>t</b><b><n/></b></a>']
    assert texts(edit.insert(x, b, "append", "<n/>")) == ['<a><b x="1"><c/>t<n/></b><b><n/></b></a>']
    assert texts(edit.remove_attribute(x, b)) == ["<a><b><c/>t</b><b/></a>"]
    assert texts(edit.copy(x, one, xpath(x, "//b[2]").select("doc_id", "pre"))) == ['<a><b x="1"><c/>t</b><b><b x="1"><c/>t</b></b></a>']
    assert texts(edit.set_value(x, xpath(x, "//text()").select("doc_id", "pre"), "u&")) == ['<a><b x="1"><c/>u&amp;</b><b/></a>']
    assert edit.insert(x, one, "append", "<broken>").documents.first().status == "PARSE"


def test_dtd(spark):
    text = "<!ELEMENT a (b+,c?)><!ELEMENT b (#PCDATA)><!ELEMENT c EMPTY><!ATTLIST b id ID #REQUIRED r IDREF #IMPLIED k (x|y) 'x' f CDATA #FIXED 'v' t NMTOKEN #IMPLIED u ENTITY #IMPLIED><!NOTATION gif SYSTEM 'g'><!ENTITY pic SYSTEM 'p' NDATA gif><![IGNORE[<!ELEMENT a EMPTY>]]><![INCLUDE[<!ELEMENT d ANY>]]>"
    d = dtd.parse_dtd(text)
    x = make(spark, "<a><b id='1' r='1' u='pic'>x</b><c/></a>", "<a><c/><b k='z' f='w' t='a b'/><b id='1'/><b id='1' r='9' u='no'/></a>", "<a>t<b id='q'><c>x</c></b></a>", "<z/>", "<a/>")
    got = sorted((r.doc_id, r.rule) for r in dtd.validate(x, d).collect())
    assert got == [(2, "content"), (2, "entity"), (2, "enumeration"), (2, "fixed"), (2, "id"), (2, "idref"), (2, "nmtoken"), (2, "required"), (3, "content"), (3, "content"), (3, "content"), (5, "content")]
    assert [r.valid for r in dtd.is_valid(x, d).orderBy("doc_id").collect()] == [True, False, False, True, False]
    assert "d" in d.elements and d.elements["a"] == "(b+,c?)"


def test_dtd_entities():
    d = dtd.parse_dtd("<!ENTITY % p '<!ENTITY a \"A\">'> %p; <!ENTITY b 'x&a;y'><!ENTITY b 'second'><!ENTITY c1 '&c2;'><!ENTITY c2 '&c1;'><!ENTITY % m '(#PCDATA)'><!ELEMENT e %m;>", external="<!ENTITY z 'Z'>")
    assert d.expanded() == {"a": "A", "b": "xAy", "z": "Z", "c1": None, "c2": None} and d.elements == {"e": "(#PCDATA)"}
    assert dtd.parse_dtd("<!ENTITY % x SYSTEM 'u'> %x;", loader=lambda u: "<!ELEMENT l ANY>").elements == {"l": "ANY"}


def test_xinclude(spark):
    x = make(spark, "<root xmlns:xi='http://www.w3.org/2001/XInclude'><xi:include href='a.xml'/><xi:include href='d.xml' xpointer='element(/1/3)'/><xi:include href='t.txt' parse='text'/><xi:include href='no'><xi:fallback><f/>g</xi:fallback></xi:include></root>")
    resources = spark.createDataFrame([("a.xml", "<a xmlns:xi='http://www.w3.org/2001/XInclude'><xi:include href='b.xml'/></a>"), ("b.xml", "<b/>"), ("d.xml", "<d><i/><s id='t1'>1</s><s>2</s></d>"), ("t.txt", "x < y")], "uri string, xml string")
    got = texts(xinclude.resolve(x, resources))[0]
    assert got.endswith('<b/></a><s>2</s>x &lt; y<f/>g</root>')


def test_events_equal_streamed_events(spark):
    docs = ["<a b='1&amp;'>x&lt;<c xmlns:p='u'><p:d/></c><!-- k --><?p d?><![CDATA[z]]></a>", "<a><b></a></b>", "<a", "<?xml version='1.0'?><!DOCTYPE a [<!ENTITY x '>'><!-- it's ] > --><?p ' ?>]>\r\n<a>l\r\nm</a>"]
    docs += ["\ufeff<!----><?p  q\n?><a><!-- - -- --><![CDATA[]]]]><b   c='>'\r\n d=\"'\"/>&#65;&#x42;&unknown;&</a\r>\r<?q?>\n", "<a>1<b>2</b>3<!---></b>--></a>", "<a>" + "<b>&amp;</b>x" * 30 + "</a>"]
    batch = events.events(make(spark, *docs)).where("doc_id <> 2")
    want: dict = {}
    for r in batch.orderBy("doc_id", "seq").collect():
        want.setdefault(r.doc_id, []).append((r.event, r.name, r.text if r.event != "error" else None))
    for size in (1, 2, 3, 7, 100):
        for k, doc in enumerate(docs, 1):
            m, got = events.Machine(), []
            parts = [doc[i : i + size] for i in range(0, len(doc), size)]
            for i, part in enumerate(parts):
                m = events.Machine.of(m.state())
                for _, event, name, _, text, _, _ in m.feed(part, i == len(parts) - 1):
                    if event == "characters" and got and got[-1][0] == "characters":
                        got[-1] = (event, None, got[-1][2] + text)
                    else:
                        got.append((event, name, text if event != "error" else None))
            if k == 2:
                assert got[-1][0] == "error"
            else:
                assert got == want[k], (size, doc)


@pytest.mark.parametrize("doc, line, col", [("<a>\n <b></c>", 2, 5), ("x", 1, 1), ("<a/>\r\n\r\n <b/>", 3, 2), ("<a>\n<!-", 2, 1), ("<a><![CDATA[\n]]><?xml ?></a>", 2, 4), ("<a><!DOCTYPE b></a>", 1, 4), ("<!DOCTYPE a <b>><a/>", 1, 1), ("<a x='1' x='2'/>", 1, 1), ("</a>", 1, 1), ("<!x>", 1, 1)])
def test_errors_of_streams_have_a_place(doc, line, col):
    for size in (1, 3, 100):
        m, got = events.Machine(), []
        for i in range(0, len(doc), size):
            m = events.Machine.of(m.state())
            got += m.feed(doc[i : i + size], i + size >= len(doc))
        assert got[-1][1] == "error" and got[-1][5:] == (line, col) and sum(e[1] == "error" for e in got) == 1


def test_machine_takes_small_chunks_in_linear_time():
    import time

    def took(n):
        doc, m, t = "<a><!--" + "x" * n + "--><b c='" + "y" * n + "'/><![CDATA[" + "]" * n + "]]></a>", events.Machine(), time.perf_counter()
        found = [e for i, ch in enumerate(doc) for e in m.feed(ch, i == len(doc) - 1)]
        assert [len(e[4] or "") for e in found if e[1] in ("comment", "cdata")] == [n, n]
        return time.perf_counter() - t

    took(1000)
    assert took(40_000) < 20 * took(5000)


def test_streams_in_any_order_over_many_frames(spark):
    """A document of thousands of one-character chunks, dealt over files without order, with some that come twice."""
    doc = "<a>" + "".join(f"<b n='{i}'>t{i}</b>" for i in range(400)) + "</a>"
    docs = spark.createDataFrame([(1, doc), (2, "<x>&lt;</x>")], "doc_id long, xml string")
    chunks = events.chunked(docs, 1)
    some = chunks.where("chunk_no % 100 = 3")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = events.stream_all(spark, chunks.union(some).repartition(8)).orderBy("stream_id", "seq").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    mine = [r for r in got if r.stream_id == 1]
    assert [r.seq for r in mine] == list(range(1, len(mine) + 1))
    assert [r.event for r in mine].count("start_element") == 401 and mine[-1].event == "end_document"
    assert "".join(r.text for r in mine if r.event == "characters") == "".join(f"t{i}" for i in range(400))
    assert [r.text for r in got if r.stream_id == 2 and r.event == "characters"] == ["<"]


def test_chunks_wait_for_their_turn_and_abandoned_streams_end():
    import pandas as pd

    class State:
        exists = hasTimedOut = False
        waits = None

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):  # noqa: N802
            self.waits = ms

    def feed(state, *chunks):
        frame = pd.DataFrame(chunks, columns=["chunk_no", "data", "is_final"])
        return [e for f in events._handler(5000)((7,), [frame], state) for e in f.event]

    state = State()
    assert feed(state, (1, "b/>", False)) == [] and state.waits == 5000
    assert feed(state, (0, "<a><", False)) == ["start_document", "start_element", "start_element", "end_element"]
    state.hasTimedOut = True
    last = [f for f in events._handler(5000)((7,), [], state)][0]
    assert last.event.tolist() == ["error"] and last.seq.tolist() == [5] and not state.exists
    state = State()
    assert feed(state, (0, "<a/>", True))[-1] == "end_document" and feed(state, (1, "<b/>", True)) == []
    state.hasTimedOut = True
    assert [len(f) for f in events._handler(5000)((7,), [], state)] == [0] and not state.exists


def test_structured_streaming(spark):
    docs = spark.createDataFrame([(1, "<a><b>x</b></a>"), (2, "<a><b>")], "doc_id long, xml string")
    got = events.stream_all(spark, events.chunked(docs, 4)).groupBy("stream_id", "event").count().collect()
    assert {(r.stream_id, r.event): r["count"] for r in got if r.event != "characters"} == {(1, "start_document"): 1, (1, "start_element"): 2, (1, "end_element"): 2, (1, "end_document"): 1, (2, "start_document"): 1, (2, "start_element"): 2, (2, "error"): 1}


@pytest.mark.parametrize("codec", ["utf-8", "utf-16", "iso-8859-1", "cp037", "shift_jis"])
def test_encodings(spark, codec):
    text = "<?xml version='1.0' encoding='Shift_JIS'?><a>x</a>" if codec == "shift_jis" else "<a>xé</a>"
    docs = spark.createDataFrame([(1, text)], "doc_id long, xml string")
    assert encodings.decode(encodings.encode(docs, codec)).first().xml == text
    assert encodings.decode(spark.createDataFrame([(1, b"\xff\xff\xff")], "doc_id long, data binary"), "utf-8").first().xml is None


def test_table_function(spark):
    from xylem.functions import tables

    tables.register(spark)
    doc = "<a x='1'>t<!-- c -->u<b/><![CDATA[v]]><?p q?></a>"
    x = make(spark, doc).nodes.select("pre", "last", "level", "parent_pre", "kind", "name", "prefix", "value").orderBy("pre").collect()
    got = spark.sql("SELECT * FROM xml_nodes('" + doc.replace("'", "\\'") + "')").drop("error").orderBy("pre").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in x]
    assert spark.sql("SELECT kind, error FROM xml_nodes('<a>')").collect() == [("error", "the document ends too soon, line 1")]


def test_files(spark, tmp_path):
    from xylem.sources import files

    docs = spark.createDataFrame([(1, "<a>é</a>"), (2, None), (3, "<b>\n</b>")], "doc_id long, xml string")
    for encoding in ("UTF-8", "UTF-16"):
        files.save_xml(docs, str(tmp_path / encoding), encoding)
        got = files.load_xml(spark, str(tmp_path / encoding), encoding).collect()
        assert sorted((int(r.doc_id), r.xml) for r in got) == [(1, "<a>é</a>"), (2, ""), (3, "<b>\n</b>")]


def test_command_line_takes_the_environment(spark, tmp_path, monkeypatch, capsys):
    from xylem import cli

    (tmp_path / "d.xml").write_text("<a><b>1</b><b>2</b></a>")
    file = str(tmp_path / "d.xml")

    def run(*args):
        code = cli.main([*args])
        return code, capsys.readouterr().out.strip()

    assert run("xpath", file, "//b") == (0, "<b>1</b>\n<b>2</b>") and run("xpath", file, "//b", "-c") == (0, "2.0") and run("xpath", file, "b[") == (3, "")
    monkeypatch.setenv("XYLEM_COUNT", "Yes")
    monkeypatch.setenv("XYLEM_OUTPUT", "json")
    monkeypatch.setenv("XYLEM_INDENT", "1")
    assert run("xpath", file, "//b") == (0, "2.0") and run("parse", file)[1].startswith('{"name":"a"') and run("format", file, "--output", "xml") == (0, "<a>\n <b>1</b>\n <b>2</b>\n</a>")
    monkeypatch.setenv("XYLEM_OUTPUT", "pdf")
    with pytest.raises(SystemExit):
        run("parse", file)
