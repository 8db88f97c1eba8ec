"""Document type definitions: declarations read on the driver (they are small), validation as joins over node tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.sources.shred import Shredded

_NAME = r"[^\s<>/!?=\"'&()|,*+%;\[\]]+"
_QUOTED = r"(?:\"[^\"]*\"|'[^']*')"
#: Depth to which entities are expanded within entities, and parameter entities; characters of an expanded entity.
MOST_NESTED, MOST_PARAMETERS, MOST_EXPANDED = 10, 16, 1 << 20


@dataclass
class Entity:
    value: str | None = None
    system: str | None = None
    public: str | None = None
    notation: str | None = None


@dataclass
class Attribute:
    element: str
    name: str
    type: str
    values: tuple[str, ...] = ()
    default: str = "#IMPLIED"
    value: str | None = None


@dataclass
class Dtd:
    """Declarations; of repeated ones the first counts."""

    entities: dict[str, Entity] = field(default_factory=dict)
    parameters: dict[str, str] = field(default_factory=dict)
    elements: dict[str, str] = field(default_factory=dict)
    attributes: dict[tuple[str, str], Attribute] = field(default_factory=dict)
    notations: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)

    def expanded(self) -> dict[str, str | None]:
        """Internal general entities with all they refer to; None for those that go in circles or grow past MOST_EXPANDED. Past MOST_NESTED levels, references stay."""
        return {name: self._expand(e.value, (name,)) for name, e in self.entities.items() if e.value is not None}

    def _expand(self, text: str, path: tuple) -> str | None:
        out, at = [], 0
        for m in re.finditer(rf"&({_NAME});", text):
            e = self.entities.get(m[1])
            if m[1] in path:
                return None
            inner = m[0] if e is None or e.value is None or m[1] in _PREDEFINED else e.value if len(path) >= MOST_NESTED else self._expand(e.value, (*path, m[1]))
            if inner is None:
                return None
            out += [text[at : m.start()], inner]
            at = m.end()
            if sum(map(len, out)) > MOST_EXPANDED:
                return None
        return "".join([*out, text[at:]])


_PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def internal_entities(doctype: str) -> dict[str, str | None]:
    """Name to replacement text, all references resolved, of the general entities in the internal subset of ``<!DOCTYPE ...>``; None for those in circles."""
    m = re.search(r"\[(.*)\]\s*>$", doctype, re.DOTALL)

    def plain(ref):
        if ref[3]:
            return _PREDEFINED[ref[3]]
        cp = int(ref[1], 16) if ref[1] else int(ref[2])
        return chr(cp) if 0 < cp < 0x110000 and not 0xD800 <= cp <= 0xDFFF else ref[0]

    found = parse_dtd(m[1]).expanded() if m else {}
    return {k: v and re.sub(r"&(?:#x([0-9a-fA-F]+);|#([0-9]+);|(lt|gt|amp|quot|apos);)", plain, v) for k, v in found.items()}


def _unquote(s: str) -> str:
    return s[1:-1]


def parse_dtd(text: str, loader: Callable[[str], str | None] | None = None, external: str | None = None) -> Dtd:
    """Read the internal subset ``text`` and then ``external``; ``loader`` gives the text of external parameter entities."""
    dtd = Dtd()
    for part in (text, external):
        if part:
            _read(part, dtd, loader, 0)
    return dtd


def _references(text: str, dtd: Dtd, depth: int = 0) -> str:
    if depth > MOST_PARAMETERS:
        return text
    return re.sub(rf"%({_NAME});", lambda m: f" {_references(dtd.parameters[m[1]], dtd, depth + 1)} " if m[1] in dtd.parameters else m[0], text)


def _read(text: str, dtd: Dtd, loader, depth: int) -> None:
    at = 0
    while at < len(text):
        if text.startswith("<!--", at):
            at = _after(text, "-->", at + 4)
        elif text.startswith("<?", at):
            at = _after(text, "?>", at + 2)
        elif m := re.compile(r"<!\[\s*([^\[\s]+)\s*\[").match(text, at):
            end = _section(text, m.end())
            if _references(m[1], dtd).strip() == "INCLUDE":
                _read(text[m.end() : end], dtd, loader, depth)
            at = end + 3
        elif m := re.compile(rf"<!(?:[^<>\"']|{_QUOTED})*>").match(text, at):
            _declare(m[0], dtd, loader)
            at = m.end()
        elif m := re.compile(rf"%({_NAME});").match(text, at):
            if depth < MOST_PARAMETERS and m[1] in dtd.parameters:
                _read(dtd.parameters[m[1]], dtd, loader, depth + 1)
            at = m.end()
        else:
            at += 1


def _after(text: str, what: str, at: int) -> int:
    end = text.find(what, at)
    return len(text) if end < 0 else end + len(what)


def _section(text: str, at: int) -> int:
    depth = 1
    for m in re.compile(r"<!\[|\]\]>").finditer(text, at):
        depth += 1 if m[0] == "<![" else -1
        if not depth:
            return m.start()
    return len(text)


def _declare(d: str, dtd: Dtd, loader) -> None:
    if m := re.match(rf"<!ENTITY\s+(%\s+)?({_NAME})\s+(?:({_QUOTED})|(?:SYSTEM|PUBLIC\s+({_QUOTED}))\s+({_QUOTED})(?:\s+NDATA\s+({_NAME}))?)\s*>", d):
        percent, name, value, public, system, notation = m.groups()
        if percent:
            text = _unquote(value) if value else (loader(_unquote(system)) if loader else None)
            if text is not None:
                dtd.parameters.setdefault(name, text)
        else:
            own = re.sub(r"&#(?:x([0-9a-fA-F]+)|(\d+));", lambda c: chr(int(c[1], 16) if c[1] else int(c[2])), _references(_unquote(value), dtd)) if value else None
            dtd.entities.setdefault(name, Entity(own, system and _unquote(system), public and _unquote(public), notation))
        return
    head = d.split(None, 1)[0]
    d = re.sub(rf"{_QUOTED}|[^\"']+", lambda m: m[0] if m[0][0] in "\"'" else _references(m[0], dtd), d)
    if head == "<!ELEMENT" and (m := re.match(rf"<!ELEMENT\s+({_NAME})\s+(.*?)\s*>$", d, re.S)):
        dtd.elements.setdefault(m[1], re.sub(r"\s+", "", m[2]))
    elif head == "<!NOTATION" and (m := re.match(rf"<!NOTATION\s+({_NAME})\s+(?:SYSTEM\s+({_QUOTED})|PUBLIC\s+({_QUOTED})(?:\s+({_QUOTED}))?)\s*>", d)):
        dtd.notations.setdefault(m[1], (m[3] and _unquote(m[3]), _unquote(m[2] or m[4]) if m[2] or m[4] else None))
    elif head == "<!ATTLIST" and (m := re.match(rf"<!ATTLIST\s+({_NAME})\s*(.*?)\s*>$", d, re.S)):
        one = rf"({_NAME})\s+(CDATA|ID|IDREFS?|ENTITY|ENTITIES|NMTOKENS?|(?:NOTATION\s*)?\([^)]*\))\s+(#REQUIRED|#IMPLIED|(?:#FIXED\s+)?{_QUOTED})"
        for a in re.finditer(one, m[2]):
            kind, values = a[2], ()
            if "(" in kind:
                values = tuple(x.strip() for x in kind[kind.index("(") + 1 : -1].split("|"))
                kind = "NOTATION" if kind.startswith("NOTATION") else "ENUMERATION"
            fixed = a[3].startswith("#FIXED")
            value = _unquote(a[3].split(None, 1)[1] if fixed else a[3]) if a[3][-1] in "\"'" else None
            default = "#FIXED" if fixed else a[3] if a[3].startswith("#") else "DEFAULT"
            dtd.attributes.setdefault((m[1], a[1]), Attribute(m[1], a[1], kind, values, default, value))


def content_regex(model: str) -> str | None:
    """A Java regular expression over child names, each followed by a comma; None where any content goes."""
    if model == "ANY":
        return None
    if model == "EMPTY":
        return "^$"
    if "#PCDATA" in model:
        names = [n for n in re.findall(_NAME, model) if n != "#PCDATA"]
        return "^(?:" + "|".join(f"\\Q{n}\\E," for n in names) + ")*$" if names else "^$"
    return "^" + re.sub(rf"({_NAME})|,|\(", lambda m: f"(?:\\Q{m[1]}\\E,)" if m[1] else "(?:" if m[0] == "(" else "", model) + "$"


def validate(xml: Shredded, dtd: Dtd) -> DataFrame:
    """All violations as (doc_id, pre, rule, message). Undeclared elements are accepted.

    Declarations are literals and broadcast tables of the schema's own size; nodes meet only nodes of their document.
    """
    spark = SparkSession.active()
    nodes = xml.nodes
    e = nodes.where("kind = 'element'").select("doc_id", "pre", "name", "prefix", F.concat_ws(":", "prefix", "name").alias("q"))
    a = nodes.where("kind = 'attribute'").select(F.col("doc_id").alias("a_doc"), F.col("parent_pre").alias("own"), F.concat_ws(":", "prefix", "name").alias("a_name"), "value")
    found = []

    def report(df: DataFrame, rule: str, message) -> None:
        found.append(df.select("doc_id", "pre", F.lit(rule).alias("rule"), message.alias("message")))

    models = [(n, m, content_regex(m), m != "ANY" and "#PCDATA" not in m) for n, m in dtd.elements.items()]
    if models:
        declared = F.broadcast(spark.createDataFrame(models, "m_name string, model string, pattern string, no_text boolean"))
        kids = nodes.where("kind = 'element'").groupBy(F.col("doc_id").alias("c_doc"), F.col("parent_pre").alias("c_pre")).agg(F.array_sort(F.collect_list(F.struct("pre", F.concat_ws(":", "prefix", "name").alias("n")))).alias("kids"))
        text = nodes.where(r"kind = 'cdata' OR kind = 'text' AND value RLIKE '[^ \t\n\r]'").select(F.col("doc_id").alias("x_doc"), F.col("parent_pre").alias("x_pre")).distinct().withColumn("texts", F.lit(True))
        j = e.join(declared, F.col("q") == F.col("m_name")).join(kids, (F.col("doc_id") == F.col("c_doc")) & (F.col("pre") == F.col("c_pre")), "left").join(text, (F.col("doc_id") == F.col("x_doc")) & (F.col("pre") == F.col("x_pre")), "left")
        names = F.concat(F.array_join(F.transform(F.coalesce("kids", F.array().cast("array<struct<pre:int,n:string>>")), lambda x: F.concat(x["n"], F.lit(","))), ""))
        wrong = (F.col("pattern").isNotNull() & ~F.rlike(names, F.col("pattern"))) | (F.col("no_text") & F.coalesce("texts", F.lit(False)))
        report(j.where(wrong), "content", F.concat(F.lit("content of "), "q", F.lit(" does not match "), "model"))
    atts = [(x.element, x.name, x.type, list(x.values), x.default, x.value) for x in dtd.attributes.values()]
    if atts:
        declared = F.broadcast(spark.createDataFrame(atts, "d_element string, d_name string, type string, choices array<string>, default string, fixed string"))
        j = e.join(declared, F.col("q") == F.col("d_element")).join(a, (F.col("doc_id") == F.col("a_doc")) & (F.col("pre") == F.col("own")) & (F.col("a_name") == F.col("d_name")), "left")
        at = F.concat(F.lit("attribute "), "d_name", F.lit(" of "), "q")
        report(j.where("default = '#REQUIRED' AND value IS NULL"), "required", F.concat(at, F.lit(" is missing")))
        report(j.where("default = '#FIXED' AND value <> fixed"), "fixed", F.concat(at, F.lit(" differs from "), "fixed"))
        report(j.where(r"type = 'NMTOKEN' AND NOT trim(value) RLIKE '^[^\\s<>&\"\'/=!?()|,;]+$'"), "nmtoken", F.concat(at, F.lit(" is not a name token")))
        report(j.where(r"type = 'NMTOKENS' AND NOT trim(value) RLIKE '^[^\\s<>&\"\'/=!?()|,;]+(\\s+[^\\s<>&\"\'/=!?()|,;]+)*$'"), "nmtoken", F.concat(at, F.lit(" is not name tokens")))
        report(j.where("type IN ('ENUMERATION', 'NOTATION') AND NOT array_contains(choices, trim(value))"), "enumeration", F.concat(at, F.lit(" is none of the choices")))
        report(j.where("type = 'NOTATION'").where(~F.trim("value").isin(*(dtd.notations or [""]))), "notation", F.concat(at, F.lit(" names no declared notation")))
        ids = j.where("type = 'ID' AND value IS NOT NULL").select("doc_id", "pre", "q", "d_name", F.trim("value").alias("id"))
        again = ids.groupBy(F.col("doc_id").alias("i_doc"), F.col("id").alias("i_id")).agg(F.count(F.lit(1)).alias("n"), F.min("pre").alias("i_pre")).where("n > 1")
        report(ids.join(again, (F.col("doc_id") == F.col("i_doc")) & (F.col("id") == F.col("i_id")) & (F.col("pre") > F.col("i_pre"))), "id", F.concat(F.lit("the ID "), "id", F.lit(" repeats")))
        refs = j.where("type IN ('IDREF', 'IDREFS') AND value IS NOT NULL").select("doc_id", "pre", F.explode(F.split(F.trim("value"), r"\s+")).alias("ref"))
        have = ids.select(F.col("doc_id").alias("i_doc"), F.col("id").alias("i_id"))
        report(refs.join(have, (F.col("doc_id") == F.col("i_doc")) & (F.col("ref") == F.col("i_id")), "left_anti"), "idref", F.concat(F.lit("no ID "), "ref"))
        unparsed = [n for n, x in dtd.entities.items() if x.notation and x.notation in dtd.notations]
        ents = j.where("type IN ('ENTITY', 'ENTITIES') AND value IS NOT NULL").select("doc_id", "pre", F.explode(F.split(F.trim("value"), r"\s+")).alias("ent"))
        report(ents.where(~F.col("ent").isin(*(unparsed or [""]))), "entity", F.concat("ent", F.lit(" is no unparsed entity with a declared notation")))
    if not found:
        return spark.createDataFrame([], "doc_id long, pre int, rule string, message string")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def is_valid(xml: Shredded, dtd: Dtd) -> DataFrame:
    """(doc_id, valid, pre, message): the first violation of each well-formed document, if any."""
    first = validate(xml, dtd).groupBy(F.col("doc_id").alias("v_doc")).agg(F.min(F.struct("pre", "message")).alias("v"))
    return xml.documents.where("status = 'OK'").join(first, F.col("doc_id") == F.col("v_doc"), "left").select("doc_id", F.col("v").isNull().alias("valid"), "v.pre", "v.message")
