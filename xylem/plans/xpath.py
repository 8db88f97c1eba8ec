"""XPath 1.0 over node tables: syntax trees to DataFrame plans.

An axis is an equi-join on the document (and parent, where the axis allows) with an interval as residual; predicates are windows,
semi- and anti-joins or filters; comparisons of node-sets hold if any pair does. Every evaluation has a context frame: one
row per context with key ``k`` and node ``c_doc, c_pre, c_sub`` (and place ``c_pos`` of ``c_size`` within predicates).

What depends on a node alone needs no context frame: predicates and expressions over the node's own value, its attributes (a map on element
rows) and its children by name become columns of the node's row, the children's as aggregates per parent joined once. String-values of
elements that hold nothing but text are in their rows (``leaf``); others are joined from the text below them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.functions import values as V
from xylem.plans import grammar as G
from xylem.plans.grammar import XPathError
from xylem.sources.shred import Shredded, by_merge, with_namespaces

REVERSE = ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling")
NODE = ["doc_id", "pre", "sub", "last", "level", "parent_pre", "kind", "name", "prefix", "value"]
XML_URI = "http://www.w3.org/XML/1998/namespace"

_ARITY = {
    "last": (0, 0), "position": (0, 0), "count": (1, 1), "id": (1, 1), "local-name": (0, 1), "namespace-uri": (0, 1), "name": (0, 1), "string": (0, 1),
    "concat": (2, 99), "starts-with": (2, 2), "contains": (2, 2), "substring-before": (2, 2), "substring-after": (2, 2), "substring": (2, 3),
    "string-length": (0, 1), "normalize-space": (0, 1), "translate": (3, 3), "boolean": (1, 1), "not": (1, 1), "true": (0, 0), "false": (0, 0),
    "lang": (1, 1), "number": (0, 1), "sum": (1, 1), "floor": (1, 1), "ceiling": (1, 1), "round": (1, 1),
}
_NUMBERS = {"last", "position", "count", "string-length", "number", "sum", "floor", "ceiling", "round"}
_BOOLEANS = {"starts-with", "contains", "boolean", "not", "true", "false", "lang"}


_ARITHMETIC = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "div": V.divide, "mod": V.modulo}
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def supported_functions() -> list[str]:
    return sorted(_ARITY)


@dataclass
class Cell:
    """An expression as a column of a node's row: number, string or boolean; node (a string, null where there is none); or kids (a step).

    ``fixed`` columns are the same in all rows.
    """

    type: str
    column: Column | None
    fixed: bool = False
    step: G.Step | None = None


@dataclass
class Value:
    """A scalar: its type (number, string, boolean), the context frame that it belongs to, and its column there."""

    type: str
    frame: DataFrame
    column: Column


def _base(frame: DataFrame) -> DataFrame:
    """The context frame without the results that have been joined to it: paths start from it, so that plans grow with the expression only."""
    return getattr(frame, "_contexts", frame)


class Engine:
    """Evaluates expressions over one collection.

    ``namespaces`` maps prefixes of expressions to URIs (without it, prefixes are compared as text); ``match="local"`` ignores prefixes;
    ``variables`` are Python values or DataFrames of nodes; ``functions`` map names to builders from string columns to a string column.
    """

    def __init__(self, xml: Shredded, variables: dict | None = None, functions: dict[str, Callable] | None = None, namespaces: dict[str, str] | None = None, match: str = "prefix"):
        self.xml, self.variables, self.functions, self.namespaces, self.match = xml, variables or {}, functions or {}, namespaces, match
        nodes = xml.nodes.withColumn("sub", F.lit(0))
        if namespaces is not None:
            nodes = with_namespaces(nodes, xml.ns_decls)
        self.extra = [c for c in ("ns_uri", "attrs", "leaf") if c in nodes.columns]
        self.columns = NODE + self.extra
        self.nodes = by_merge(nodes.select(*self.columns))
        self._n = 0

    def fresh(self, name: str) -> str:
        self._n += 1
        return f"{name}_{self._n}"

    # ---- entry points

    def contexts(self) -> DataFrame:
        """One context per document: its root element."""
        ctx = self._roots().select("k", F.col("doc_id").alias("c_doc"), F.col("pre").alias("c_pre"), F.col("sub").alias("c_sub"), F.lit(1).alias("c_pos"), F.lit(1).alias("c_size"))
        ctx._at = self._roots()
        ctx._documents = True
        return ctx

    def _roots(self) -> DataFrame:
        return self.nodes.where("parent_pre = 0 AND kind = 'element'").select(F.col("doc_id").alias("k"), *self.columns)

    def type_of(self, e) -> str:
        if isinstance(e, (G.Path, G.Filter)) or isinstance(e, G.Binary) and e.op == "|":
            return "nodes"
        if isinstance(e, (G.Number, G.Negate)):
            return "number"
        if isinstance(e, G.Literal):
            return "string"
        if isinstance(e, G.Binary):
            return "number" if e.op in ("+", "-", "*", "div", "mod") else "boolean"
        if isinstance(e, G.Variable):
            if e.name not in self.variables:
                raise XPathError(f"no variable ${e.name}")
            v = self.variables[e.name]
            return "nodes" if isinstance(v, DataFrame) else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
        if e.name in _ARITY:
            low, high = _ARITY[e.name]
            if not low <= len(e.args) <= high:
                raise XPathError(f"{e.name}() takes {low} to {high} arguments, not {len(e.args)}")
            return "nodes" if e.name == "id" else "number" if e.name in _NUMBERS else "boolean" if e.name in _BOOLEANS else "string"
        if e.name in self.functions:
            return "string"
        raise XPathError(f"no function {e.name}()")

    # ---- node-sets

    def node_set(self, e, ctx: DataFrame) -> DataFrame:
        """(k, NODE) of the nodes that ``e`` gives in each context, each once."""
        ctx = _base(ctx)
        top = getattr(ctx, "_documents", False)
        if isinstance(e, G.Binary) and e.op == "|":
            return self.node_set(e.left, ctx).unionByName(self.node_set(e.right, ctx)).dropDuplicates(["k", "doc_id", "pre", "sub"])
        if isinstance(e, G.Variable):
            v = self.variables[e.name].select("doc_id", "pre")
            picked = self.nodes.join(v.withColumnsRenamed({"doc_id": "v_doc", "pre": "v_pre"}), (F.col("doc_id") == F.col("v_doc")) & (F.col("pre") == F.col("v_pre")), "left_semi")
            return ctx.select("k", "c_doc").join(picked, F.col("c_doc") == F.col("doc_id")).select("k", *self.columns)
        if isinstance(e, G.Call) and e.name == "id":
            return self._ids(e.args[0], ctx)
        if isinstance(e, G.Filter):
            found = self.node_set(e.of, ctx)
            for p in e.predicates:
                found = self._predicate(found.withColumn("o", F.lit(0)), p, False, self.leafy(e.of))
            return found.select("k", *self.columns)
        if not isinstance(e, G.Path):
            raise XPathError("a node-set is wanted here")
        steps = list(e.steps)
        if e.start == "root":
            if top and len(steps) > 1 and steps[0] == G.Step("descendant-or-self", G.Test("node")) and steps[1].axis in ("child", "attribute"):
                found = self._of_any(steps[1])
                steps = steps[2:]
            elif top and steps:
                found = self._from_documents(steps.pop(0))
            else:
                found = ctx.select("k", "c_doc").join(self.nodes.where("kind = 'document'"), F.col("c_doc") == F.col("doc_id")).select("k", *self.columns)
        elif e.start == "context":
            if steps and steps[0] != G.Step("self", G.Test("node")):
                found = self._step(self._at(ctx), steps.pop(0), top)
            else:
                if steps:
                    steps.pop(0)
                found = self._at(ctx)
        else:
            found = self.node_set(e.start, ctx)
        for s in steps:
            found = self._step(found, s, top)
        return found.select("k", *self.columns)

    def leafy(self, e) -> bool:
        """Whether all nodes that ``e`` gives surely have their string-value in their row."""
        if isinstance(e, G.Step):
            t = e.test
            plain = t.kind == "name" and t.name != "*" and self.xml.complex_names is not None and t.name not in self.xml.complex_names and "leaf" in self.extra
            return e.axis in ("attribute", "namespace") or t.kind in ("text", "comment", "pi") or plain
        if isinstance(e, G.Binary):
            return e.op == "|" and self.leafy(e.left) and self.leafy(e.right)
        if isinstance(e, G.Filter):
            return self.leafy(e.of)
        return isinstance(e, G.Path) and bool(e.steps) and self.leafy(e.steps[-1])

    def _at(self, ctx: DataFrame) -> DataFrame:
        """The context nodes themselves."""
        if (rows := getattr(ctx, "_at", None)) is not None:
            return rows
        return ctx.select("k", "c_doc", "c_pre").join(self.nodes, (F.col("c_doc") == F.col("doc_id")) & (F.col("c_pre") == F.col("pre"))).select("k", *self.columns)

    def _from_documents(self, step: G.Step) -> DataFrame:
        """The first step of an absolute path with one context per document needs no join: its axis is a filter."""
        tested = self._test(step)
        if step.axis == "child":
            found = tested.where("parent_pre = 0 AND kind NOT IN ('attribute', 'document')")
        elif step.axis == "descendant":
            found = tested.where("kind NOT IN ('attribute', 'document')")
        elif step.axis == "descendant-or-self":
            found = tested.where("kind <> 'attribute'")
        elif step.axis in ("self", "ancestor-or-self"):
            found = tested.where("kind = 'document'")
        else:
            found = tested.where("false")
        return self._chosen(found.withColumn("k", F.col("doc_id")).withColumn("o", F.lit(0)), step)

    def _of_any(self, step: G.Step) -> DataFrame:
        """``//child`` with places within each parent: every node has one parent, so no join either."""
        found = self._test(step).where("kind = 'attribute'" if step.axis == "attribute" else "kind NOT IN ('attribute', 'document')")
        return self._chosen(found.withColumn("k", F.col("doc_id")).withColumn("o", F.col("parent_pre")), step)

    def _chosen(self, found: DataFrame, step: G.Step) -> DataFrame:
        for p in step.predicates:
            found = self._predicate(found, p, step.axis in REVERSE, self.leafy(step))
        return found.select("k", *self.columns)

    def _test(self, step: G.Step) -> DataFrame:
        """The nodes that pass a step's node test; the test reaches the scan."""
        t, n = step.test, self.nodes
        if t.kind == "name":
            n = n.where(F.col("kind") == {"attribute": "attribute", "namespace": "namespace"}.get(step.axis, "element"))
            if t.prefix is not None and self.match != "local":
                if self.namespaces is not None:
                    if t.prefix not in self.namespaces:
                        raise XPathError(f"no namespace for prefix {t.prefix!r}")
                    n = n.where(F.col("ns_uri") == self.namespaces[t.prefix])
                else:
                    n = n.where(F.col("prefix") == t.prefix)
            elif t.name != "*" and self.match != "local":
                n = n.where("prefix IS NULL" if self.namespaces is None else "prefix IS NULL OR kind = 'element' AND ns_uri IS NULL")
            return n if t.name == "*" else n.where(F.col("name") == t.name)
        if t.kind == "text":
            return n.where("kind IN ('text', 'cdata')")
        if t.kind == "node":
            return n
        n = n.where(F.col("kind") == t.kind)
        return n.where(F.col("name") == t.name) if t.name is not None else n

    def _step(self, current: DataFrame, step: G.Step, whole: bool = False) -> DataFrame:
        """Nodes that ``step`` leads to from ``current`` (k, NODE), each once. ``whole``: there is one context for each document, so ``k`` is its id.

        Where no predicate counts places, no pairs are made: what follows any of some nodes follows the one that ends first, and what lies above
        or below any of them is found by a semi-join.
        """
        if step.axis == "namespace":
            found = self._namespaces(current, step)
        else:
            c = current.select("k", *[F.col(x).alias(f"c_{x}") for x in ("doc_id", "pre", "sub", "last", "parent_pre", "kind")])
            n = self._test(step)
            C, N = (lambda x: F.col(f"c_{x}")), F.col
            tree = n.where("kind <> 'attribute'")
            same = C("doc_id") == N("doc_id")
            own = C("kind").isin("attribute", "namespace")
            axis = {
                "child": (tree, (N("parent_pre") == C("pre")) & ~own),
                "attribute": (n.where("kind = 'attribute'"), (N("parent_pre") == C("pre")) & ~own),
                "parent": (n, N("pre") == C("parent_pre")),
                "self": (n, (N("pre") == C("pre")) & (C("sub") == 0)),
                "descendant": (tree, (N("pre") > C("pre")) & (N("pre") <= C("last")) & ~own),
                "descendant-or-self": (n, (N("pre") >= C("pre")) & (N("pre") <= C("last")) & ((N("kind") != "attribute") | (N("pre") == C("pre")))),
                "ancestor": (tree, (N("last") >= C("pre")) & ((N("pre") < C("pre")) | (own & (N("pre") == C("parent_pre"))))),
                "ancestor-or-self": (n, (N("last") >= C("pre")) & (N("pre") <= C("pre"))),
                "following-sibling": (tree, (N("parent_pre") == C("parent_pre")) & (N("pre") > C("pre")) & ~own),
                "preceding-sibling": (tree, (N("parent_pre") == C("parent_pre")) & (N("pre") < C("pre")) & ~own),
                "following": (tree, N("pre") > C("last")),
                "preceding": (tree, N("last") < C("pre")),
            }
            table, condition = axis[step.axis]
            if not any(G.positional(p) or self.type_of(p) == "number" for p in step.predicates):
                nearest = {"following": F.min("c_last"), "preceding": F.max("c_pre"), "following-sibling": F.min("c_pre"), "preceding-sibling": F.max("c_pre")}.get(step.axis)
                if nearest is not None:
                    if "sibling" in step.axis:
                        c = c.where(~own).groupBy("k", "c_doc_id", "c_parent_pre").agg(nearest.alias("c_pre")).withColumn("c_kind", F.lit("element"))
                    else:
                        c = c.groupBy("k", "c_doc_id").agg(nearest.alias("c_last" if step.axis == "following" else "c_pre"))
                    return self._chosen(c.join(table, same & condition).withColumn("o", F.lit(0)), step)
                if whole and step.axis in ("parent", "ancestor", "ancestor-or-self", "descendant", "descendant-or-self"):
                    return self._chosen(table.join(c.drop("k"), same & condition, "left_semi").withColumn("k", F.col("doc_id")).withColumn("o", F.lit(0)), step)
            found = c.join(table, same & condition).withColumn("o", F.col("c_pre"))
        found = self._chosen(found, step)
        if step.axis in ("child", "attribute", "self"):  # a node has one parent: nothing repeats
            return found
        return found.dropDuplicates(["k", "doc_id", "pre", "sub"])

    def _namespaces(self, current: DataFrame, step: G.Step) -> DataFrame:
        """In-scope namespaces of elements: the nearest declaration of each prefix, and xml."""
        c = current.where("kind = 'element'").select("k", F.col("doc_id").alias("c_doc"), F.col("pre").alias("c_pre"), F.col("level").alias("c_level"))
        d = self.xml.ns_decls.withColumnRenamed("prefix", "d_prefix")
        near = c.join(d, (F.col("c_doc") == F.col("doc_id")) & (F.col("c_pre") >= F.col("owner_pre")) & (F.col("c_pre") <= F.col("owner_last")))
        near = near.groupBy("k", "c_doc", "c_pre", "c_level", "d_prefix").agg(F.max_by("uri", "owner_pre").alias("uri")).where("uri <> ''")
        both = near.unionByName(c.withColumn("d_prefix", F.lit("xml")).withColumn("uri", F.lit(XML_URI))).dropDuplicates(["k", "c_doc", "c_pre", "d_prefix"])
        t = step.test
        if t.kind == "name" and t.name != "*":
            both = both.where((F.col("d_prefix") == t.name) & F.lit(t.prefix is None))
        elif t.kind not in ("name", "node"):
            both = both.where("false")
        sub = F.row_number().over(Window.partitionBy("k", "c_doc", "c_pre").orderBy("d_prefix"))
        null = F.lit(None).cast("string")
        return both.select("k", F.col("c_pre").alias("o"), F.col("c_doc").alias("doc_id"), F.col("c_pre").alias("pre"), sub.alias("sub"), F.col("c_pre").alias("last"), (F.col("c_level") + 1).alias("level"), F.col("c_pre").alias("parent_pre"), F.lit("namespace").alias("kind"), F.col("d_prefix").alias("name"), null.alias("prefix"), F.col("uri").alias("value"), *[F.lit(None).cast(self.nodes.schema[x].dataType).alias(x) for x in self.extra])

    def _ids(self, e, ctx: DataFrame) -> DataFrame:
        if self.type_of(e) == "nodes":
            found = self.string_values(self.node_set(e, ctx), self.leafy(e))
            wanted = found.select("k", F.col("doc_id").alias("w_doc"), F.col("sv").alias("ids"))
        else:
            v = self.string(e, ctx)
            wanted = v.frame.select("k", F.col("c_doc").alias("w_doc"), v.column.alias("ids"))
        wanted = wanted.select("k", "w_doc", F.explode(F.split("ids", r"[ \t\n\r]+")).alias("id")).distinct()
        marks = self.nodes.where("kind = 'attribute' AND name = 'id' AND prefix IS NULL").select(F.col("doc_id").alias("a_doc"), F.col("parent_pre").alias("a_pre"), F.col("value").alias("a_id"))
        hit = wanted.join(by_merge(marks), (F.col("w_doc") == F.col("a_doc")) & (F.col("id") == F.col("a_id"))).select("k", "a_doc", "a_pre").distinct()
        return hit.join(self.nodes, (F.col("a_doc") == F.col("doc_id")) & (F.col("a_pre") == F.col("pre"))).select("k", *self.columns)

    def _predicate(self, found: DataFrame, p, reverse: bool, leafy: bool = False) -> DataFrame:
        """``found`` (k, o: origin, NODE) filtered by one predicate; places count anew within each origin. ``leafy``: all string-values are in the rows."""
        order = [F.col("pre").desc(), F.col("sub").desc()] if reverse else ["pre", "sub"]
        placed = G.positional(p) or self.type_of(p) == "number"
        if placed:
            w = Window.partitionBy("k", "o", "doc_id")
            found = found.withColumn("pos", F.row_number().over(w.orderBy(*order))).withColumn("size", F.count(F.lit(1)).over(w))
            if isinstance(p, G.Number):
                return found.where(F.col("pos") == p.value).drop("pos", "size")
            key = F.struct("k", "o", "doc_id", "pre", "sub")
        else:  # depends on the node alone
            found = found.withColumn("pos", F.lit(1)).withColumn("size", F.lit(1))
            key = F.struct("doc_id", "pre", "sub")
        kids: dict = {}
        if (cell := self._cell(p, leafy, kids)) is not None:
            good = F.col("pos").cast("double") == cell.column if cell.type == "number" else self._as_boolean(cell, kids)
            return self._with_kids(found, kids).where(good).select(*[c for c in found.columns if c not in ("pos", "size")])
        mine = found.withColumn("kk", key)
        ctx = mine.select(F.col("kk").alias("k"), F.col("doc_id").alias("c_doc"), F.col("pre").alias("c_pre"), F.col("sub").alias("c_sub"), F.col("pos").alias("c_pos"), F.col("size").alias("c_size"))
        rows = mine.select(F.col("kk").alias("k"), *self.columns)
        if not placed:
            ctx, rows = ctx.distinct(), rows.dropDuplicates(["k"])
        ctx._at = rows
        if self.type_of(p) == "number":
            v = self.number(p, ctx)
            good, how = v.frame.where(F.col("c_pos").cast("double") == v.column), "left_semi"
        elif self.type_of(p) == "nodes":
            good, how = self.node_set(p, ctx), "left_semi"
        elif isinstance(p, G.Call) and p.name == "not" and self.type_of(p.args[0]) == "nodes":
            good, how = self.node_set(p.args[0], ctx), "left_anti"
        else:
            v = self.boolean(p, ctx)
            good, how = v.frame.where(v.column), "left_semi"
        g = self.fresh("g")
        return mine.join(by_merge(good.select(F.col("k").alias(g))), F.col("kk") == F.col(g), how).drop("kk", "pos", "size")

    # ---- expressions as columns of a node's row

    def _cell(self, e, leafy: bool, kids: dict) -> Cell | None:
        """``e`` for the node of a row, or None if it takes more than the row, its attributes and aggregates of its children.

        ``kids`` gathers the aggregates: (axis, test) to a list of (name, aggregate).
        """
        sub = lambda x: self._cell(x, leafy, kids)
        if isinstance(e, (G.Number, G.Literal)):
            return Cell("number" if isinstance(e, G.Number) else "string", F.lit(e.value), True)
        if isinstance(e, G.Variable):
            kind, v = self.type_of(e), self.variables[e.name]
            return None if kind == "nodes" else Cell(kind, v if isinstance(v, Column) else F.lit(float(v) if kind == "number" else v), not isinstance(v, Column))
        if isinstance(e, G.Path):
            return self._path_cell(e, leafy)
        if isinstance(e, G.Negate):
            v = self._as_number(sub(e.of), kids)
            return None if v is None else Cell("number", -v)
        if isinstance(e, G.Binary) and e.op != "|":
            a, b = sub(e.left), sub(e.right)
            return None if a is None or b is None else self._binary_cell(e.op, a, b, kids)
        if isinstance(e, G.Call):
            self.type_of(e)
            return self._call_cell(e, leafy, kids)
        return None

    def _path_cell(self, e: G.Path, leafy: bool) -> Cell | None:
        if e.start != "context":
            return None
        if e.steps in ((), (G.Step("self", G.Test("node")),)):
            own = F.coalesce(F.col("leaf") if "leaf" in self.extra else F.lit(None), F.col("value"), F.lit(""))
            return Cell("node", own) if leafy else None
        if len(e.steps) > 1 or e.steps[0].predicates:
            return None
        step = e.steps[0]
        t = step.test
        if step.axis == "attribute" and t.kind == "name" and t.name != "*" and self.namespaces is None and self.match == "prefix" and "attrs" in self.extra:
            return Cell("node", F.element_at("attrs", f"{t.prefix}:{t.name}" if t.prefix else t.name))
        return Cell("kids", None, step=step) if step.axis in ("child", "attribute") and t.kind != "node" else None

    def _of_kids(self, step: G.Step, kids: dict, aggregate: Column, default=None) -> Column:
        name = self.fresh("kid")
        kids.setdefault((step.axis, step.test), []).append((name, aggregate))
        return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))

    def _with_kids(self, found: DataFrame, kids: dict) -> DataFrame:
        """``found`` with the aggregates of its elements' children: partial sums, never lists."""
        for (axis, test), wanted in kids.items():
            n = self._test(G.Step(axis, test)).where("kind = 'attribute'" if axis == "attribute" else "kind NOT IN ('attribute', 'document')")
            sv = F.coalesce("leaf", "value", F.lit("")) if "leaf" in self.extra else F.coalesce("value", F.lit(""))
            doc, pre = self.fresh("kid_doc"), self.fresh("kid_pre")
            n = n.withColumn("sv", sv).groupBy(F.col("doc_id").alias(doc), F.col("parent_pre").alias(pre)).agg(*[a.alias(name) for name, a in wanted])
            found = found.join(n, (F.col("doc_id") == F.col(doc)) & (F.when(~F.col("kind").isin("attribute", "namespace"), F.col("pre")) == F.col(pre)), "left")
        return found

    def _as_boolean(self, c: Cell | None, kids: dict) -> Column | None:
        if c is None:
            return None
        if c.type == "kids":
            return self._of_kids(c.step, kids, F.max(F.lit(True)), False)
        return {"boolean": lambda x: x, "number": V.number_to_boolean, "string": lambda x: x != "", "node": lambda x: x.isNotNull()}[c.type](c.column)

    def _as_string(self, c: Cell | None, kids: dict) -> Column | None:
        if c is None or c.type == "kids" and not self.leafy(c.step):
            return None
        if c.type == "kids":
            return self._of_kids(c.step, kids, F.min_by("sv", "pre"), "")
        return {"string": lambda x: x, "number": V.number_to_string, "boolean": V.boolean_to_string, "node": lambda x: F.coalesce(x, F.lit(""))}[c.type](c.column)

    def _as_number(self, c: Cell | None, kids: dict) -> Column | None:
        if c is not None and c.type in ("number", "boolean"):
            return c.column if c.type == "number" else c.column.cast("int").cast("double")
        text = self._as_string(c, kids)
        return None if text is None else V.to_number(text)

    def _binary_cell(self, op: str, a: Cell, b: Cell, kids: dict) -> Cell | None:
        if op in ("and", "or"):
            x, y = self._as_boolean(a, kids), self._as_boolean(b, kids)
            return Cell("boolean", x & y if op == "and" else x | y)
        if op in _ARITHMETIC:
            x, y = self._as_number(a, kids), self._as_number(b, kids)
            return None if x is None or y is None else Cell("number", _ARITHMETIC[op](x, y), a.fixed and b.fixed)
        many = ("node", "kids")
        if a.type in many and b.type in many and "kids" in (a.type, b.type):
            return None
        if b.type in many and a.type not in many:
            a, b, op = b, a, _TURNED.get(op, op)
        if a.type in many and b.type != "boolean":
            by_text = op in ("=", "!=") and b.type in ("string", "node")

            def holds(sv):
                if by_text:
                    return sv == b.column if op == "=" else sv != b.column
                return V.compare(op, V.to_number(sv), b.column if b.type == "number" else V.to_number(b.column))

            if a.type == "kids":
                return Cell("boolean", self._of_kids(a.step, kids, F.max(holds(F.col("sv"))), False)) if b.fixed and self.leafy(a.step) else None
            there = a.column.isNotNull() & b.column.isNotNull() if b.type == "node" else a.column.isNotNull()
            return Cell("boolean", F.coalesce(there & holds(a.column), F.lit(False)))
        if op in ("=", "!=") and "boolean" in (a.type, b.type):
            x, y = self._as_boolean(a, kids), self._as_boolean(b, kids)
            return Cell("boolean", x == y if op == "=" else x != y)
        if op in ("=", "!=") and "number" not in (a.type, b.type):
            x, y = self._as_string(a, kids), self._as_string(b, kids)
            return Cell("boolean", x == y if op == "=" else x != y)
        logical = lambda c: Cell("boolean", self._as_boolean(c, kids)) if c.type in many else c
        return Cell("boolean", V.compare(op, self._as_number(logical(a), kids), self._as_number(logical(b), kids)))

    def _call_cell(self, e: G.Call, leafy: bool, kids: dict) -> Cell | None:
        name = e.name
        args = [self._cell(a, leafy, kids) for a in e.args]
        if name in ("true", "false"):
            return Cell("boolean", F.lit(name == "true"), True)
        if name in ("position", "last"):
            return Cell("number", F.col("pos" if name == "position" else "size").cast("double"))
        if name in ("local-name", "name") and not args:
            local = F.coalesce("name", F.lit(""))
            return Cell("string", F.concat_ws(":", "prefix", local) if name == "name" else local)
        if name in ("id", "lang", "namespace-uri", "local-name", "name") or any(a is None for a in args):
            return None
        if name in ("count", "sum"):
            if args[0].type != "kids" or name == "sum" and not self.leafy(args[0].step):
                return None
            return Cell("number", self._of_kids(args[0].step, kids, F.count(F.lit(1)).cast("double") if name == "count" else F.sum(V.to_number(F.col("sv"))), 0.0))
        args = args or ([] if name in self.functions else [self._path_cell(G.Path("context", ()), leafy)])
        if any(a is None for a in args):
            return None
        if name in ("boolean", "not"):
            v = self._as_boolean(args[0], kids)
            return Cell("boolean", v if name == "boolean" else ~v)
        numbers = name in ("number", "floor", "ceiling", "round")
        columns = [(self._as_number if numbers or name == "substring" and i else self._as_string)(a, kids) for i, a in enumerate(args)]
        if any(c is None for c in columns):
            return None
        if numbers:
            return Cell("number", columns[0] if name == "number" else V.rounded(name, columns[0]))
        if name == "string":
            return Cell("string", columns[0])
        return Cell(*self._text_function(e, columns))

    # ---- string-values

    def string_values(self, found: DataFrame, leafy: bool = False) -> DataFrame:
        """``found`` with ``sv``: all text below an element or document, or the node's own value. ``leafy``: every row has it already."""
        leaf = F.col("leaf") if "leaf" in self.extra else F.lit(None).cast("string")
        if leafy:
            return found.withColumn("sv", F.coalesce(leaf, "value", F.lit("")))
        inner = found.where("kind IN ('element', 'document')").where(leaf.isNull())
        nodes = inner.select(F.col("doc_id").alias("s_doc"), F.col("pre").alias("s_pre"), F.col("last").alias("s_last")).distinct()
        text = self.nodes.where("kind IN ('text', 'cdata')").select("doc_id", "pre", "value")
        joined = nodes.join(text, (F.col("s_doc") == F.col("doc_id")) & (F.col("pre") > F.col("s_pre")) & (F.col("pre") <= F.col("s_last")))
        parts = F.array_sort(F.collect_list(F.struct("pre", "value")))
        sv = joined.groupBy("s_doc", "s_pre").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("sv"))
        out = found.join(by_merge(sv), (F.col("doc_id") == F.col("s_doc")) & (F.col("pre") == F.col("s_pre")) & (F.col("sub") == 0), "left")
        return out.withColumn("sv", F.when(F.col("kind").isin("element", "document"), F.coalesce(leaf, "sv", F.lit(""))).otherwise(F.coalesce("value", F.lit("")))).drop("s_doc", "s_pre")

    def _first(self, found: DataFrame) -> DataFrame:
        """The first node of each context, in document order."""
        return found.groupBy("k").agg(F.min_by(F.struct(*self.columns), F.struct("pre", "sub")).alias("n")).select("k", "n.*")

    def _attach(self, frame: DataFrame, result: DataFrame, column: str, default) -> tuple[DataFrame, Column]:
        """``result`` (k, column) brought to the rows of ``frame``."""
        key, name = self.fresh("k"), self.fresh(column)
        r = result.select(F.col("k").alias(key), F.col(column).alias(name))
        out = frame.join(by_merge(r), F.col("k") == F.col(key), "left").drop(key)
        out._contexts = _base(frame)
        return out, F.coalesce(F.col(name), F.lit(default))

    # ---- scalars

    def scalar(self, e, ctx: DataFrame) -> Value:
        """A number, string or boolean, with its own type."""
        if isinstance(e, G.Number):
            return Value("number", ctx, F.lit(e.value))
        if isinstance(e, G.Literal):
            return Value("string", ctx, F.lit(e.value))
        if isinstance(e, G.Variable):
            kind, v = self.type_of(e), self.variables[e.name]
            return Value(kind, ctx, v if isinstance(v, Column) else F.lit(float(v) if kind == "number" else v))
        if isinstance(e, G.Negate):
            v = self.number(e.of, ctx)
            return Value("number", v.frame, -v.column)
        if isinstance(e, G.Binary):
            return self._binary(e, ctx)
        if isinstance(e, G.Call):
            self.type_of(e)
            return self._call(e, ctx)
        raise XPathError("a number, string or boolean is wanted here")

    def string(self, e, ctx: DataFrame) -> Value:
        if self.type_of(e) == "nodes":
            frame, column = self._attach(ctx, self.string_values(self._first(self.node_set(e, ctx)), self.leafy(e)), "sv", "")
            return Value("string", frame, column)
        v = self.scalar(e, ctx)
        how = {"string": lambda c: c, "number": V.number_to_string, "boolean": V.boolean_to_string}[v.type]
        return Value("string", v.frame, how(v.column))

    def number(self, e, ctx: DataFrame) -> Value:
        v = self.string(e, ctx) if self.type_of(e) == "nodes" else self.scalar(e, ctx)
        how = {"string": V.to_number, "number": lambda c: c, "boolean": lambda c: c.cast("int").cast("double")}[v.type]
        return Value("number", v.frame, how(v.column))

    def boolean(self, e, ctx: DataFrame) -> Value:
        if self.type_of(e) == "nodes":
            hit = self.node_set(e, ctx).select("k").distinct().withColumn("there", F.lit(True))
            return Value("boolean", *self._attach(ctx, hit, "there", False))
        v = self.scalar(e, ctx)
        how = {"string": lambda c: c != "", "number": V.number_to_boolean, "boolean": lambda c: c}[v.type]
        return Value("boolean", v.frame, how(v.column))

    def _binary(self, e: G.Binary, ctx: DataFrame) -> Value:
        if e.op in ("and", "or"):
            a = self.boolean(e.left, ctx)
            b = self.boolean(e.right, a.frame)
            return Value("boolean", b.frame, a.column & b.column if e.op == "and" else a.column | b.column)
        if e.op in _ARITHMETIC:
            a = self.number(e.left, ctx)
            b = self.number(e.right, a.frame)
            return Value("number", b.frame, _ARITHMETIC[e.op](a.column, b.column))
        left, right = self.type_of(e.left), self.type_of(e.right)
        if "nodes" in (left, right) and "boolean" not in (left, right):
            return self._compare_nodes(e, left, right, ctx)
        if e.op in ("=", "!=") and "boolean" in (left, right):
            a = self.boolean(e.left, ctx)
            b = self.boolean(e.right, a.frame)
            return Value("boolean", b.frame, a.column == b.column if e.op == "=" else a.column != b.column)
        if e.op in ("=", "!=") and "number" not in (left, right):
            a = self.string(e.left, ctx)
            b = self.string(e.right, a.frame)
            return Value("boolean", b.frame, a.column == b.column if e.op == "=" else a.column != b.column)
        as_number = lambda x, c: self.number(G.Call("boolean", (x,)) if self.type_of(x) == "nodes" and "boolean" in (left, right) else x, c)
        a = as_number(e.left, ctx)
        b = as_number(e.right, a.frame)
        return Value("boolean", b.frame, V.compare(e.op, a.column, b.column))

    def _compare_nodes(self, e: G.Binary, left: str, right: str, ctx: DataFrame) -> Value:
        """Whether any node, or any pair, compares so."""
        op = e.op
        if left == "nodes" and right == "nodes":
            a = self.string_values(self.node_set(e.left, ctx), self.leafy(e.left)).select("k", F.col("sv").alias("a"))
            b = self.string_values(self.node_set(e.right, ctx), self.leafy(e.right)).select(F.col("k").alias("k2"), F.col("sv").alias("b"))
            if op == "=":
                hit = a.join(by_merge(b), (F.col("k") == F.col("k2")) & (F.col("a") == F.col("b"))).select("k").distinct()
            else:  # extremes of both sides tell whether any pair differs or is in order
                num = op != "!="
                x = V.to_number(F.col("a")) if num else F.col("a")
                y = V.to_number(F.col("b")) if num else F.col("b")
                real = lambda c: F.when(~F.isnan(c), c) if num else c
                a = a.groupBy("k").agg(F.min(real(x)).alias("a0"), F.max(real(x)).alias("a1"))
                b = b.groupBy("k2").agg(F.min(real(y)).alias("b0"), F.max(real(y)).alias("b1"))
                test = {"!=": "a0 <> b1 OR a1 <> b0 OR a0 <> b0", "<": "a0 < b1", "<=": "a0 <= b1", ">": "a1 > b0", ">=": "a1 >= b0"}[op]
                hit = a.join(by_merge(b), F.col("k") == F.col("k2")).where(test).select("k")
        else:
            nodes, other = (e.left, e.right) if left == "nodes" else (e.right, e.left)
            op = op if left == "nodes" else _TURNED.get(op, op)
            kind = self.type_of(other)
            found = self.string_values(self.node_set(nodes, ctx), self.leafy(nodes)).select("k", "sv")
            v = self.scalar(other, ctx)
            if isinstance(other, (G.Number, G.Literal, G.Variable)):
                against, column = found, v.column
            else:
                against = found.join(by_merge(v.frame.select(F.col("k").alias("k2"), v.column.alias("other"))), F.col("k") == F.col("k2"))
                column = F.col("other")
            if op in ("=", "!=") and kind == "string":
                test = F.col("sv") == column if op == "=" else F.col("sv") != column
            else:
                test = V.compare(op, V.to_number(F.col("sv")), V.to_number(column) if kind == "string" else column)
            hit = against.where(test).select("k").distinct()
        return Value("boolean", *self._attach(ctx, hit.withColumn("there", F.lit(True)), "there", False))

    def _call(self, e: G.Call, ctx: DataFrame) -> Value:
        name, args = e.name, e.args
        this = G.Path("context", ())
        if name in ("true", "false"):
            return Value("boolean", ctx, F.lit(name == "true"))
        if name in ("position", "last"):
            return Value("number", ctx, F.col("c_pos" if name == "position" else "c_size").cast("double"))
        if name in ("count", "sum"):
            if self.type_of(args[0]) != "nodes":
                raise XPathError(f"{name}() takes a node-set")
            found = self.node_set(args[0], ctx)
            if name == "count":
                result, default = found.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("r")), 0.0
            else:
                result, default = self.string_values(found, self.leafy(args[0])).groupBy("k").agg(F.sum(V.to_number(F.col("sv"))).alias("r")), 0.0
            return Value("number", *self._attach(ctx, result, "r", default))
        if name in ("local-name", "namespace-uri", "name"):
            arg = args[0] if args else this
            if self.type_of(arg) != "nodes":
                raise XPathError(f"{name}() takes a node-set")
            first = self._first(self.node_set(arg, ctx))
            if name == "namespace-uri":
                if "ns_uri" not in self.columns:
                    first = with_namespaces(first, self.xml.ns_decls)
                first = first.withColumn("r", F.coalesce("ns_uri", F.lit("")))
            else:
                local = F.coalesce("name", F.lit(""))
                first = first.withColumn("r", F.concat_ws(":", "prefix", local) if name == "name" else local)
            return Value("string", *self._attach(ctx, first, "r", ""))
        if name in ("string", "number", "boolean", "not"):
            v = {"string": self.string, "number": self.number}.get(name, self.boolean)(args[0] if args else this, ctx)
            return Value(v.type, v.frame, ~v.column) if name == "not" else v
        if name == "lang":
            return self._lang(args[0], ctx)
        if name in ("floor", "ceiling", "round"):
            v = self.number(args[0], ctx)
            return Value("number", v.frame, V.rounded(name, v.column))
        frame, columns = ctx, []
        for i, a in enumerate(args or (this,)):
            v = (self.number if name == "substring" and i else self.string)(a, frame)
            frame = v.frame
            columns.append(v.column)
        kind, column = self._text_function(e, columns)
        return Value(kind, frame, column)

    def _text_function(self, e: G.Call, columns: list[Column]) -> tuple[str, Column]:
        """Type and column of a function of strings (and, for substring(), numbers)."""
        name = e.name
        if name in self.functions and name not in _ARITY:
            return "string", F.coalesce(self.functions[name](*columns).cast("string"), F.lit(""))
        a, b, c = (*columns, None, None, None)[:3]
        at = F.instr(a, b) if b is not None and name.startswith("substring-") else None
        table = {
            "concat": lambda: ("string", F.concat(*columns)),
            "starts-with": lambda: ("boolean", F.startswith(a, b)),
            "contains": lambda: ("boolean", F.contains(a, b)),
            "substring-before": lambda: ("string", F.when((at > 0) & (b != ""), F.substring(a, F.lit(1), at - 1)).otherwise("")),
            "substring-after": lambda: ("string", F.when(b == "", a).when(at > 0, F.substring(a, at + F.length(b), F.length(a))).otherwise("")),
            "substring": lambda: ("string", V.substring(a, b, c)),
            "string-length": lambda: ("number", F.length(a).cast("double")),
            "normalize-space": lambda: ("string", F.trim(F.regexp_replace(a, r"[ \t\n\r]+", " "))),
            "translate": lambda: ("string", F.translate(a, *_literals(e.args)) if _literals(e.args) else V.translate(a, b, c)),
        }
        return table[name]()

    def _lang(self, e, ctx: DataFrame) -> Value:
        """By the nearest xml:lang, without case, up to a hyphen."""
        marks = self.nodes.where("kind = 'attribute' AND name = 'lang' AND prefix = 'xml'").select("doc_id", F.col("parent_pre").alias("m_pre"), F.col("value").alias("m_lang"))
        owners = self.nodes.where("kind = 'element'").select(F.col("doc_id").alias("o_doc"), F.col("pre").alias("o_pre"), F.col("last").alias("o_last"))
        spans = marks.join(owners, (F.col("doc_id") == F.col("o_doc")) & (F.col("m_pre") == F.col("o_pre"))).select("o_doc", "o_pre", "o_last", "m_lang")
        near = _base(ctx).select("k", "c_doc", "c_pre").join(by_merge(spans), (F.col("c_doc") == F.col("o_doc")) & (F.col("c_pre") >= F.col("o_pre")) & (F.col("c_pre") <= F.col("o_last")))
        near = near.groupBy("k").agg(F.max_by("m_lang", "o_pre").alias("near"))
        v = self.string(e, ctx)
        frame, lang = self._attach(v.frame, near, "near", "")
        have, want = F.lower(lang), F.lower(v.column)
        return Value("boolean", frame, (have == want) | F.startswith(have, F.concat(want, F.lit("-"))))

    # ---- results

    def run(self, expression: str, contexts: DataFrame | None = None) -> DataFrame:
        """A node-set's rows (doc_id, pre, sub, kind, name, prefix, value: its string-value), or (doc_id, value) of each document.

        ``contexts`` (doc_id, pre) replaces root elements as contexts; results then also have context_pre.
        """
        e = G.parse(expression)
        top = contexts is None
        ctx = self.contexts() if top else contexts.select(F.struct("doc_id", "pre").alias("k"), F.col("doc_id").alias("c_doc"), F.col("pre").alias("c_pre"), F.lit(0).alias("c_sub"), F.lit(1).alias("c_pos"), F.lit(1).alias("c_size"))
        origin = [] if top else [F.col("k.pre").alias("context_pre")]
        if self.type_of(e) == "nodes":
            found = self.string_values(self.node_set(e, ctx), self.leafy(e))
            return found.select("doc_id", *origin, "pre", "sub", "kind", "name", "prefix", F.col("sv").alias("value"))
        kids: dict = {}
        if top and not G.counts_places(e) and (cell := self._cell(e, False, kids)) is not None:
            return self._with_kids(self._roots(), kids).select("doc_id", cell.column.alias("value"))
        v = self.scalar(e, ctx)
        return v.frame.select(F.col("c_doc").alias("doc_id"), *origin, v.column.alias("value"))


def _literals(args) -> tuple[str, str] | None:
    """The last two arguments of translate(), cleaned of repeated characters (the first counts)."""
    if len(args) != 3 or not all(isinstance(a, G.Literal) for a in args[1:]):
        return None
    pairs: dict[str, str] = {}
    for i, ch in enumerate(args[1].value):
        pairs.setdefault(ch, args[2].value[i] if i < len(args[2].value) else "")
    kept = [c for c in pairs if pairs[c]] + [c for c in pairs if not pairs[c]]
    return "".join(kept), "".join(pairs[c] for c in kept)


def xpath(xml: Shredded, expression: str, contexts: DataFrame | None = None, **options) -> DataFrame:
    """Evaluate an XPath 1.0 expression over every document of a collection; see ``Engine`` for options."""
    return Engine(xml, **options).run(expression, contexts)
