"""``xml_nodes(xml)``: the nodes of one document as a table function, for SQL with LATERAL. For collections, shred() does the same without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from xylem.streaming.events import Machine


@udtf(returnType="pre int, last int, level int, parent_pre int, kind string, name string, prefix string, value string, error string")
class XmlNodes:
    """Rows as in node tables; a document that is not well-formed is one row with the reason."""

    def eval(self, xml: str):
        rows, up, last = [[0, 0, 0, None, "document", None, None, None, None]], [0], ""

        def put(kind, q=None, value=None, parent=None):
            prefix, _, local = (q or "").rpartition(":")
            rows.append([len(rows), len(rows), len(up) + (kind == "attribute"), up[-1] if parent is None else parent, kind, local or None, prefix or None, value, None])

        for _, event, name, attrs, text, line, _ in Machine().feed(xml or "", True):
            if event == "error":
                yield None, None, None, None, "error", None, None, None, f"{text}, line {line}"
                return
            if event == "start_element":
                put("element", name)
                own = len(rows) - 1
                for a in attrs:
                    put("attribute", a["name"], a["value"], own)
                up.append(own)
            elif event == "end_element":
                rows[up.pop()][1] = len(rows) - 1
            elif event == "characters":
                if last == "characters":
                    rows[-1][7] += text
                else:
                    put("text", None, text)
            elif event in ("cdata", "comment", "processing_instruction"):
                put({"processing_instruction": "pi"}.get(event, event), name, text)
                if event == "processing_instruction":
                    rows[-1][5:7] = [name, None]
            last = event
        rows[0][1] = len(rows) - 1
        for r in rows:
            yield tuple(r)


def register(spark: SparkSession, name: str = "xml_nodes") -> None:
    """Make the table function known to SQL of the session."""
    spark.udtf.register(name, XmlNodes)
