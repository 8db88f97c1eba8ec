"""Command line: ``python -m xylem.cli parse|xpath|format|version FILE ...`` over files or folders, one document a file.

Options that are not given are taken from XYLEM_OUTPUT, XYLEM_INDENT, XYLEM_COUNT and XYLEM_BOOLEAN, else they have their defaults. FILE ``-`` is
the standard input.

Exit codes: 0 done, 1 some document is not well-formed, 2 wrong use, 3 a wrong expression.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from xylem.operators import serialize
from xylem.plans.grammar import XPathError
from xylem.plans.xpath import xpath
from xylem.sources.encodings import decode, read_binary
from xylem.sources.shred import shred

VERSION = "0.1.0"
_OUTPUTS = ("xml", "json", "text")


def option(given, name: str, default):
    """What the command line gives, else the environment, else the default; flags are 1, true, yes or on in either case."""
    if given is not None:
        return given
    text = os.environ.get(f"XYLEM_{name}")
    if text is None:
        return default
    if isinstance(default, bool):
        return text.lower() in ("1", "true", "yes", "on")
    return type(default)(text)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("xylem")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name in ("parse", "format", "xpath"):
        c = sub.add_parser(name)
        c.add_argument("file")
        if name == "xpath":
            c.add_argument("expression")
        c.add_argument("--output", choices=_OUTPUTS)
        c.add_argument("--indent", type=int)
        c.add_argument("-c", "--count", action="store_true", default=None)
        c.add_argument("-b", "--boolean", action="store_true", default=None)
    o = p.parse_args(args)
    if o.command == "version":
        print(VERSION)
        return 0
    try:
        o.output, o.indent = option(o.output, "OUTPUT", "xml"), option(o.indent, "INDENT", 2 if o.command == "format" else 0)
        o.count, o.boolean = option(o.count, "COUNT", False), option(o.boolean, "BOOLEAN", False)
    except ValueError as e:
        p.error(str(e))
    if o.output not in _OUTPUTS:
        p.error(f"no output {o.output!r}")
    spark = SparkSession.builder.getOrCreate()
    files = spark.createDataFrame([(1, sys.stdin.buffer.read())], "doc_id long, data binary") if o.file == "-" else None
    xml = shred(read_binary(spark, o.file) if files is None else decode(files))
    bad = xml.documents.where("status <> 'OK'").count()
    if o.command == "xpath":
        wrapped = f"count({o.expression})" if o.count else f"boolean({o.expression})" if o.boolean else o.expression
        try:
            rows = xpath(xml, wrapped)
        except XPathError as e:
            print(e, file=sys.stderr)
            return 3
        if o.output == "xml" and "pre" in rows.columns:
            nodes = rows.where("kind = 'element'").select("doc_id", "pre")
            rows = serialize.serialize(xml, nodes, indent=o.indent).withColumnRenamed("xml", "value").unionByName(rows.where("kind <> 'element'").select("doc_id", "pre", "value"))
        for r in rows.orderBy(*[c for c in ("doc_id", "pre") if c in rows.columns]).toLocalIterator():
            print(r["value"])
    else:
        out = serialize.to_json(xml).withColumnRenamed("json", "xml") if o.output == "json" else xpath(xml, "string(/*)").withColumnRenamed("value", "xml") if o.output == "text" else serialize.serialize(xml, indent=o.indent)
        for r in out.orderBy("doc_id").toLocalIterator():
            print(r["xml"])
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
