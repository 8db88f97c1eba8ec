"""Bytes to XML text and back: detection by byte-order mark, declaration and content, conversion in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings by name, as Python's codecs call them (fixed values).
SUPPORTED = {
    "utf-8": "utf-8", "utf-16": "utf-16", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "us-ascii": "ascii", "iso-8859-1": "iso-8859-1", "iso-8859-5": "iso-8859-5",
    "windows-1252": "cp1252", "shift_jis": "shift_jis", "euc-jp": "euc_jp", "gb18030": "gb18030", "big5": "big5", "cp037": "cp037",
}
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_DECLARED = re.compile(rb"^<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']")


def detect(data: bytes) -> str:
    """The codec of a document: mark, then EBCDIC and UTF-16 by their zero or declaration bytes, then the declaration, then UTF-8 if valid, else Latin-1."""
    for mark, codec in _MARKS:
        if data.startswith(mark):
            return codec
    if data.startswith((b"\x4c\x6f\xa7\x94", b"\x4c")) and b"<" not in data[:64]:
        return "cp037"
    head = data[:64]
    if head[1::2].count(0) * 4 > len(head):
        return "utf-16-le"
    if head[::2].count(0) * 4 > len(head):
        return "utf-16-be"
    if m := _DECLARED.match(data):
        codec = SUPPORTED.get(m[1].decode().lower())
        if codec and not codec.startswith("utf-16"):  # a document that reads so far is not UTF-16, whatever it says
            return codec
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "iso-8859-1"


def _decode(encoding: str | None, column: str | None):
    def run(batches):
        for batch in batches:
            texts, used = [], []
            names = batch.column(column).to_pylist() if column else [encoding] * batch.num_rows
            for data, name in zip(batch.column("data").to_pylist(), names):
                if data is None:
                    texts.append(None)
                    used.append(None)
                    continue
                codec = SUPPORTED.get(name.lower(), name) if name else detect(data)
                try:
                    texts.append(data.decode(codec))
                    used.append(codec)
                except (UnicodeDecodeError, LookupError):
                    texts.append(None)
                    used.append(None)
            rest = [c for c in batch.schema.names if c != "data"]
            yield pa.record_batch([*[batch.column(c) for c in rest], pa.array(texts, pa.string()), pa.array(used, pa.string())], names=[*rest, "xml", "codec"])

    return run


def decode(docs: DataFrame, encoding: str | None = None, column: str | None = None) -> DataFrame:
    """(…, data) to (…, xml, codec), by ``encoding``, by that which ``column`` names in each row, or by detection; bytes that cannot be decoded give null, which shreds to an error row."""
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "data")
    return docs.select(*[c for c in docs.columns if c != "data"], "data").mapInArrow(_decode(encoding, column), f"{rest}, xml string, codec string")


def encode(docs: DataFrame, encoding: str, column: str = "xml") -> DataFrame:
    """(…, xml) to (…, data)."""
    codec = SUPPORTED.get(encoding.lower(), encoding)

    def run(batches):
        for batch in batches:
            rest = [c for c in batch.schema.names if c != column]
            data = [None if x is None else x.encode(codec, "xmlcharrefreplace") for x in batch.column(column).to_pylist()]
            yield pa.record_batch([*[batch.column(c) for c in rest], pa.array(data, pa.binary())], names=[*rest, "data"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != column)
    return docs.mapInArrow(run, f"{rest}, data binary")


def read_binary(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(doc_id, path, xml, codec) of each file."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").alias("data"))
    return decode(files, encoding)
