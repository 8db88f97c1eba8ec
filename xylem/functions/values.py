"""XPath values as Spark columns: numbers, strings, booleans and character references, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[ \t\n\r]*-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)[ \t\n\r]*$"


def nan() -> Column:
    return F.lit(float("nan"))


def to_number(s: Column) -> Column:
    """number() of a string: NaN unless it is a plain decimal."""
    clean = F.regexp_replace(s, r"[ \t\n\r]", "")
    return F.when(s.rlike(_NUMBER), clean.try_cast("double")).otherwise(nan())


def number_to_string(n: Column) -> Column:
    """string() of a number: shortest decimal without an exponent."""
    whole = F.abs(n) < F.lit(1e15)
    integral = whole & (n == F.floor(n).cast("double"))
    plain = F.trim(F.regexp_replace(F.format_string("%.17f", n), r"0+$", ""))
    shown = n.cast("string")
    small = F.when(shown.contains("E"), F.regexp_replace(plain, r"\.$", "")).otherwise(F.regexp_replace(shown, r"\.0$", ""))
    return F.when(F.isnan(n), "NaN").when(n == float("inf"), "Infinity").when(n == float("-inf"), "-Infinity").when(integral, n.cast("long").cast("string")).when(whole, small).otherwise(n.cast("decimal(38,0)").cast("string"))


def boolean_to_string(b: Column) -> Column:
    return F.when(b, "true").otherwise("false")


def number_to_boolean(n: Column) -> Column:
    return (n != 0.0) & ~F.isnan(n)


def compare(op: str, a: Column, b: Column) -> Column:
    """IEEE comparison of doubles: never true with NaN, but for !=."""
    bad = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return bad | (a != b)
    return ~bad & {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def divide(a: Column, b: Column) -> Column:
    sign = F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)
    by_zero = F.when(F.isnan(a) | (a == 0.0), nan()).when(a * sign > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0.0, by_zero).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    return F.when((b == 0.0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf")), nan()).when(F.abs(b) == float("inf"), a).otherwise(F.try_mod(a, b))


def rounded(kind: str, n: Column) -> Column:
    """floor, ceiling or round (half up, as XPath has it), passing what has no fraction."""
    f = {"floor": F.floor(n), "ceiling": F.ceil(n), "round": F.floor(n + 0.5)}[kind]
    return F.when(F.isnan(n) | (F.abs(n) >= float(1 << 53)), n).otherwise(f.cast("double"))


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Characters at places p with round(start) <= p < round(start) + round(length)."""
    first = rounded("round", start)
    last = first + rounded("round", length) if length is not None else F.lit(float("inf"))
    a = F.greatest(first, F.lit(1.0))
    b = F.least(last, F.length(s).cast("double") + 1.0)
    bad = F.isnan(first) | F.isnan(last) | (b <= a)
    return F.when(bad, "").otherwise(F.substring(s, F.when(bad, 1).otherwise(a.cast("int")), F.when(bad, 0).otherwise((b - a).cast("int"))))


def translate(s: Column, old: Column, new: Column) -> Column:
    """Each character of ``s`` that is in ``old`` becomes the one at its first place there in ``new``, or goes where ``new`` is shorter."""

    def one(x):
        at = F.instr(old, x)
        return F.when(at == 0, x).when(at <= F.length(new), F.substring(new, at, F.lit(1))).otherwise("")

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), one), "")


def _utf16(cp: Column) -> Column:
    unit = lambda x: F.lpad(F.hex(x), 4, "0")
    high = F.lit(0xD800) + F.shiftright(cp - 0x10000, 10)
    low = F.lit(0xDC00) + (cp - 0x10000).bitwiseAND(0x3FF)
    return F.decode(F.unhex(F.when(cp < 0x10000, unit(cp)).otherwise(F.concat(unit(high), unit(low)))), "UTF-16BE")


#: The predefined entities (fixed values).
ENTITIES = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&apos;": "'"}


def unescape(s: Column, entities: dict[str, str] | None = None, own: Column | None = None) -> Column:
    """Character and entity references resolved; unknown ones stay as they are. A missing ``;`` after a number is forgiven.

    ``own`` maps references ("&x;") of the row's document to their text; one without a text leaves all of them in ``s`` as they are.
    """
    known = ENTITIES | {f"&{k};": v for k, v in (entities or {}).items()}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    parts = F.regexp_extract_all(s, F.lit(r"&#x[0-9A-Fa-f]+;?|&#[0-9]+;?|&[^&;\s#<]+;|[^&]+|&"), 0)
    if own is not None:
        own = F.when(~F.exists(parts, lambda x: F.coalesce(F.map_contains_key(own, x), F.lit(False)) & F.element_at(own, x).isNull()), own)

    def one(x):
        cp = F.coalesce(F.conv(F.regexp_extract(x, r"^&#x([0-9A-Fa-f]{1,8})", 1), 16, 10).try_cast("long"), F.regexp_extract(x, r"^&#([0-9]{1,10})", 1).try_cast("long"))
        fine = cp.isNotNull() & (cp > 0) & (cp < 0x110000) & ~cp.between(0xD800, 0xDFFF)
        named = F.coalesce(F.element_at(table, x), *([F.element_at(own, x)] if own is not None else []), x)
        return F.when(~x.startswith("&"), x).when(x.startswith("&#"), F.when(fine, _utf16(cp)).otherwise(x)).otherwise(named)

    return F.when(s.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(s)


def escape_text(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(s: Column) -> Column:
    return F.replace(F.replace(escape_text(s), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))
