"""Values: rendering, normalising, comparing. Every choice is made by type when a plan is
built, so comparisons stay plain expressions that scans can push down."""

from __future__ import annotations

import datetime
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Today

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
INTEGER = ("tinyint", "smallint", "int", "bigint")
#: How a missing value reads as text.
MISSING = "<nil>"
_ISO = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def is_number(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


#: A float as text has an exponent from this power of ten on, and below 1e-4.
EXPONENT_FROM = 6


def float_text(col: Column) -> Column:
    """A float as the shortest text that reads back as it: 5, 0.25, 1e+06, 2.5e-07, +Inf."""
    raw = F.regexp_replace(col.cast("string"), "^-", "")
    part = lambda n: F.regexp_extract(raw, r"^(\d+)\.(\d+)(?:E(-?\d+))?$", n)
    whole, rest, power = part(1), part(2), F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))
    digits = F.regexp_replace(F.regexp_replace(F.concat(whole, rest), "^0+", ""), "0+$", "")
    zeros = F.length(F.regexp_extract(rest, "^0*", 0))
    exp = power + F.when(whole != "0", F.length(whole) - 1).otherwise(-zeros - 1)
    n = F.length(digits)
    point = F.when(n > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(digits)
    scientific = F.concat(point, F.when(exp < 0, "e-").otherwise("e+"), F.lpad(F.abs(exp).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exp).cast("string"))), F.lit("0")))
    plain = (
        F.when(exp < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits))
        .when(exp >= n - 1, F.concat(digits, F.repeat(F.lit("0"), exp - n + 1)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, n)))
    )
    text = F.when(digits == "", "0").when((exp < -4) | (exp >= EXPONENT_FROM), scientific).otherwise(plain)
    sign = F.when(F.startswith(col.cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(col), "NaN").when(F.abs(col) == float("inf"), F.when(col > 0, "+Inf").otherwise("-Inf")).otherwise(F.concat(sign, text))


def render(col: Column, kind: str) -> Column:
    """A value as text; floats as ``float_text`` has them."""
    if kind in ("float", "double"):
        return F.when(col.isNotNull(), float_text(col))
    if kind == "string":
        return col
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(col)
    return col.cast("string")


def render_literal(v) -> str:
    if v is None:
        return MISSING
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return "NaN" if math.isnan(v) else "+Inf" if v > 0 else "-Inf"
        mantissa, _, exp = f"{v:.17e}".partition("e") if v == 0 else next(t for t in (f"{v:.{n}e}" for n in range(17)) if float(t) == v).partition("e")
        if v == 0:
            return "-0" if math.copysign(1, v) < 0 else "0"
        power = int(exp)
        if power < -4 or power >= EXPONENT_FROM:
            return f"{mantissa}e{'-' if power < 0 else '+'}{abs(power):02d}"
        return f"{v:.{max(0, len(mantissa.partition('.')[2]) - power)}f}"
    return str(v)


_OPS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _integers(col: Column, op: str, v: float) -> Column:
    """An integer column against a number with a fraction, exactly."""
    if math.isnan(v) or math.isinf(v):
        return _OPS[op](col.cast("double"), F.lit(v))
    if v.is_integer():
        return _OPS[op](col, F.lit(int(v)))
    if op in ("=", "!="):
        return F.lit(op == "!=")
    return col <= F.lit(math.floor(v)) if op in ("<", "<=") else col >= F.lit(math.ceil(v))


def compare(col: Column, kind: str, op: str, value) -> Column:
    """Two-valued comparison: a missing value on either side is false, even for !=."""
    if isinstance(value, Today):
        day = F.date_format(F.date_add(F.current_date(), value.days), "yyyy-MM-dd")
        return F.coalesce(_OPS[op](render(col, kind) if kind not in ("timestamp", "date") else F.date_format(col, "yyyy-MM-dd"), day), F.lit(False))
    if isinstance(value, datetime.date):
        value = value.isoformat()[:10]
    if value is None:
        return F.lit(False)
    if isinstance(value, (list, dict)):
        import json

        out = _OPS[op](F.to_json(col) if kind.startswith(("array", "struct", "map")) else render(col, kind), F.lit(json.dumps(value, separators=(",", ":"))))
    elif isinstance(value, bool):
        out = _OPS[op](col, F.lit(value)) if kind == "boolean" else _OPS[op](render(col, kind), F.lit(render_literal(value)))
    elif isinstance(value, (int, float)):
        if kind in INTEGER:
            out = _integers(col, op, value) if isinstance(value, float) else _OPS[op](col, F.lit(value))
        elif kind in ("float", "double") and isinstance(value, int) and abs(value) > 1 << 53:
            # exact: doubles of that size are whole
            out = _OPS[op](col.cast("decimal(38,0)"), F.lit(value).cast("decimal(38,0)")) if abs(value) < 10**37 else _OPS[op](col, F.lit(float(value)))
        elif is_number(kind):
            out = _OPS[op](col, F.lit(float(value) if kind in ("float", "double") else value))
        else:
            out = _OPS[op](render(col, kind), F.lit(render_literal(value)))
    elif kind in ("timestamp", "timestamp_ntz", "date") and _ISO.match(value):
        out = _OPS[op](col, F.lit(value).cast(kind))
    else:
        out = _OPS[op](render(col, kind), F.lit(value))
    return F.coalesce(out, F.lit(False))


def text_test(col: Column, kind: str, op: str, value: str) -> Column:
    """Substring, prefix and suffix without regard to case; a missing value reads as MISSING
    but for ``text_contains``, which needs a value."""
    text, want = F.lower(render(col, kind)), F.lit(value.lower())
    if op == "text_contains":
        return F.coalesce(F.contains(text, want), F.lit(False))
    text = F.coalesce(text, F.lit(MISSING))
    return {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[op](text, want)


def order_keys(col: Column, kind: str, descending: bool) -> Column:
    """Where missing values sort: after numbers, before booleans, among texts as MISSING."""
    if kind == "string":
        col = F.coalesce(col, F.lit(MISSING))
        return col.desc() if descending else col.asc()
    first = kind == "boolean"
    if descending:
        return col.desc_nulls_last() if first else col.desc_nulls_first()
    return col.asc_nulls_first() if first else col.asc_nulls_last()


def normal_name(col: Column) -> Column:
    """A property name: trimmed, white-space runs as one space, lower case."""
    return F.lower(F.regexp_replace(F.trim(col), r"\s+", " "))


def normal_tag(col: Column) -> Column:
    """A tag: one leading # off, then as a name; null where nothing is left."""
    out = normal_name(F.regexp_replace(F.trim(col), "^#", ""))
    return F.when(out != "", out)


def normal_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, normal_tag), lambda t: t.isNotNull()))


def tag_text(tag: str) -> str:
    t = tag.strip()
    return re.sub(r"\s+", " ", (t[1:] if t.startswith("#") else t).strip()).lower()


def has_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(normal_tags(tags), tag_text(tag)), F.lit(False))


def tags_any(tags: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(normal_tags(tags), F.array(*[F.lit(tag_text(t)) for t in wanted])), F.lit(False))


def tags_all(tags: Column, wanted: list[str]) -> Column:
    want = list(dict.fromkeys(tag_text(t) for t in wanted))
    return F.coalesce(F.size(F.array_intersect(normal_tags(tags), F.array(*[F.lit(t) for t in want]))) == len(want), F.lit(False))


def truncated(col: Column, unit: str) -> Column:
    """A time or an ISO text cut to its year, month, week, day or hour, as ISO text."""
    out = F.date_trunc(unit, col.cast("timestamp"))
    return F.date_format(out, "yyyy-MM-dd" if unit in ("year", "month", "week", "day") else "yyyy-MM-dd'T'HH:mm:ss")


def cosine(a: Column, b: Column) -> Column:
    """Cosine likeness of two arrays in double; 0 where either has no length."""
    dbl = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(dbl(a), dbl(b), lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(dbl(a), lambda x: x * x))) * F.sqrt(total(F.transform(dbl(b), lambda x: x * x)))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def tokens(text: Column) -> Column:
    """Search tokens: lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def content_id(col: Column) -> Column:
    """Content address of a blob or a source text."""
    return F.sha2(col, 256)


def is_uuid(col: Column) -> Column:
    return F.coalesce(F.rlike(col, F.lit(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")), F.lit(False))


def path_test(col: Column, kind: str, op: str, value) -> Column:
    """Filters on hydrated fields: text comparison, any element of an array, contains
    regards case."""
    if op == "exists":
        return col.isNotNull()
    many = value if isinstance(value, (list, tuple)) else [value]
    want = [render_literal(v) for v in many]
    one = {
        "equals": lambda x: x == F.lit(want[0]),
        "not_equals": lambda x: x == F.lit(want[0]),
        "in": lambda x: x.isin(want),
        "contains": lambda x: F.contains(x, F.lit(want[0])),
    }[op]
    hit = F.exists(col, lambda x: one(x.cast("string"))) if kind.startswith("array") else one(render(col, kind))
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if op == "not_equals" else hit
