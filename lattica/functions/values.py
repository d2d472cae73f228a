"""Field values: one tagged struct for every kind, and the text forms that merging and signing need."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # number, string, boolean, null, ref or json
        T.StructField("num", T.DoubleType()),
        T.StructField("str", T.StringType()),  # of a ref: the soul it points to
        T.StructField("bool", T.BooleanType()),
        T.StructField("json", T.StringType()),
    ]
)


def value(kind: str, num: Column | None = None, text: Column | None = None, boolean: Column | None = None, raw: Column | None = None) -> Column:
    parts = {"kind": F.lit(kind), "num": num, "str": text, "bool": boolean, "json": raw}
    kinds = {f.name: f.dataType for f in VALUE}
    return F.struct(*((F.lit(None) if c is None else c).cast(kinds[n]).alias(n) for n, c in parts.items()))


def number(c: Column) -> Column:
    return F.when(c.isNull(), value("null")).otherwise(value("number", num=c))


def string(c: Column) -> Column:
    return F.when(c.isNull(), value("null")).otherwise(value("string", text=c))


def ref(c: Column) -> Column:
    return F.when(c.isNull(), value("null")).otherwise(value("ref", text=c))


def null() -> Column:
    return value("null")


def from_variant(v: Column) -> Column:
    """The tagged struct of a VARIANT; an object with the one key '#' and a string in it is a reference."""
    kind = F.schema_of_variant(v)
    text = F.to_json(v)
    soul = F.try_variant_get(v, "$['#']", "string")
    is_ref = kind.rlike("^OBJECT<`?#`?: STRING>$")
    return (
        F.when(v.isNull() | (kind == "VOID"), value("null"))
        .when(kind == "STRING", value("string", text=F.try_variant_get(v, "$", "string")))
        .when(kind == "BOOLEAN", value("boolean", boolean=F.try_variant_get(v, "$", "boolean")))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), value("number", num=F.try_variant_get(v, "$", "double")))
        .when(is_ref, value("ref", text=soul))
        .otherwise(value("json", raw=text))
    )


def js_number_to_string(c: Column) -> Column:
    """String(number) of JavaScript: 1 for 1.0, plain digits from 1e-6 up to 1e21, else 1e-7 or 1.5e+21."""
    text = F.abs(c).cast("string")
    mantissa = F.regexp_extract(text, r"^([0-9.]+)", 1)
    exponent = F.when(text.contains("E"), F.expr("0") + F.try_to_number(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("S999")).cast("int")).otherwise(0)
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.regexp_replace(F.split_part(mantissa, F.lit("."), F.lit(2)), "0+$", "")
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    lead = F.length(F.concat(whole, part)) - F.length(digits)
    point = F.length(whole) + exponent - lead  # digits before the decimal point
    digits = F.regexp_replace(digits, "0+$", "")
    n = F.length(digits)
    plain = (
        F.when(point >= n, F.rpad(digits, point, "0"))
        .when(point > 0, F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
    )
    e = point - 1
    scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(e > 0, "+").otherwise(""), e.cast("string"))
    body = F.when((point > 21) | (point < -5), scientific).otherwise(plain)
    return (
        F.when(c.isNull(), None)
        .when(F.isnan(c), "NaN")
        .when(c == 0, "0")
        .when(F.abs(c) == float("inf"), F.when(c > 0, "Infinity").otherwise("-Infinity"))
        .otherwise(F.concat(F.when(c < 0, "-").otherwise(""), body))
    )


def canonical_value(v: Column, numbers: bool = True) -> Column:
    """The text that decides ties: '#' and the soul of a reference, JSON of what is nested, else the value's own text.

    numbers: whether numbers have one too; it is a long expression, which callers that never need it leave out.
    """
    own = F.when(v["kind"] == "ref", F.concat(F.lit("#"), v["str"])).when(v["kind"] == "json", v["json"])
    own = own.when(v["kind"] == "number", js_number_to_string(v["num"])) if numbers else own
    return (
        own.when(v["kind"] == "boolean", v["bool"].cast("string"))
        .when(v["kind"] == "null", "null")
        .otherwise(v["str"])
    )


def js_number(x: float | int) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    x = float(x)
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    head, _, tail = repr(abs(x)).partition("e")
    whole, _, part = head.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(tail or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    sign = "-" if x < 0 else ""
    if point > 21 or point < -5:
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if point > 1 else ''}{point - 1}"
    if point >= len(digits):
        return sign + digits.ljust(point, "0")
    if point > 0:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    return f"{sign}0.{'0' * -point}{digits}"


def canonical_json_text(x) -> str:
    """JSON with the keys of every object sorted and numbers as JavaScript writes them."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json_text(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(canonical_json_text, x)) + "]"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return js_number(x)
    return json.dumps(x, ensure_ascii=False)


def canonical_json(text: Column) -> Column:
    """Canonical form of JSON texts; null for null and for what does not parse."""

    def one(t):
        try:
            return None if t is None else canonical_json_text(json.loads(t))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)
