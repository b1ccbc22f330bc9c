"""Scalar functions: loosely typed values, markers, paths, levels. All are Column builders that stay in the JVM."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MARKERS = {"nan": math.nan, "inf": math.inf, "-inf": -math.inf}
MIN_LEVEL, MAX_LEVEL, BLOCK = -20, 62, 256


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_marker(c: Column | str) -> Column:
    """The non-finite number that a marker text stands for."""
    c = col(c)
    return F.when(c == "nan", math.nan).when(c == "inf", math.inf).when(c == "-inf", -math.inf)


def to_marker(c: Column | str) -> Column:
    """The marker text of a non-finite number, null for others."""
    c = col(c)
    return F.when(F.isnan(c), "nan").when(c == math.inf, "inf").when(c == -math.inf, "-inf")


def finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf)


def number_of_text(c: Column | str) -> Column:
    """A text's number if all of it, but spaces around it, is one or a marker; else null."""
    c = col(c)
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.coalesce(from_marker(c), F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double")))


def text_of_number(c: Column | str) -> Column:
    """Whole numbers below 1e16 without a point, others in their shortest form (exponents from 1e16 and below 1e-4)."""
    c = col(c).cast("double")
    raw = c.cast("string")
    parts = F.regexp_extract(raw, r"^(-?[\d.]+)E(-?\d+)$", 1), F.regexp_extract(raw, r"^(-?[\d.]+)E(-?\d+)$", 2)
    mantissa = F.regexp_replace(parts[0], r"\.0$", "")
    power = parts[1].try_cast("int")
    scientific = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    plain = F.regexp_replace(F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", "")
    size = F.abs(c)
    return (
        F.when(to_marker(c).isNotNull(), to_marker(c))
        .when((size < 1e16) & (c == F.floor(c)), c.cast("long").cast("string"))
        .when(~raw.contains("E"), raw)
        .when((size >= 1e16) | (size < 1e-4), scientific)
        .otherwise(plain)
    )


def let(v: Column, body: Callable[[Column], Column]) -> Column:
    """body(v), with v computed once; a filter would otherwise compute it wherever body names it."""
    return F.get(F.transform(F.array(v), body), F.lit(0))


def scalar(v: Column) -> Column:
    """Kind, number and text of a variant that is no list; null for a missing or JSON null one."""

    def parts(x: Column) -> Column:
        kind, text, number = x["kind"], x["text"], x["number"]
        numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")
        return F.struct(
            F.when(numeric, "number").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("json").alias("kind"),
            F.when(numeric, number).when(kind == "STRING", number_of_text(text)).alias("num"),
            F.when(numeric, text_of_number(number)).when(kind.isin("STRING", "BOOLEAN"), text).otherwise(F.to_json(v)).alias("text"),
        )

    read = F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text"), F.try_variant_get(v, "$", "double").alias("number"))
    return F.when(v.isNotNull() & ~F.is_variant_null(v), let(read, parts))


def value(v: Column | str) -> Column:
    """A variant's elements as an array of (kind, num, text): one for a scalar, each that isn't null for a list; null if
    the value is missing. All predicates read this."""

    def elements(v: Column) -> Column:
        listed = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), scalar), lambda x: x.isNotNull())
        return F.when(v.isNull() | F.is_variant_null(v), None).when(F.schema_of_variant(v).startswith("ARRAY"), listed).otherwise(F.array(scalar(v)))

    return let(col(v), elements)


def text_value(c: Column | str) -> Column:
    c = col(c).cast("string")
    return F.when(c.isNotNull(), F.array(F.struct(F.lit("string").alias("kind"), number_of_text(c).alias("num"), c.alias("text"))))


def number_value(c: Column | str) -> Column:
    c = col(c).cast("double")
    return F.when(c.isNotNull(), F.array(F.struct(F.lit("number").alias("kind"), c.alias("num"), text_of_number(c).alias("text"))))


def list_value(c: Column | str) -> Column:
    one = lambda x: F.struct(F.lit("string").alias("kind"), number_of_text(x).alias("num"), x.alias("text"))
    return F.transform(F.filter(col(c), lambda x: x.isNotNull()), one)


def as_number(v: Column) -> Column:
    """The number of a value: its own, or that of a text; never of a boolean or a list."""
    return F.when(F.size(v) == 1, F.get(v, F.lit(0))["num"])


def text_of(v: Column) -> Column:
    return F.when(F.size(v) == 1, F.get(v, F.lit(0))["text"]).when(v.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.when(x["kind"] == "string", F.to_json(F.array(x["text"])).substr(F.lit(2), F.length(F.to_json(F.array(x["text"]))) - 2)).otherwise(x["text"])), ","), F.lit("]")))


PLAIN = {"path": text_value, "name": text_value, "parent": text_value, "state": text_value, "step": number_value, "runtime": number_value, "rows": number_value, "media": number_value, "created": number_value, "updated": number_value, "tags": list_value, "dir": text_value}


def field(name: str) -> Column:
    """The value of a run record's field: a plain one, config.K (c.), summary.K (s., metric., m.), info.A.B (the whole
    dotted key first), or a bare key: config if it has it, even as null, else summary."""
    head, _, rest = name.partition(".")
    if name in PLAIN:
        return PLAIN[name](name)
    if rest and head in ("config", "c"):
        return value(F.col("config")[rest])
    if rest and head in ("summary", "s", "metric", "m"):
        return value(F.col("summary")[rest])
    if rest and head == "info":
        step = lambda key: "[" + json.dumps(key) + "]"
        whole = F.try_variant_get("info", "$" + step(rest), "variant")
        nested = F.try_variant_get("info", "$" + "".join(map(step, rest.split("."))), "variant")
        return value(F.coalesce(whole, nested))
    has = F.coalesce(F.map_contains_key("config", F.lit(name)), F.lit(False))
    return value(F.when(has, F.col("config")[name]).otherwise(F.col("summary")[name]))


# ---- paths ----


def parent(path: Column | str) -> Column:
    return ancestor(path, 1)


def leaf(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def ancestor(path: Column | str, up: int) -> Column:
    """The directory `up` levels above a run, "" beyond the root."""
    parts = F.split(col(path), "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0))), "/")


def relative(path: Column | str, prefix: str) -> Column:
    path = col(path)
    if not prefix:
        return F.when(path == "", ".").otherwise(path)
    return F.when(path == prefix, ".").when(path.startswith(prefix + "/"), F.substr(path, F.lit(len(prefix) + 2))).otherwise(path)


def in_scope(path: Column | str, prefix: str) -> Column:
    path = col(path)
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def ancestors(path: Column | str) -> Column:
    """All folders above a path and itself, the root "" first."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def section_of(key: Column | str) -> Column:
    """The section that a metric's chart stands in: its key without the last part, "charts" if it has one part."""
    parts = F.split(col(key), "/")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise("charts")


def natural_key(c: Column | str) -> Column:
    """Sorts texts with their numbers by size: digits, without leading zeros, follow their own number, which has 10 places,
    so numbers of any length compare as numbers."""
    number = lambda x: F.concat(F.lpad(F.char_length(x).cast("string"), 10, "0"), x)
    digits = lambda x: number(F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(col(c)), F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), digits(x)).otherwise(x)), "")


# ---- levels ----


def level_for(span: Column | str) -> Column:
    """The finest level whose blocks are at least `span` steps wide. The logarithm is put right by exact powers."""
    span = col(span).cast("double")
    guess = F.ceil(F.log2(span / BLOCK))
    width = lambda level: F.pow(F.lit(2.0), level.cast("double")) * BLOCK
    exact = F.when(width(guess - 1) >= span, guess - 1).when(width(guess) < span, guess + 1).otherwise(guess)
    return F.when(span > 0, F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(MIN_LEVEL), F.coalesce(exact, F.lit(MAX_LEVEL))))).otherwise(0).cast("int")


def bucket_of(step: Column | str, level: Column | int) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.floor(col(step) / F.pow(F.lit(2.0), level.cast("double"))).cast("long")


def blocks(level: Column | int, lo: Column | str, hi: Column | str) -> Column:
    """The blocks of a level that cover the steps from lo to hi."""
    level = F.lit(level) if isinstance(level, int) else level
    width = F.pow(F.lit(2.0), level.cast("double")) * BLOCK
    return F.sequence(F.floor(col(lo) / width), F.floor(col(hi) / width))


def smooth_scale(span: Column | str) -> Column:
    """A thousandth of the span, rounded to a power of two, ties to even; 1 if there is no span."""
    span = col(span)
    return F.when(span > 0, F.pow(F.lit(2.0), F.rint(F.log2(span / 1000)))).otherwise(1.0)


def log_x(c: Column | str) -> Column:
    c = col(c)
    return F.when(c > 0, F.log10(c))


def quoted(pattern: str) -> str:
    """The pattern, or its literal text if it is no regular expression."""
    try:
        re.compile(pattern)
        return pattern
    except re.error:
        return re.escape(pattern)
