"""Two-valued predicates over values: a missing value fails every positive test, and negated forms are exact opposites."""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.values import MARKERS, NUMBER, in_scope, quoted, text_of

Literal = str | bool | int | float | None


def number(lit: Literal) -> float | None:
    if isinstance(lit, bool) or lit is None:
        return None
    if isinstance(lit, str):
        return MARKERS[lit] if lit in MARKERS else float(lit) if re.fullmatch(NUMBER, lit.strip()) else None
    return float(lit)


def plain_text(lit: Literal) -> str:
    if isinstance(lit, str):
        return lit
    if isinstance(lit, bool):
        return str(lit).lower()
    return str(int(lit)) if math.isfinite(lit) and float(lit).is_integer() and abs(lit) < 1e16 else repr(float(lit))


def any_of(value: Column, test: Callable[[Column], Column]) -> Column:
    """Whether one of the elements passes; false if the value is missing."""
    return F.coalesce(F.exists(value, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def is_missing(value: Column) -> Column:
    return value.isNull()


def is_present(value: Column) -> Column:
    return value.isNotNull()


def eq(value: Column, lit: Literal) -> Column:
    """Numbers within a relative 1e-12, anything else by its text; null asks for a missing value."""
    if lit is None:
        return is_missing(value)
    n, text = number(lit), plain_text(lit)
    if n is None:
        return any_of(value, lambda x: x["text"] == text)
    if math.isnan(n):
        same = lambda x: F.lit(False)
    elif math.isinf(n):
        same = lambda x: x["num"] == n
    else:
        same = lambda x: ~F.isnan(x["num"]) & (F.abs(x["num"]) != math.inf) & (F.abs(x["num"] - n) <= 1e-12 * F.greatest(F.abs(x["num"]), F.lit(abs(n))))
    return any_of(value, lambda x: F.when(x["num"].isNotNull(), same(x)).otherwise(x["text"] == text))


def ne(value: Column, lit: Literal) -> Column:
    return ~eq(value, lit)


def ordered(value: Column, lit: Literal, op: Callable) -> Column:
    """Number against number, else text against text; NaN is in no order."""
    n = number(lit)
    by_text = lambda x: (x["kind"] == "string") & op(x["text"], F.lit(lit)) if isinstance(lit, str) else F.lit(False)
    if n is None:
        return any_of(value, by_text)
    by_number = lambda x: ~F.isnan(x["num"]) & op(x["num"], F.lit(n)) if not math.isnan(n) else F.lit(False)
    return any_of(value, lambda x: F.when(x["num"].isNotNull(), by_number(x)).otherwise(by_text(x)))


lt, le, gt, ge = (functools.partial(ordered, op=f) for f in (operator.lt, operator.le, operator.gt, operator.ge))


def isin(value: Column, *lits: Literal) -> Column:
    return functools.reduce(operator.or_, (eq(value, x) for x in lits), F.lit(False))


def like(value: Column, pattern: str) -> Column:
    """% and _ over the whole text, in any case; a backslash is itself."""
    return any_of(value, lambda x: x["text"].ilike(pattern.replace("\\", "\\\\")))


def matches(value: Column, regex: str) -> Column:
    return any_of(value, lambda x: x["text"].rlike("(?i)" + regex))


def search(text: str) -> Column:
    """Free text in a run's name or path; taken literally if it is no regular expression."""
    rx = "(?i)" + quoted(text)
    return F.coalesce(F.col("name").rlike(rx), F.lit(False)) | F.coalesce(F.col("path").rlike(rx), F.lit(False))


def filter_runs(runs: DataFrame, *tests: Column) -> DataFrame:
    return functools.reduce(DataFrame.where, tests, runs)


def which(state: str = "all") -> Column:
    running = F.col("state") == "running"
    return {"all": F.lit(True), "running": running, "finished": ~running}[state]


def keys_matching(key: Column, names: Iterable[str] = (), regex: str | None = None) -> Column:
    named = key.isin(*names) if (names := list(names)) else F.lit(False)
    return named | key.rlike(regex) if regex else named


def between_x(x: Column, since: float | None = None, until: float | None = None) -> Column:
    return (x >= since if since is not None else F.lit(True)) & (x <= until if until is not None else F.lit(True))


def focus(*opened: tuple[Column, str]) -> Column:
    """Runs within opened groups: the text of each level's value is the group's; a missing one is "∅"."""
    return functools.reduce(operator.and_, (F.coalesce(text_of(v), F.lit("∅")) == t for v, t in opened), F.lit(True))


scope = in_scope
