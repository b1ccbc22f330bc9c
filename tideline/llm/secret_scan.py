"""Secret scans with DataFrame functions only.

Base rules find assignments, access keys and long hex runs. Beside them, candidate strings of a character class (hex,
base64) are read by a sliding window whose Shannon entropy is kept by incremental counts: a character that enters or
leaves changes one count and one term of the sum. Windows of high entropy are joined into spans, unless the candidate is
on the allow list or a base span holds them already.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import aside, back, text_or_empty


@dataclass(frozen=True)
class Base:
    kind: str
    pattern: str
    group: int
    least: int  # characters of that group; a match with fewer is dropped, but what it covers stays covered


BASE = (
    Base("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Base("access", r"AKIA[A-Z0-9]+", 0, 18),
    Base("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
)


@dataclass(frozen=True)
class CharClass:
    kind: str
    alphabet: str
    window: int
    bits: float  # least entropy of a window

    @property
    def pattern(self) -> str:
        chars = "[" + "".join(c if c.isalnum() else "\\" + c for c in self.alphabet) + "]"
        return f"(?<!{chars}){chars}{{{self.window},}}"


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", _DIGITS + "abcdefABCDEF", 20, 3.0),
    CharClass("entropy_base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_=-", 20, 3.8),
)
#: Candidates that are no secrets: words and words joined by signs, but not letters that change case as random ones do
#: (a capital, one or two small letters, a capital again); numbers; UUIDs; keys that end in the mark of documentation. No
#: repeated group may backtrack, as the JVM's stack would not hold that on long candidates.
ALLOWED = (
    r"^(?!.*[a-z][A-Z]{1,2}[a-z]{1,2}[A-Z])[A-Za-z+/_=-]*[A-Za-z][+/_=-]*$",
    r"^[0-9]++(?:[-/_][0-9]++)*+$",
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"EXAMPLE(?:KEY)?$",
)
# A fold copies its state at every step, so a state holds a few numbers and never a list that grows with the text.
BLOCK = 32  # values that are summed one by one
SEGMENT = 256  # windows of a candidate that are read in one fold
UNIT = 1 << 32  # entropy terms are whole numbers of this unit, so sums are exact
CHUNK = 1024  # code points that a text is cut into where parts of it are taken


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column, joined: Callable[[Column, Column], Column], depth: int = 2) -> Column:
    """For each of an array of whole numbers what `joined` (a sum, a maximum) makes of 0 and all before it: blocks first,
    then blocks of blocks, then the values after their block's start."""

    def of(known: Column) -> Column:
        fold = lambda low, high: F.aggregate(F.sequence(low, high), F.lit(0), lambda acc, j: joined(acc, F.get(known, j)))
        within = lambda i, low: F.when(i == low, 0).otherwise(fold(low, i - 1))
        if not depth:
            return F.transform(known, lambda x, i: within(i, F.lit(0)))
        last = F.size(known) - 1
        totals = F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), lambda k: fold(k * BLOCK, F.least(k * BLOCK + BLOCK - 1, last)))
        return let(before(totals, joined, depth - 1), lambda held: F.transform(known, lambda x, i: joined(F.get(held, F.floor(i / BLOCK).cast("int")), within(i, i - i % BLOCK))))

    return let(values, lambda known: F.when(F.size(known) > 0, of(known)).otherwise(F.expr("CAST(array() AS array<int>)")))


def found(text: Column, pattern: str, group: int) -> Column:
    """Leftmost matches that don't overlap: array of (start, text of the group, length of the match), in code points.

    The pieces between the matches and the matches themselves lie end to end, so their lengths give the positions. A group
    is taken from the match alone."""
    part = lambda m: F.regexp_extract(m, pattern, group) if group else m

    def placed(matches: Column, gaps: Column) -> Column:
        ends = before(F.transform(matches, lambda m, i: F.get(gaps, i) + F.length(m)), lambda x, y: x + y)
        start = lambda known, i: F.get(known, i) + F.get(gaps, i)
        return let(ends, lambda known: F.transform(matches, lambda m, i: F.struct(start(known, i).alias("start"), part(m).alias("part"), F.length(m).alias("size"))))

    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: let(gaps, lambda known: placed(matches, known)))
    return F.when(text.rlike(pattern), every).otherwise(F.expr("CAST(array() AS array<struct<start:int,part:string,size:int>>)"))


def surprising(s: Column, c: CharClass) -> Column:
    """Joined windows of s, of c.window characters or more, whose entropy is at least c.bits: array of (begin, end).

    f is the sum of n * log2(n) over the characters' counts n in the window; the entropy is log2(w) - f / w. The counts
    are fields of a few bits in longs: a character that enters or leaves adds or takes one unit of its field, and f
    changes by one entry of a table. Each segment of a long candidate starts its counts anew."""
    w, bits = c.window, c.window.bit_length()
    fields = 62 // bits
    terms = [round(UNIT * n * math.log2(n)) if n else 0 for n in range(w + 1)]
    gains = F.array(*(F.lit(b - a).cast("long") for a, b in zip(terms, terms[1:], strict=False)))
    most = math.floor(UNIT * w * (math.log2(w) - c.bits))
    shift = lambda way, value, by: F.call_function(way, value, by)

    def field(k: Column) -> Column:
        by = (k % fields * bits).cast("int")
        return F.struct(F.floor(k / fields).cast("int").alias("word"), by.alias("by"), shift("shiftleft", F.lit(1).cast("long"), by).alias("one"))

    def step(codes: Column, first: Column, acc: Column, i: Column) -> Column:
        count = lambda x: shift("shiftright", F.get(acc["counts"], x["word"]), x["by"]).bitwiseAND((1 << bits) - 1).cast("int")

        def moved(move: Column) -> Column:
            into, out = move["into"], move["out"]  # out is null until the window is full
            same = F.coalesce((into["word"] == out["word"]) & (into["one"] == out["one"]), F.lit(False))
            change = F.get(gains, count(into)) - F.coalesce(F.get(gains, count(out) - 1), F.lit(0))
            counts = F.transform(acc["counts"], lambda n, j: n + F.when(j == into["word"], into["one"]).otherwise(0) - F.when(j == out["word"], out["one"]).otherwise(0))

            def with_sum(f: Column) -> Column:
                high = (i >= first + w) & (f <= most)
                joins = high & (i - w <= acc["end"])
                opened = high & ~joins & (acc["end"] > 0)
                return F.struct(
                    F.when(same, acc["counts"]).otherwise(counts).alias("counts"),
                    f.alias("f"),
                    F.when(high & ~joins, i - w).otherwise(acc["begin"]).alias("begin"),
                    F.when(high, i).otherwise(acc["end"]).alias("end"),
                    F.when(opened, F.concat(acc["done"], ended(acc))).otherwise(acc["done"]).alias("done"),
                )

            return let(F.when(same, acc["f"]).otherwise(acc["f"] + change), with_sum)

        return let(F.struct(F.get(codes, i - 1).alias("into"), F.when(i > first + w, F.get(codes, i - w - 1)).alias("out")), moved)

    ended = lambda acc: F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end")))
    codes = F.transform(F.split(s, ""), lambda x: let(F.instr(F.lit(c.alphabet), x) - 1, field))  # one pass over the characters
    words = F.array_repeat(F.lit(0).cast("long"), -(-len(c.alphabet) // fields))
    none = F.expr("CAST(array() AS array<struct<begin:int,end:int>>)")
    zero = F.struct(words.alias("counts"), F.lit(0).cast("long").alias("f"), F.lit(0).alias("begin"), F.lit(-1).alias("end"), none.alias("done"))
    last = lambda acc: F.when(acc["end"] > 0, F.concat(acc["done"], ended(acc))).otherwise(acc["done"])

    def segment(known: Column, first: Column) -> Column:
        """The windows that begin at first or up to SEGMENT - 1 later."""
        to = F.least(first + SEGMENT + w - 1, F.size(known))
        return F.aggregate(F.sequence(first + 1, to), zero, lambda acc, i: step(known, first, acc, i), last)

    firsts = lambda known: F.sequence(F.lit(0), F.size(known) - w, F.lit(SEGMENT))
    return touching(let(codes, lambda known: F.flatten(F.transform(firsts(known), lambda first: segment(known, first)))))


def touching(spans: Column) -> Column:
    """Spans (begin, end), both ascending, with those joined that overlap or touch."""

    def of(known: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(known) - 1), lambda j: (j == 0) | (F.get(known, j)["begin"] > F.get(known, j - 1)["end"]))
        end = lambda at, k: F.get(known, F.coalesce(F.get(at, k + 1), F.size(known)) - 1)["end"]
        return let(opens, lambda at: F.transform(at, lambda j, k: F.struct(F.get(known, j)["begin"].alias("begin"), end(at, k).alias("end"))))

    return let(spans, lambda known: F.when(F.size(known) > 1, of(known)).otherwise(known))


def reach(spans: Column) -> Column:
    """For each of an array of spans the furthest end of those before it."""
    return before(F.transform(spans, lambda x: x["end"]), lambda x, y: F.greatest(x, y))


def outside(spans: Column, ranks: int) -> Column:
    """Spans, in order, without those of rank `ranks` or more that lie inside one of a lower rank. Such a holder starts no
    later, so it comes first, and the furthest end so far decides."""
    ends = before(F.transform(spans, lambda x: F.when(x["rank"] < ranks, x["end"]).otherwise(0)), lambda x, y: F.greatest(x, y))
    return let(ends, lambda held: F.filter(spans, lambda x, i: (x["rank"] < ranks) | (x["end"] > F.get(held, i))))


def taken(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text that is cut into chunks; only the chunks that hold them are read."""
    low = lambda k: F.greatest(start - k * CHUNK, F.lit(0))
    part = lambda k: F.substring(F.get(chunks, k), low(k) + 1, F.least(end - k * CHUNK, F.lit(CHUNK)) - low(k))
    held = F.sequence(F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int"))
    return F.when(end > start, F.array_join(F.transform(held, part), "")).otherwise("")


def scan(docs: DataFrame, base: tuple[Base, ...] = BASE, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with `base_spans` and `spans`: arrays of (start, rank, end, kind) by start, then kind as listed; code points
    of the whole text, end exclusive.

    A null or empty text has no spans, an empty table gives none. Repeated rows are scanned alike; spans that start alike
    stay in the order of their kinds, and a span of one kind doesn't take anything from another's. Other columns stay,
    and one with the name of an added column is replaced. Row by row: no shuffle, no state beyond a text's own matches.
    """
    span = lambda start, rank, end, kind: F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))
    docs = docs.drop("base_spans", "spans")
    work, text = aside(docs, "text").withColumn("whole", text_or_empty()), F.col("whole")
    work = work.withColumns({f"b{k}": found(text, b.pattern, b.group) for k, b in enumerate(base)} | {f"c{k}": found(text, c.pattern, 0) for k, c in enumerate(classes)})

    def base_of(k: int, b: Base) -> Column:
        long_enough = F.filter(F.col(f"b{k}"), lambda m: F.length(m["part"]) >= b.least)
        return F.transform(long_enough, lambda m: span(m["start"], k, m["start"] + m["size"], b.kind))

    def added(k: int, c: CharClass) -> Column:
        listed_out = F.lit("|".join(f"(?:{a})" for a in allowed))
        candidates = F.filter(F.col(f"c{k}"), lambda m: ~F.rlike(m["part"], listed_out)) if allowed else F.col(f"c{k}")
        each = lambda m: F.transform(surprising(m["part"], c), lambda s: span(m["start"] + s["begin"], len(base) + k, m["start"] + s["end"], c.kind))
        return F.flatten(F.transform(candidates, each))

    work = work.withColumn("base_spans", F.array_sort(F.concat(*(base_of(k, b) for k, b in enumerate(base)))))
    more = [added(k, c) for k, c in enumerate(classes)]
    work = work.withColumn("spans", let(F.array_sort(F.concat(F.col("base_spans"), *more)), lambda every: outside(every, len(base))))
    return work.select(*back(work, docs.columns, "text"), "base_spans", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs' rows and columns with every span, overlapping ones joined, replaced by `mark`; n_chars follows if present.
    A text without spans stays as it is, a null text null; an empty table gives none."""
    piece = lambda start, end: F.struct(start.alias("start"), end.alias("end"))

    def kept(spans: Column) -> Column:
        """What lies between joined spans, and what is left after the last."""
        gap = lambda ends: F.filter(F.transform(spans, lambda x, i: piece(F.get(ends, i), x["start"])), lambda x: x["start"] <= x["end"])
        return F.concat(let(reach(spans), gap), F.array(piece(F.array_max(F.transform(spans, lambda x: x["end"])), F.length("text"))))

    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    whole = let(chunks, lambda known: F.array_join(F.transform(let(F.col("spans"), kept), lambda x: taken(known, x["start"], x["end"])), mark))
    changed = scan(aside(docs, "text")).withColumn("hit", F.size("spans") > 0)
    changed = changed.withColumn("text", F.when(F.col("hit"), whole).otherwise(F.col("text")))
    columns = dict(zip(docs.columns, back(changed, docs.columns, "text"), strict=True))
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"]).alias("n_chars")
    return changed.select(*columns.values())
