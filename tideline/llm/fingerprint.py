"""Document fingerprints: a Merkle tree over a text's sections and paragraphs, by SQL functions alone.

A section ends with a run of blank lines, a paragraph with a line's end. A paragraph's digest is that of its text, a
section's that of its paragraphs' digests, and the root's that of the sections'. Equal roots mean equal texts, and
branches whose digests differ hold the edits. So that an edit within a long paragraph doesn't make all of it new, a
paragraph also has marks: digests of its sentences, or of 128 code points where no sentence ends before.

The fingerprint is the tree as one line: `root:section,paragraph.mark.mark,paragraph...;section...`, where branches are
shortened to 8 digits and a mark is 9 digits of its digest and 3 of its length, all hexadecimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import aside, back, text_or_empty, written
from tideline.plans.shared import in_order, previous

SECTION_ENDS = r"(?<=\n\n)(?!\n)"
PARAGRAPH_ENDS = r"(?<=\n)(?!\n)"
SENTENCE = r"(?s).{0,126}?[.!?][ \t\n]|.{1,128}"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def parts(text: Column, ends: str) -> Column:
    return F.filter(F.split(text, ends, -1), lambda x: x != "")


def marks(paragraph: Column) -> Column:
    size = lambda m: F.lpad(F.lower(F.hex(F.char_length(m))), 3, "0")
    return F.transform(F.regexp_extract_all(paragraph, F.lit(SENTENCE), F.lit(0)), lambda m: F.concat(F.substring(sha(m), 1, 9), size(m)))


def tree(text: Column) -> Column:
    """The whole tree: root, and sections (digest, paragraphs (digest, size in code points, marks))."""
    paragraph = lambda p: F.struct(sha(p).alias("digest"), F.char_length(p).alias("size"), marks(p).alias("marks"))
    digests = lambda nodes: sha(F.array_join(F.transform(nodes, lambda n: n["digest"]), ""))
    with_digest = lambda ps: F.struct(digests(ps).alias("digest"), ps.alias("paragraphs"))
    sections = F.transform(F.transform(parts(text, SECTION_ENDS), lambda s: F.transform(parts(s, PARAGRAPH_ENDS), paragraph)), with_digest)
    return F.transform(F.array(sections), lambda s: F.struct(digests(s).alias("root"), s.alias("sections")))[0]


def line(of: Column) -> Column:
    """A tree as a fingerprint."""
    paragraph = lambda p: F.array_join(F.concat(F.array(F.substring(p["digest"], 1, 8)), p["marks"]), ".")
    section = lambda s: F.array_join(F.concat(F.array(F.substring(s["digest"], 1, 8)), F.transform(s["paragraphs"], paragraph)), ",")
    return F.concat(of["root"], F.lit(":"), F.array_join(F.transform(of["sections"], section), ";"))


def fingerprint(text: Column) -> Column:
    """A text's fingerprint; a null text is an empty one."""
    return line(tree(F.coalesce(text, F.lit(""))))


def likeness(a: Column, b: Column) -> Column:
    """How much of two texts is alike, from their fingerprints: 1 if the roots are equal, else twice the length of the
    distinct marks that both have, divided by that of the marks of each; so 0 if they share no sentence."""
    found = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"\.([0-9a-f]{12})"), F.lit(1)))
    size = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, m: n + F.conv(F.substring(m, 10, 3), 16, 10).cast("long"))
    both = F.transform(F.array(F.struct(found(a).alias("a"), found(b).alias("b"))), lambda m: 2.0 * size(F.array_intersect(m["a"], m["b"])) / (size(m["a"]) + size(m["b"])))[0]
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(both)


def edits(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Where the text of the column `new` differs from that of `old`: a row for each differing branch of it, with the other
    columns of pairs and section, paragraph (both from 0), size (code points). Sections whose digest the old tree has are
    passed by without a look at their paragraphs. Equal texts give none; a null text is an empty one."""
    rest = [c for c in pairs.columns if c not in (old, new)]
    work = aside(pairs, old, new)
    held = work.select("row", tree(text_or_empty(old)).alias("_old"), tree(text_or_empty(new)).alias("_new")).where("_old.root <> _new.root")
    sections = held.select("row", F.col("_old.sections").alias("_old"), F.posexplode("_new.sections").alias("section", "_s"))
    other = sections.where(~F.array_contains(F.transform("_old", lambda s: s["digest"]), F.col("_s.digest")))
    known = F.flatten(F.transform("_old", lambda s: F.transform(s["paragraphs"], lambda p: p["digest"])))
    found = other.select("row", known.alias("_known"), "section", F.posexplode("_s.paragraphs").alias("paragraph", "_p")).where(~F.array_contains("_known", F.col("_p.digest")))
    return found.select(*back(found, rest), "section", "paragraph", F.col("_p.size").alias("size"))


def with_next(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) as distinct rows, `key` and `check` (128 bits of hashes of both), each with how many copies it has
    and the row that comes next: the order is by falling doc_id (null last; ties by the hashes), and the first comes after
    the last. Second: the distinct texts by key, to be shuffled once for whatever joins them."""
    text = text_or_empty()
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text, F.col("doc_id").isNull()).alias("key"), F.xxhash64(text, "doc_id").alias("check"))
    narrow = keyed.select("doc_id", "key", "check", F.char_length("text").cast("long").alias("n_chars")).groupBy("key", "check").agg(F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    order = [F.asc_nulls_first("doc_id"), F.asc("key"), F.asc("check")]
    placed = previous(in_order(narrow, [], *order), [], "key", "check").drop("_part", "_at")
    first = placed.orderBy(F.desc_nulls_last("doc_id"), F.desc("key"), F.desc("check")).limit(1).select(F.struct("key", "check").alias("_first"))  # one row
    links = placed.crossJoin(F.broadcast(first)).withColumn("_prev", F.coalesce("_prev", "_first"))
    links = written(links.select("key", "check", "doc_id", "n_chars", "copies", F.col("_prev.key").alias("next_key"), F.col("_prev.check").alias("next_check")), "next-documents")
    return links, keyed.groupBy("key", "check").agg(F.first("text").alias("text"))


def compared(df: DataFrame) -> DataFrame:
    """What `edited_likeness` returns and `times`, from doc_id, n_chars, text, print, next_part, next_print and times."""
    kept = F.substr("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    made = df.select("doc_id", "n_chars", "print", "next_print", F.concat(kept, "next_part").alias("edited"), "times")
    made = made.select("doc_id", "n_chars", "print", "next_print", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"), "times")
    return made.select("doc_id", "n_chars", "edited_sha256", F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"), "times")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text) its fingerprint and those of an edited text, whose last half is replaced by the
    beginning of the next document, and of that next document, with the likeness to each.

    A null text is empty; a null doc_id comes last; rows of one doc_id are ordered by hashes of their texts, and a repeated
    row's next one is itself but for the last of them. A single row comes next to itself; an empty table gives none. Texts
    are shuffled once, by hashes; the next document's part and fingerprint once more. Of rows that are repeated one is
    worked on, and results of those that make up more than a thousandth of the table are spread over tasks."""
    links, texts = with_next(docs)
    total = links.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    many = max(2, -(-total // 1000))
    wanted = links.select(F.col("next_key").alias("key"), F.col("next_check").alias("check"), F.struct("key", "check").alias("to"), F.floor(F.col("n_chars") / 2).cast("int").alias("size"))
    sent = texts.join(wanted, ["key", "check"]).select("to.key", "to.check", F.substr("text", F.lit(1), F.col("size")).alias("next_part"), fingerprint(F.col("text")).alias("next_print"))
    own = texts.join(links, ["key", "check"]).join(sent, ["key", "check"]).withColumn("print", fingerprint(F.col("text")))
    half = F.substr("text", F.lit(1), F.floor(F.col("n_chars") / 2).cast("int"))
    again = F.when(F.col("copies") < many, F.col("copies") - 1).otherwise(0)
    ways = F.array(F.struct("next_part", "next_print", F.lit(1).cast("long").alias("times")), F.struct(half.alias("next_part"), F.col("print").alias("next_print"), again.alias("times")))
    ways = F.filter(ways, lambda w: w["times"] > 0)
    once = compared(own.select("doc_id", "n_chars", "text", "print", F.explode(ways).alias("w")).select("doc_id", "n_chars", "text", "print", "w.*"))
    hot = links.where(F.col("copies") >= many).select("key", "check", "doc_id", "n_chars", (F.col("copies") - 1).alias("left"))  # a thousand rows at most
    repeated = texts.join(F.broadcast(hot), ["key", "check"]).withColumn("print", fingerprint(F.col("text")))
    repeated = compared(repeated.select("doc_id", "n_chars", "text", "print", half.alias("next_part"), F.col("print").alias("next_print"), F.col("left").alias("times")))
    share = repeated.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / many)))).repartition("doc_id", "share")
    spread = share.withColumn("times", F.least(F.lit(many), F.col("times") - F.col("share") * many)).select(once.columns)
    return once.unionByName(spread).withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def _print_sql(text: str) -> str:
    """DuckDB SQL of the fingerprint; ends of sections and paragraphs are marked by characters of the private use area."""
    cut = lambda x, ends, sign: f"list_filter(string_split(regexp_replace({x}, '({ends})', '\\1{sign}', 'g'), '{sign}'), lambda z: z <> '')"
    mark = r"list_transform(regexp_extract_all(p, '(?s).{0,126}?[.!?][ \t\n]|.{1,128}'), lambda m: substr(sha256(m), 1, 9) || lpad(format('{:x}', length(m)), 3, '0'))"
    paragraphs = f"list_transform({cut('s', chr(10) + '+', chr(0xF8F1))}, lambda p: {{'d': sha256(p), 'm': {mark}}})"
    sections = f"list_transform({cut(text, chr(10) * 2 + '+', chr(0xF8F0))}, lambda s: {paragraphs})"
    joined = lambda x, of: f"array_to_string(list_transform({x}, {of}), '')"
    section_digest = "sha256(coalesce(" + joined("s", "lambda p: p.d") + ", ''))"
    root = f"sha256(coalesce({joined('t', f'lambda s: {section_digest}')}, ''))"
    body = f"array_to_string(list_transform(t, lambda s: substr({section_digest}, 1, 8) || ',' || array_to_string(list_transform(s, lambda p: array_to_string(list_prepend(substr(p.d, 1, 8), p.m), '.')), ',')), ';')"
    return f"(SELECT {root} || ':' || coalesce({body}, '') FROM (SELECT {sections} AS t))"


def _like_sql(a: str, b: str) -> str:
    found = lambda x: f"list_distinct(regexp_extract_all({x}, '\\.([0-9a-f]{{12}})', 1))"
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda m: CAST('0x' || substr(m, 10, 3) AS BIGINT))), 0)"
    return f"CASE WHEN substr({a}, 1, 64) = substr({b}, 1, 64) THEN CAST(1 AS DOUBLE) ELSE CAST(2 * {size(f'list_intersect({found(a)}, {found(b)})')} AS DOUBLE) / ({size(found(a))} + {size(found(b))}) END"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents),
nexts AS (SELECT *, coalesce(lead(text) OVER down, first_value(text) OVER down) AS next FROM d WINDOW down AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next, 1, n_chars // 2) AS edited FROM nexts),
f AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_print_sql('text')} AS fingerprint, {_print_sql('edited')} AS edited_fingerprint, {_print_sql('next')} AS next_fingerprint FROM e)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_like_sql('fingerprint', 'edited_fingerprint')} AS near_edited, {_like_sql('fingerprint', 'next_fingerprint')} AS near_next FROM f
"""
