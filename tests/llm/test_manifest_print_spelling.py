"""op11 to op13 against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from tideline.llm import fingerprint, manifest, spelling  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    random.seed(11)
    words = ["alpha", "Beta", "gammas", "naïveté", "日本", "zebra.", "x", "Übermut", "Overview", "overveiw", "overview"]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    out = [(i, text(random.randint(1, 60)) + random.choice(["", "\n", "\n\n\n", ".\n"]) + text(random.randint(0, 30)), random.choice(["en", "de", None, "é"]), random.choice(["a", None]), 5) for i in range(90)]
    out += [(90, None, None, None, None), (91, "", "en", "a", 0), (None, "no id Overview", "en", "a", 5), (None, None, "xx", None, None), (93, "one leaf", "alone", "a", 1), (94, "Z" * 9000 + ("\n" * 5) + text(4000), "en", "a", 1)]
    return out + [out[3]] * 5 + [(3, "another text. " * 9, "en", "a", 2), out[90], out[90]]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)))


def lowered(text):
    return text and text.encode().lower().decode()


def climb(nodes, at):
    """The root over nodes, and the runs that the one numbered `at` lies in: (before, after) of it."""
    path = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        path.append((run[: at % 8], run[at % 8 + 1 :]))
        nodes, at = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return nodes[0], path


def brute_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in order:
        trees[k].sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in trees[k]], 0)[0] for k in order]
    for i, k in enumerate(order):
        root, above = climb(subroots, i)
        for at, (_, _, own, r) in enumerate(trees[k]):
            sub, path = climb([x[2] for x in trees[k]], at)
            now = leaf(r, lowered(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            for a, b in path + above:
                now = h(*a, now, *b)
            yield r[0], own, sub, root, h(*(x for a, b in path + above for x in (*a, *b))), now, now == root


def audit(docs, depth=4):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, manifest.leaf_digest(*fields, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    made = manifest.build_manifest(docs, manifest.leaf_digest(*fields, F.col("text")), claimed=tampered, depth=depth)
    return made, made.proofs(["key"], audit=True).withColumn("verified", F.col("folded_root") == F.col("root"))


@pytest.mark.parametrize("depth", [4, 1])
def test_manifest(spark, depth):
    """depth 1: builders of eight leaves, so trees of three tiers."""
    data = rows()
    docs = spark.createDataFrame(data, DOCS).repartition(3).withColumns({c: F.lit(1) for c in ("tree", "place", "key", "digest", "claimed", "block", "tie")})
    made, found = audit(docs, depth)
    assert Counter(map(tuple, found.collect())) == Counter(brute_manifest(data))
    proof = made.proofs(["key"]).where("key = 94").first()
    path = [(p, bytes.fromhex(s)) for p, s in zip(proof["places"], proof["siblings"], strict=True)]
    assert manifest.fold(proof["leaf"].encode(), path).decode() == proof["root"] != manifest.fold(proof["subroot"].encode(), path).decode()
    assert audit(docs.limit(0))[1].count() == 0 and audit(docs.where("lang = 'alone'"))[1].first()["root"] == leaf(data[94], "one leaf")


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 300, 513])
def test_positions_are_those_of_completion(n):
    order, level = [], [list(range(n))]
    while len(level[-1]) > 1:
        level.append(list(range(-(-len(level[-1]) // 8))))
    for i in range(n):  # a node follows its last child
        order.append((0, i))
        for k in range(1, len(level)):
            if (i + 1) % 8**k == 0 or i + 1 == n:
                order.append((k, i // 8**k))
    for k, nodes in enumerate(level):
        got = manifest.position(k, manifest.ends(k, len(nodes), n))
        assert [order[p] for p in got] == [(k, i) for i in nodes]


def brute_tree(text):
    split = lambda x, ends: [p for p in re.split(ends, x) if p]
    sections = []
    for s in split(text or "", r"(?<=\n\n)(?!\n)"):
        sections.append([(h(p), [h(m)[:9] + f"{len(m):03x}" for m in re.findall(r"(?s).{0,126}?[.!?][ \t\n]|.{1,128}", p)]) for p in split(s, r"(?<=\n)(?!\n)")])
    digests = [h(*(p for p, _ in s)) for s in sections]
    body = ";".join(",".join([d[:8], *(".".join([p[:8], *m]) for p, m in s)]) for d, s in zip(digests, sections, strict=True))
    return f"{h(*digests)}:{body}", {m for s in sections for _, x in s for m in x}


def brute_like(a, b):
    (fa, ma), (fb, mb) = brute_tree(a), brute_tree(b)
    size = lambda x: sum(int(m[9:], 16) for m in x)
    return 1.0 if fa[:64] == fb[:64] else 2 * size(ma & mb) / (size(ma) + size(mb))


def test_edited_likeness(spark):
    data = [r[:2] for r in rows() if r[:2] != (3, "another text. " * 9) and r[:2] != (None, None)]  # the order of one doc_id's texts is by hashes
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("key", "check", "copies", "n_chars", "print")})
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter()
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want[i, len(text), h(edited), brute_tree(text)[0], brute_tree(edited)[0], round(brute_like(text, edited), 9), round(brute_like(text, after), 9)] += 1
    got = fingerprint.edited_likeness(docs)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got.collect()) == want
    assert fingerprint.edited_likeness(docs.limit(0)).count() == 0
    whole = spark.createDataFrame(rows(), DOCS)
    assert fingerprint.edited_likeness(whole).count() == whole.count()


def test_many_copies_are_spread(spark):
    """Of a row that makes up most of the table every copy but the last comes next to itself."""
    docs = spark.createDataFrame([(1, "same text. Twice same")] * 3000 + [(0, "first. one"), (2, "last. one")], "doc_id long, text string")
    got = fingerprint.edited_likeness(docs).where("doc_id = 1").groupBy("edited_sha256").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2999]


def test_edits_are_located(spark):
    old = "first line\nsecond line\n\nnext section\nits end\n\nlast"
    new = "first line\nsecond line, longer\n\nnext section\nits end\n\nlast"
    pairs = spark.createDataFrame([(1, old, new), (2, old, old), (3, None, ""), (4, None, "x")], "id long, a string, b string").withColumn("section_", F.lit(0))
    assert sorted(map(tuple, fingerprint.edits(pairs, "a", "b").select("id", "section", "paragraph", "size").collect())) == [(1, 0, 1, 21), (4, 0, 0, 1)]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(count, ratio=10):
    forms = {}
    for w, n in count.items():
        best = sorted((-m, v) for v, m in count.items() if near(w, v))
        form = best[0][1] if best and -best[0][0] >= ratio * n else None
        forms[w] = (n, len(best), form)
    for w, (n, many, form) in forms.items():
        root = w
        while forms[root][2]:
            root = forms[root][2]
        yield w, form, root, n, many, count[form] if form else None


def test_vocabulary(spark):
    data = [r[:2] for r in rows()]
    total = Counter()
    for i, text in data:
        for run in re.findall("[a-zÀ-ÿ]+", lowered(text or "")):
            x = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: x % len(run)] + run[x % len(run) + 1 :] if x % 31 == 0 else run] += 1
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumn("word", F.lit("clash"))
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs, typo=31).collect()}
    assert got == {w: n for w, n in total.items() if len(w) >= 7 and n >= 2} and "overview" in got
    assert spelling.vocabulary(docs.limit(0)).count() == 0


@pytest.mark.parametrize("symbols", [2, 8])
def test_spelling_variants(spark, symbols):
    random.seed(5)
    words = {"".join(random.choice("aeioué") for _ in range(7)) for _ in range(60)}
    for _ in range(400):
        w, at = random.choice(sorted(words)), random.randint(0, 7)
        words.add(random.choice([w[:at] + w[at + 1 :], w[:at] + random.choice("aeioußz") + w[at + 1 :], w[:at] + random.choice("bé") + w[at:]]))
    words |= {"a" * 500, "a" * 501, "a" * 250 + "b" + "a" * 250, "b" + "a" * 500}
    count = {w: random.choice([2, 2, 3, 20, 30, 300, 3000]) for w in sorted(words) if w}
    df = spark.createDataFrame(list(count.items()), "word string, n long").withColumns({c: F.lit(0) for c in ("id", "form", "root")})
    got = spelling.spelling_variants(df, symbols=symbols).select("word", "form", "root", "n", "n_near", "form_n")
    assert Counter(map(tuple, got.collect())) == Counter(brute_forms(count))
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_edit_keys_reach_every_neighbour():
    """Of two words one letter apart one's edits hold a key under which the other is found, at any place and length."""
    import pyarrow as pa

    random.seed(6)
    keys = lambda w, edits: set(np.concatenate([b["key"].to_numpy() for b in spelling.keys([pa.record_batch({"id": [0], "word": [w]})], 8, edits)]).tolist())
    for _ in range(120):
        w = "".join(random.choice("abcdefgéü") for _ in range(random.randint(2, 12)))
        for at in range(len(w) + 1):
            for v in (w[:at] + "k" + w[at:], w[:at] + "k" + w[at + 1 :]):
                if v != w:
                    assert keys(w, True) & keys(v, False) or keys(v, True) & keys(w, False), (w, v)
