"""The operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tideline.llm import bpe, line_crf, maxscore, packing, pretokens, quality_rules, secret_scan, sharding, simhash, suffix_dedup, token_counts  # noqa: E402
from tideline.llm.components import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "the quick brown fox jumps over the lazy dog and then runs through the dark green forest until the night has come at last. "


@pytest.fixture(scope="module")
def rows():
    random.seed(4)
    words = ["alpha", "beta", "gamma", "don't", "naïve", "日本", "x", "1234", "the", "and", "of", "to"]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    out = [(i, text(random.randint(1, 80)) + random.choice(["", "\n", ".\n\n"]) + text(random.randint(0, 20)), random.choice(["en", "de", None]), random.choice(["a", "b", None]), 5) for i in range(60)]
    out += [(60, None, None, None, None), (61, "", "en", "a", 0), (None, "no id", "en", "a", 5), (63, text(6000), "en", "a", 1)]
    out += [(64 + i, out[i][1], "en", "a", 5) for i in range(8)]  # copies
    out += [(80 + i, text(15) + PASSAGE * 2 + text(15), "en", "b", 5) for i in range(6)]  # a shared passage
    out += [out[3], out[3], out[75]]  # repeated rows
    out += [(95, out[10][1] + " more", "en", "b", 1), (96, "<|endoftext|> a <|endoftext|>", "en", "b", 1), (97, "  \n\t ", "en", "b", 1), (98, "a" * 3000, "en", "b", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_words_follow_the_pattern():
    regex = pytest.importorskip("regex")
    random.seed(1)
    signs = [*" '\n\tabstrevldm1é9²,.! 　日😀ſ", "  ", "'s", "'re", "'ll", " '", "'S", "''"]
    for _ in range(300):
        texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 20))) for _ in range(4)]
        buf, offsets = pretokens.flat(pa.array(texts))
        starts = pretokens.word_starts(buf, offsets)
        got = [buf[s:e].tobytes().decode() for s, e in zip(starts, np.append(starts[1:], len(buf)), strict=True)]
        assert got == [w for t in texts for w in regex.findall(P.PATTERN, t)], texts


def test_token_counts(spark, docs, rows, tmp_path):
    path, cache = P.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    library = pretokens.LibraryWords(path)
    want = Counter((r[0], len((r[1] or "").encode()), len(library.whole([r[1] or ""])[0])) for r in rows)
    for _ in range(2):  # the second time all are in the cache
        got = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), path, cache).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
        cached = spark.read.parquet(cache)
        assert cached.count() == cached.select("content").distinct().count() == len({r[1] or "" for r in rows})
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_fast_words_are_the_librarys(rows):
    path = P.path("byte_bpe_50k.json")
    texts = [r[1] for r in rows]
    ids, offsets = pretokens.LibraryWords(path, fast=True).encoded(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == pretokens.LibraryWords(path).whole([t or "" for t in texts])


def base_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    threes = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, rows):
    got = quality_rules.quality_rules(docs.withColumn("kept", F.lit(1))).collect()
    assert Counter((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got) == Counter((r[0], *base_stats(r[1])) for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_outliers_go_and_clean_rows_stay(spark):
    random.seed(7)
    words = [a + b for a in ("sta", "mer", "lo", "fin", "tra") for b in ("ne", "dow", "ly", "ger", "s", "tion")]
    clean = lambda: " ".join(random.choice(words) for _ in range(120)).capitalize() + "."
    junk = lambda: " ".join(random.choice(words) + random.choice(["***", "###"]) for _ in range(120))
    data = [(i, junk() if i % 9 == 0 else clean(), "en", f"s{i % 2}", 0) for i in range(400)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(data, DOCS)).collect()}
    assert all(kept[i] == (i % 9 != 0) for i in kept)
    assert quality_rules.consistency(0.75) > 1 and quality_rules.chi_square(quality_rules.chi_quantile(0.975, 4), 4) == pytest.approx(0.975)


@pytest.mark.parametrize("same", [True, False])
def test_junk_of_a_third_of_a_source_goes(spark, same):
    random.seed(8)
    words = [a + b for a in ("sta", "mer", "lo", "fin", "tra") for b in ("ne", "dow", "ly", "ger", "s", "tion")]
    clean = lambda: " ".join(random.choice(words) for _ in range(120)).capitalize() + "."
    junk = lambda: " ".join(random.choice(words) + random.choice(["***", "###", "|", "$$"]) for _ in range(random.randint(80, 160)))
    one = junk()
    data = [(i, clean() if i % 3 else one if same else junk(), "en", "s0", 0) for i in range(600)] + [(600 + i, clean(), "en", "s1", 0) for i in range(100)]
    got = quality_rules.quality_rules(spark.createDataFrame(data, DOCS)).collect()
    assert not any(r["base_failed"] for r in got) and all(r["kept"] == (r["doc_id"] % 3 != 0 or r["doc_id"] >= 600) for r in got)


def test_maxscore(spark):
    random.seed(5)
    data = [(i, [random.gauss(0, 0.2) + (i % 3) * 0.1 for _ in range(8)]) for i in range(130)]
    data += [(200 + i, [0.25] * 8) for i in range(30)] + [(300, None), (400, [0.1, None]), (500, [float("nan")] * 8), (600, []), (700, [0.5, 0.5]), (None, [0.1] * 8)] + [data[0], data[7]]
    got = defaultdict(list)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    for r in maxscore.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=40).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fine = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in data if i is not None and v is not None and all(x is not None and x == x for x in v)}
    assert set(got) == {i for i in fine if i % 100 == 0}
    for q, found in got.items():
        scores = sorted((-sum(a * b for a, b in zip(fine[q], v, strict=False)), i) for i, v in fine.items() if i != q)[:10]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_sharding(spark, docs, rows):
    got = sharding.shard_documents(docs, shards=5, ranges_a_shard=4, draws=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_sharding_splits_a_hot_text(spark):
    data = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy " * 20).otherwise(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 512))).alias("text"))
    got = sharding.shard_documents(data, shards=10, ranges_a_shard=4, draws=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    mean = sum(r["b"] for r in got) / 10
    assert len(got) == 10 and all(abs(r["b"] / mean - 1) < 0.05 for r in got)


def test_secrets(spark):
    texts = [None, "", "password = 'abcdef123456789'", "token=secret: abcdefghijklmnop", "x AKIA" + "A1B2" * 5 + " AKIA1", "id 0123456789abcdef0 0123456789abcde", "é日 api_key:" + "Zz9" * 8, "PassWD=\"short\"", "blob Q7x9LmZ2pWk4RtVb8NcYd3Hg1Js5Ff word " + "internationalization" * 2, "uuid 123e4567-e89b-12d3-a456-426614174000", "secret=" + "a" * 5000]
    found = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))).select("doc_id", secret_scan.listed(F.col("base_spans")).alias("b"), secret_scan.listed(F.col("spans")).alias("s")).collect()
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in found:
        t = texts[r["doc_id"]] or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert r["b"] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)), t
        entropy = [x for x in r["s"].split(",") if x.startswith("entropy")]
        assert entropy == brute_entropy(t, [(s[0], s[2]) for s in spans]), t
    red = [r["text"] for r in secret_scan.redact(spark.createDataFrame([(1, "a password=abcdef123456789 b token=0123456789abcdef01234 c", 9), (2, None, None), (3, "fine", 4)], "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()]
    assert red == ["a [secret] b [secret] c", None, "fine"]


def brute_entropy(text, base):
    out = []
    for k, c in enumerate(secret_scan.CLASSES):
        chars = "[" + re.escape(c.alphabet) + "]"
        for m in re.finditer(f"(?<!{chars}){chars}{{{c.window},}}", text):
            if any(re.search(a, m[0]) for a in secret_scan.ALLOWED):
                continue
            joined = []
            for i in range(len(m[0]) - c.window + 1):
                n = Counter(m[0][i : i + c.window]).values()
                if -sum(x / c.window * np.log2(x / c.window) for x in n) >= c.bits - 1e-12:
                    if joined and i <= joined[-1][1]:
                        joined[-1][1] = i + c.window
                    else:
                        joined.append([i, i + c.window])
            out += [(m.start() + a, 3 + k, f"{c.kind}:{m.start() + a}:{m.start() + b}") for a, b in joined if not any(s <= m.start() + a and m.start() + b <= e for s, e in base)]
    return [x[2] for x in sorted(out)]


def test_packing(docs, rows):
    path = P.path("byte_bpe_50k.json")
    library = pretokens.LibraryWords(path)
    want = Counter()
    for r in rows:
        ids = library.whole([r[1] or ""])[0] + [1]
        for s in range(0, len(ids), 64):
            part = ids[s : s + 64]
            want[r[0], s, len(part), len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), struct.pack(f"<{len(part)}I", *part)] += 1
    got = packing.pack_documents(docs, path, capacity=64, ids=True).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        ends = [0] + [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64
    assert set(by) == set(range(len(by))) and packing.pack_documents(docs.limit(0), path).count() == 0


def test_fill_is_the_closest_sum():
    random.seed(3)
    for _ in range(60):
        counts = np.zeros(31, np.int64)
        for _ in range(random.randint(0, 6)):
            counts[random.randint(1, 30)] += random.randint(1, 3)
        sums = {0}
        for k in np.flatnonzero(counts):
            sums = {s + k * m for s in sums for m in range(counts[k] + 1) if s + k * m <= 30}
        taken = packing.fill(counts, 30)
        assert sum(k * m for k, m in taken.items()) == max(sums) and all(m <= counts[k] for k, m in taken.items())


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_simhash(docs, rows):
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash"))).collect()
    fps = Counter((r[0], brute_fingerprint(r[1])) for r in rows)
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got) == fps
    root = brute_components({f for _, f in fps})
    least = defaultdict(list)
    for d, f in fps:
        least[root[f]] += [d] if d is not None else []
    assert all(r["component_id"] == min(least[root[r["fp"] & (1 << 64) - 1]], default=None) for r in got)
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(least) and kept[0].asDict().keys() == set(docs.columns)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links_of_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 5000)
    random.seed(11)
    centre = [random.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))) for c in centre for _ in range(60)} | {0} | {random.getrandbits(64) for _ in range(100)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in components(simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"))).collect()}
    want = brute_components(fps)
    groups = lambda m: Counter(frozenset(f for f in fps if m.get(f, f) == r) for r in {m.get(f, f) for f in fps})
    assert groups(found) == groups(want)


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5)]
    random.shuffle(links)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_crf(spark):
    random.seed(2)
    good = lambda: "\n".join(" ".join(random.choice(["river", "stone", "quiet", "morning", "walks"]) for _ in range(8)).capitalize() + "." for _ in range(random.randint(1, 6)))
    bad = lambda: "\n".join(" ".join(random.choice(["BUY", "$$$", "NOW!!", "||", "click"]) for _ in range(8)) for _ in range(random.randint(1, 6)))
    data = [(i, bad() if i % 4 == 0 else good()) for i in range(300)] + [(500, None), (501, ""), (None, good()), (502, "\n\n")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(300)] + [(0, None), (None, 1)], "doc_id long, quality int")
    got = line_crf.score_documents(df.withColumn("score", F.lit("x")), line_crf.fit(df, labels)).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert len(got) == len(data) and held and all(r["predicted"] == (0 if r["doc_id"] % 4 == 0 else 1) for r in held)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert line_crf.score_documents(df.limit(0), line_crf.fit(df, labels.limit(0))).count() == 0


def test_forward_backward():
    import itertools

    rng = np.random.default_rng(0)
    unary, chain, offsets = rng.normal(size=(7, 2)), rng.normal(size=(2, 2)), np.array([0, 3, 3, 7])
    chance, pair, norm = line_crf.forward_backward(unary, chain, offsets)
    total, seen, pairs = 0.0, np.zeros((7, 2)), np.zeros((2, 2))
    for a, b in ((0, 3), (3, 7)):
        ways = [(y, np.exp(sum(unary[a + t, v] for t, v in enumerate(y)) + sum(chain[u, v] for u, v in zip(y, y[1:], strict=False)))) for y in itertools.product((0, 1), repeat=b - a)]
        z = sum(w for _, w in ways)
        total += np.log(z)
        for y, w in ways:
            for t, v in enumerate(y):
                seen[a + t, v] += w / z
            for u, v in zip(y, y[1:], strict=False):
                pairs[u, v] += w / z
    assert np.allclose(chance, seen) and np.allclose(pair, pairs) and norm == pytest.approx(total)


def test_bpe(docs, rows):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode_texts(docs.select("doc_id", "text", F.lit(1).alias("ids")), path)
    got = coded.collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == Counter((r[0], tuple(own.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    again = bpe.decode_ids(coded.withColumnRenamed("decoded", "own"), path).collect()
    assert all(bytes(r["decoded"]) == bytes(r["own"]) for r in again) and bpe.encode_texts(docs.select("doc_id", "text").limit(0), path).count() == 0


def brute_repeats(rows, length):
    seen, out = {}, {}
    for d, text in sorted({(r[0] if r[0] is not None else -1, r[1] or "") for r in rows}):
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen[b[s : s + length]] = True
        out[d] = (len(b), sum(gone), sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("frequent", [None, 2])
def test_suffix_dedup(docs, rows, frequent):
    want = brute_repeats(rows, 100)
    got = suffix_dedup.remove_repeats(docs.withColumn("kept", F.lit(1)), frequent=frequent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[-1 if r["doc_id"] is None else r["doc_id"]], r["doc_id"]
    if frequent is None:
        assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
        texts = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs).collect()}
        assert texts[60] is None and texts[64 + 3] == rows[3][1].encode()[: want[67][0]].decode() if want[67][1] == 0 else texts[67] == ""


def test_pipeline(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    now = docs
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
    assert now.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(pipeline.STAGES[-1][1](spark, now, "").columns)




def test_long_candidates(spark):
    """Candidates of tens of thousands of characters: allowed ones give no span, others the same spans in any text."""
    from tideline.llm.secret_scan import listed, scan

    core = "A1b2C3d4E5f6G7h8I9j0K1"
    texts = ["ab-" * 30_000, "12-" * 30_000, "ab-" * 30_000 + "1", core, "zz " * 30_000 + core]
    found = [r["s"] for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select(listed(F.col("spans")).alias("s")).collect()]
    assert found[:3] == ["", "", ""] and found[3] == f"entropy_base64:0:{len(core)}" and found[4] == f"entropy_base64:90000:{90000 + len(core)}"


def local_ranges(rows, length, hot, batch=7):
    """The stages of the suffix sort on rows (rank, doc, text) without Spark; the ranges found for each document."""
    full = pa.table({"rank": pa.array([r[0] for r in rows], pa.int64()), "doc": pa.array([r[1] for r in rows], pa.int64()), "text": [r[2] for r in rows]})
    sort = lambda t: t.take(pa.array(np.argsort(t["h"].to_numpy(), kind="stable"))).combine_chunks().to_batches(max_chunksize=50)
    keys = sort(pa.Table.from_batches(suffix_dedup.key_batches(iter(full.to_batches(max_chunksize=batch)), length, hot)))
    places = defaultdict(list)
    for b in suffix_dedup.repeated_keys(iter(keys)):
        for r, d, at in zip(*(b.column(c).to_pylist() for c in ("rank", "doc", "at")), strict=True):
            places[r, d].append(at)
    some = full.append_column("places", pa.array([places.get((r[0], r[1])) for r in rows], pa.list_(pa.int64())))
    sent = list(suffix_dedup.surroundings(iter(some.to_batches(max_chunksize=batch)), length, hot))
    out = defaultdict(set)
    for b in suffix_dedup.repeats(iter(sort(pa.Table.from_batches(sent))), length):
        for r, d, s, e in zip(*(b.column(c).to_pylist() for c in ("rank", "doc", "begin", "end")), strict=True):
            out[r, d] |= set(range(s, e))
    return out, sent


@pytest.mark.parametrize("longest", [150, 1 << 20])
@pytest.mark.parametrize("often", [False, True])
def test_suffix_sort_in_pieces(monkeypatch, longest, often):
    monkeypatch.setattr(suffix_dedup, "LONGEST", longest)
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(i, i * 7, text(random.randint(0, 60)) + (passage if i % 2 else passage[40:200]) + text(random.randint(0, 60)) + (passage if i % 5 == 0 else "")) for i in range(30)]
    rows += [(30, 1, "x" * 700), (31, 1, ""), (31, 2, passage)]
    hot = suffix_dedup.Strings(suffix_dedup.gram_hashes(np.frombuffer(passage.encode(), np.uint8)) if often else np.zeros(0, np.uint64))
    got, _ = local_ranges(rows, 100, hot)
    seen = set()
    for rank, doc, t in sorted(rows):
        want = set()
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                want |= set(range(s, s + 100))
            seen.add(t[s : s + 100])
        assert got.get((rank, doc), set()) == want, (rank, doc)


def test_frequent_passages_send_few_rows():
    """A passage in every document: with its strings known to be frequent, a task sends each of its surroundings once; what is left
    are strings of the passage and a letter more, each in a seventeenth of the documents."""
    random.seed(13)
    text = lambda n: "".join(random.choice("abcdefghijklmnop ") for _ in range(n))
    passage = text(400)
    rows = [(i, i, text(300) + passage + text(300)) for i in range(200)]
    hot = suffix_dedup.Strings(suffix_dedup.gram_hashes(np.frombuffer(passage.encode(), np.uint8)))
    got, sent = local_ranges(rows, 100, hot)
    table = pa.Table.from_batches(sent).to_pandas()
    with_bytes = table[table["bytes"].notna()]
    want = brute_repeats([(i, t) for i, _, t in rows], 100)
    assert with_bytes.groupby("h").size().max() <= 25 and all(len(got.get((i, i), ())) == want[i][1] for i in range(200))
    assert want[0][1] == 0 and all(want[i][1] >= 400 for i in range(1, 200))


@pytest.mark.parametrize("copies", [40, 320])
def test_repeats_of_one_row(spark, copies):
    """A document that comes many times is one: what is kept of its places and ranges doesn't grow with its repeats."""
    random.seed(17)
    text = lambda n: "".join(random.choice("abcdefghijklmnop ") for _ in range(n))
    passage = text(300)
    rows = [(1, text(200) + passage + text(100))] + [(2, passage + text(150) + passage)] * copies + [(3, text(400)), (3, passage)]
    want = brute_repeats(set(rows[:-2]), 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found, ranges = suffix_dedup.repeated_ranges(suffix_dedup.aside(df.withColumn("doc_id", F.col("doc_id")), "text"), 100, None)
    assert ranges.agg(F.sum(F.size("ranges"))).first()[0] < 30 and found.agg(F.max(F.size("places"))).first()[0] <= 1000
    got = suffix_dedup.remove_repeats(df).where("doc_id < 3").collect()
    assert len(got) == copies + 1 and all((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]] for r in got)


def test_one_of_many_equal_rows_stays(spark):
    same, other = "one two three four five six", "nothing like it at all in here"
    df = spark.createDataFrame([(1, same)] * 500 + [(2, same)] * 3 + [(None, other)] * 400 + [(3, None), (4, "")], "doc_id long, text string").repartition(5).withColumn("twins", F.lit("x"))
    assert sorted(map(str, simhash.keep_one(df).select("doc_id", "text", "twins").collect())) == sorted(map(str, [type(df.first())(doc_id=i, text=t, twins="x") for i, t in ((1, same), (None, other), (3, None))]))


def test_components_beyond_a_long(spark):
    """Scores that fit a long are right; vectors whose scores might not fit are an error before the search."""
    big = spark.createDataFrame([(0, [1000000.0, 1.0]), (1, [1000000.0, 2.0]), (2, [-1000000.0, 3.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in maxscore.top_k(big, F.lit(True)).collect()}
    assert got[0, 1] == 1024 * 1024 * (10**12 + 2) and got[0, 2] == 1024 * 1024 * (3 - 10**12)
    for x in (1e7, 1e16, 1e300):
        with pytest.raises(ValueError, match="fit a long"):
            maxscore.top_k(spark.createDataFrame([(0, [x]), (1, [x])], "vec_id long, embedding array<double>"), F.lit(True))


def test_characters_survive(spark):
    """Only what a cut has split goes from a text; marks of broken characters in the source stay."""
    shared = "日本語の長い文章です。" * 12
    data = [(1, "a � " + shared + "é", 3), (2, "bad � char stays " + shared[1:] + " � end", 3), (3, "� only", 7), (4, None, None), (5, "ü" + shared, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_chars long").withColumns({c: F.lit(9) for c in ("row", "rank", "doc", "places", "copy", "ranges")})
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(df).collect()}
    want = {d: kept.decode("utf-8", "ignore") for d, (_, _, _, kept) in brute_repeats(data, 100).items()}
    assert all(got[d]["text"] == want[d] for d in (1, 2, 3, 5)) and want[1].startswith("a � 日本語の長い文章です。") and want[1].endswith("é")  # the passage has a period of 33 bytes
    assert got[3]["text"] == "� only" and got[3]["n_chars"] == 7 and got[4]["text"] is None
    assert got[2]["text"] == "bad � char stays  � end" and got[2]["n_chars"] == len(got[2]["text"])
    assert got[5]["text"] == "ü" and got[5].asDict().keys() == set(df.columns) and got[5]["places"] == 9


def test_bpe_of_long_words():
    """Words of any length are merged by the recursion itself."""
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    words = bpe.MergedWords(path)
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=words.ranks, special_tokens={})
    random.seed(6)
    tokens = [t.decode() for t in words.ranks if t.isalpha() and t.isascii()]
    some = lambda letters, n: "".join(random.choice(letters) for _ in range(n))
    texts = [some("ab", n) for n in (1, 599, 600, 601, 3000)] + ["a" * n for n in (601, 3000, 100_000)] + [some("abcdefghijklmnopqrstuvwxyz", n) for n in (601, 3000)]
    texts += ["".join(random.choice(tokens) for _ in range(900)), "日本語の長い文章です" * 90, "a" * 700 + "-" * 700 + "aa" * 300]
    for n in (7, 5000):  # few and many rows a recursion
        words.clear()
        words.ROWS = n * 1000
        place = words.take([t.encode() for t in texts])
        for t, k in zip(texts, place, strict=True):
            assert words.ids[words.begin[k] : words.begin[k] + words.size[k]].tolist() == library.encode_ordinary(t), (n, len(t))


#: Texts whose secret only the entropy of its windows shows (its span), and texts that hold none.
ONLY_ENTROPY = {"deploy with Q7x9LmZ2pWk4RtVb8NcYd3Hg1Js5Ff today": (12, 42), "the value is qXwLmZbpWkcRtVdbNeYdfHgJsFgKh indeed": (13, 42), "sum A3F09C81D27B4E6650F1 stays": (4, 24)}
NO_SECRET = ["a wonderful internationalization/of/everything-there-is", "myVeryLongVariableNameWithoutEnd", "call 0123-4567-8901-2345-6789 now", "123e4567-e89b-12d3-a456-426614174000", "key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "=" * 60, "xy" * 40, "Rindfleischetikettierungsueberwachungsaufgabe"]


def test_secrets_that_only_entropy_finds(spark):
    texts = [*ONLY_ENTROPY, *NO_SECRET]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["base_spans"], sorted({(s["start"], s["end"]) for s in r["spans"]})) for r in secret_scan.scan(found).collect()}
    for i, text in enumerate(texts):
        assert got[i] == ([], [ONLY_ENTROPY[text]] if text in ONLY_ENTROPY else []), text
    assert secret_scan.scan(found.limit(0)).count() == 0 and secret_scan.redact(found.limit(0)).count() == 0


def test_very_many_secrets(spark):
    """Places of matches past many blocks of them."""
    text = " é ".join(f"token={i:012d}" for i in range(3000))
    row = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = [(m.start(), m.end()) for m in re.finditer(r"token=\d+", text)]
    assert [(s["start"], s["end"]) for s in row["spans"]] == want
    assert secret_scan.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"] == re.sub(r"token=\d+", "[secret]", text)


def test_candidates_of_several_segments(spark):
    """Candidates of several segments, with windows of high entropy on both sides of a segment's end."""
    random.seed(29)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    texts = ["é " + "".join("".join(random.choices(letters, k=random.randint(5, 60))) + "ab" * random.randint(0, 30) for _ in range(25)) for _ in range(6)]
    got = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        base = [(b["start"], b["end"]) for b in r["base_spans"]]
        want = brute_entropy(texts[r["doc_id"]], base)
        assert len(want) > 3 and [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["rank"] > 2] == want


@pytest.mark.parametrize("hot", [0, 3])
def test_equal_texts_share_a_shard(spark, hot):
    """The law `bytes`, and groups: only a text that holds over a tenth of a shard is cut, whatever lies beside it."""
    random.seed(21 + hot)
    texts = [f"group {i} " + "x" * random.randint(50, 200) for i in range(400)]
    data = [t for t in texts for _ in range(random.randint(1, 4))] + [f"one {i} " + "y" * random.randint(1, 300) for i in range(1000)]
    data += ["hot " * 30] * (len(data) // 2 if hot else 0) + ["warm " * 20] * 30
    random.shuffle(data)
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3)
    got = sharding.shard_documents(df, shards=8, ranges_a_shard=8, draws=4).collect()
    loads, of = Counter(), defaultdict(set)
    for r in got:
        loads[r["shard"]] += r["size"]
        of[data[r["doc_id"]]].add(r["shard"])
    mean, held = sum(loads.values()) / 8, Counter()
    for t in data:
        held[t] += len(t) + 16
    assert len(got) == len(data) and len(loads) == 8 and all(abs(v - mean) <= 0.1 * mean + 700 for v in loads.values())
    assert all(len(s) == 1 for t, s in of.items() if held[t] <= 0.1 * mean) and (not hot or len(of["hot " * 30]) > 2)


def test_boundaries_inside_texts():
    low = sharding.LOWEST
    sample = sorted([(5, i, i, 1.0) for i in range(90)] + [(k, 0, k, 1.0) for k in (1, 2, 3, 8, 9)])
    assert sharding.finer(sample, 10, False) == {(5, low, low), (6, low, low)}
    inside = [s for s in sample if s[0] == 5]
    assert len(sharding.finer(inside, 10, True)) == 9 and all(b[0] == 5 for b in sharding.finer(inside, 10, True))


def exact_mcd(x, lean, wide=None):
    """Minimum covariance determinant by many random starts and exact steps; the language's estimate as `lean` rows more."""
    q, floor = quality_rules, np.diag((np.array(quality_rules.FLOORS) * quality_rules.GRID) ** 2)
    n, p = x.shape
    h = min(n, (n + p + 1) // 2)

    def with_wide(rows, factor):
        if not len(rows):
            return wide
        m, c = rows.mean(0), factor * np.cov(rows.T, bias=True).reshape(p, p)
        if wide is None:
            return m, c
        w, d = len(rows) / (len(rows) + lean), m - wide[0]
        return w * m + (1 - w) * wide[0], w * c + (1 - w) * wide[1] + w * (1 - w) * np.outer(d, d)

    def far(m, c):
        return np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c + floor), x - m)

    best, rng = None, np.random.default_rng(0)
    for k in range(60):
        m, c = (x[rng.choice(n, min(n, p + 1), replace=False)].mean(0), floor) if k or wide is None else wide
        before = np.inf
        while True:
            m, c = with_wide(x[np.argsort(far(m, c), kind="stable")[:h]], q.consistency(h / n))
            det = np.linalg.slogdet(c + floor)[1]
            if best is None or det < best[0]:
                best = det, m, c
            if det > before - 1e-6:
                break
            before = det
    return with_wide(x[far(*best[1:]) <= q.chi_quantile(0.975, p)], q.consistency(0.975))


def test_outliers_are_those_of_an_exact_estimate(spark):
    random.seed(31)
    words = [a + b for a in ("sta", "mer", "lo", "fin", "tra", "Ka") for b in ("ne", "dow", "ly", "ger", "s", "tion")]
    def made(kind):
        ends = {"plain": ["", "", "", ","], "list": ["", ";", ":"], "junk": ["***", "###", "|", "$$"], "loud": ["!!!", "!", "?!"]}[kind]
        text = " ".join(random.choice(words) + random.choice(ends) for _ in range(random.randint(60, 160)))
        return text.upper() if kind == "loud" else text + "."
    data = []
    for lang, source, size, junk, usual in [("en", "a", 300, 0.3, "plain"), ("en", "b", 40, 0.2, "plain"), ("en", "c", 3, 0.4, "plain"), ("de", "a", 200, 0.05, "list"), ("de", "b", 1, 1.0, "list"), (None, "a", 90, 0.1, "plain")]:
        data += [(len(data) + i, made(random.choice(["junk", "loud"]) if i < junk * size else usual), lang, source, 0) for i in range(size)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(data, DOCS).repartition(3)).collect()}
    stats = quality_rules.quality_stats(pa.array([r[1] for r in data]))
    x = np.stack(quality_rules.vectors(stats), 1).astype(float)
    fine = np.array([not got[r[0]]["base_failed"] for r in data])
    limit, floor = quality_rules.chi_quantile(1 - 1e-9, 4), np.diag((np.array(quality_rules.FLOORS) * quality_rules.GRID) ** 2)
    for lang in {r[2] for r in data}:
        wide = exact_mcd(x[[i for i, r in enumerate(data) if r[2] == lang and fine[i]]], 20)
        for source in {r[3] for r in data if r[2] == lang}:
            own = [i for i, r in enumerate(data) if r[2:4] == (lang, source) and fine[i]]
            m, c = exact_mcd(x[own], 20, wide)
            for i in own:
                d = (x[i] - m) @ np.linalg.inv(c + floor) @ (x[i] - m)
                assert got[i]["kept"] == (d <= limit) or 0.7 < d / limit < 1.4, (lang, source, d, got[i]["distance"])
    assert all(got[r[0]]["kept"] == (not re.search(r"[*#|$!]", r[1])) for r in data if not got[r[0]]["base_failed"])


def test_long_chains_in_blocks():
    rng = np.random.default_rng(4)
    offsets = np.array([0, 1, 1, 40, 47, 300, 700, 700, 703])
    unary, chain = rng.normal(size=(703, 2)) * 3, rng.normal(size=(2, 2)) * 2
    for block in (1, 2, 7, 64):
        for a, b in zip(line_crf.forward_backward(unary, chain, offsets, block), line_crf.forward_backward(unary, chain, offsets), strict=True):
            assert np.allclose(a, b), block
    many = line_crf.forward_backward(rng.normal(size=(400_000, 2)), chain, np.array([0, 400_000]))
    assert np.isfinite(many[2]) and np.allclose(many[0].sum(1), 1)


def test_fit_takes_one_row_of_a_document(spark, monkeypatch):
    """Rows that share a labelled doc_id are reduced to one before they are collected."""
    seen = []
    monkeypatch.setattr(line_crf, "train", lambda x, length, offsets, good: seen.append((len(good), len(x))))
    rows = [(i, "Good line.\nAnother one.") for i in range(20)] + [(0, "again"), (0, "again"), (1, "\n".join(["many"] * 500))] * 30
    line_crf.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"))
    fit_ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert seen[0][0] == len(fit_ids) and seen[0][1] <= 2 * len(fit_ids)


CLASHES = "row key check nth root rank doc copy places ranges h at n rows first digest content tokenizer known _n _salt _parts _content _text _b0 _c1 b0 c0 whole hit _rank _doc _key _nth _lang _source lang_key source_key group_rows x0 _x0 m0 v00 c00 l_m0 med0 sd0 start before fp_ cell own least count done begin end".split()


@pytest.mark.parametrize("name", ["op1", "op2", "reject", "op5", "redact", "op7", "keep_one", "op8", "op9", "op10", "without_repeats"])
def test_columns_of_any_name_come_back(spark, rows, name):
    path = P.path("byte_bpe_50k.json")
    ops = {
        "op1": lambda d: token_counts.count_tokens(d, path), "op2": quality_rules.quality_rules, "reject": quality_rules.reject_outliers, "op5": secret_scan.scan, "redact": secret_scan.redact,
        "op7": simhash.near_duplicates, "keep_one": simhash.keep_one, "op8": lambda d: line_crf.score_documents(d, line_crf.train(np.zeros((0, line_crf.WIDTH)), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, bool))),
        "op9": lambda d: bpe.encode_texts(d, P.path("byte_bpe_multi_50k.tiktoken")), "op10": suffix_dedup.remove_repeats, "without_repeats": suffix_dedup.without_repeats,
    }
    some = [r for r in rows if r[0] is not None][::3] + [rows[60], rows[62]]
    plain = spark.createDataFrame(some, DOCS)
    wide = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    out = ops[name](wide)
    kept = {"op2", "op7", "op8", "op9"}  # these leave the text out
    assert [c for c in out.columns if c in wide.columns] == [c for c in wide.columns if c != "text" or name not in kept]
    got, other = out.collect(), ops[name](plain).collect()
    assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in got for c in CLASHES)
    shown = lambda r: str([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in other[0].asDict()])
    assert Counter(map(shown, got)) == Counter(map(shown, other))
    none = ops[name](wide.limit(0))
    assert none.count() == 0 and none.columns == out.columns


def test_pipeline_against_brute_force(spark, rows):
    """Each stage on what the one before kept, and what it should have kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    random.seed(14)
    extra = [(200 + i, " ".join(random.choice(rows[63][1].split(" ")) for _ in range(120)) + " password = 'abcdef123456789' end " + PASSAGE * 2, "en", "b", 7) for i in range(6)]
    docs = spark.createDataFrame(rows + extra, DOCS).repartition(3)
    read = lambda df: [tuple(r) for r in df.collect()]

    kept = spark.createDataFrame(read(stages["quality_rules"](spark, docs, "")), DOCS)
    first = read(kept)
    verdict = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    assert Counter(first) == Counter(r for r in rows + extra if verdict[r[0], base_stats(r[1])[0]]) and len(first) > 20
    assert all(base_stats(r[1])[0] >= 50 and 2 * base_stats(r[1])[4] <= base_stats(r[1])[0] for r in first)

    second = read(stages["simhash_near_dedup"](spark, kept, ""))
    root = brute_components({brute_fingerprint(r[1]) for r in first})
    groups = defaultdict(list)
    for r in first:
        groups[root[brute_fingerprint(r[1])]].append(r)
    best = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert len(second) == len(best) and Counter(r[0] for r in second) == Counter(r[0] for r in best) and set(second) <= set(first)

    third = read(stages["suffix_array_dedup"](spark, spark.createDataFrame(second, DOCS), ""))
    want = brute_repeats(second, 100)
    for r in third:
        (source,) = (s for s in second if s[0] == r[0])
        n, removed, _, left = want[-1 if r[0] is None else r[0]]
        assert r[1] == (left.decode(errors="ignore") if removed else source[1]) and r[4] == (len(r[1]) if removed else source[4])
    assert len(third) == len(second) and any(want[d][1] for d in want)

    fourth = read(stages["secret_scans"](spark, spark.createDataFrame(third, DOCS), ""))
    assert len(fourth) == len(third)
    for r in fourth:
        (source,) = (s for s in third if s[0] == r[0])
        base = re.sub(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}""", "[secret]", source[1])
        assert r[1] == base and r[4] == (len(base) if base != source[1] else source[4])

    fifth = stages["packing"](spark, spark.createDataFrame(fourth, DOCS), "").collect()
    library = pretokens.LibraryWords(P.path("byte_bpe_50k.json"))
    lengths = defaultdict(int)
    for r in fifth:
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {r[0]: len(library.whole([r[1] or ""])[0]) + 1 for r in fourth}
    used = Counter()
    for r in fifth:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048 and set(used) == set(range(len(used)))


def test_fast_words_on_all_documents(spark):
    """The merging engine's ids are the library's on every text of the test table."""
    import os

    path, at = P.path("byte_bpe_50k.json"), "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    texts = pq.read_table(at, columns=["text"])["text"].combine_chunks()
    ids, offsets = pretokens.LibraryWords(path, fast=True).encoded(texts)
    whole = pretokens.LibraryWords(path).whole(texts.fill_null("").to_pylist())
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == whole
