"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through `length` bytes, by most-significant-digit passes over eight bytes at a time; groups
that stay together through all passes are exactly the repeated windows, and all but each group's first are removed.

To sort only suffixes that can repeat, each window is keyed by the least hash among its short strings: equal windows
have equal keys at equal places. Keys that occur once in the corpus rule out their windows. What is sent to be sorted is
each key's surroundings, once for each portion of the input, not one row for each suffix.

Strings that are frequent all over the corpus (a bounded number, known from a sample of documents before) are no keys as
long as a window holds another string: so windows that share only a phrase, or overlap a common passage, don't meet. A
window of frequent strings alone lies inside a common passage; its surroundings are equal wherever they occur, and a task
sends equal ones on once. The sample only decides what is sent where; every window is judged whatever it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import aside, back, chunks, flat, join_spread, ragged, text_or_empty, written

GRAM = 24
PLACE = 28  # bits for a place within a portion of text
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
LONGEST = 64 << 20  # bytes of text that are worked on at once; longer texts are cut into overlapping pieces
SAMPLE = 128 << 20  # bytes of the documents in which frequent strings are counted
HOT_KEYS, HOT_STRINGS = 20_000, 200_000  # most strings that count as frequent: of the keys, and of all in their windows
SENT = 100_000  # surroundings that a task remembers


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string of GRAM bytes, by doubling: 1, 2, 4, 8, 16, then 24."""
    power = [np.uint64(pow(int(_BASE), 1 << k, 1 << 64)) for k in range(5)]
    h = _TABLE[buf]
    eight = None
    for k in range(4):
        n = 1 << k
        h = h[:-n] * power[k] + h[n:]
        if k == 2:
            eight = h
    h = h[: len(buf) - GRAM + 1] * power[3] + eight[16:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    return np.minimum(v[: len(v) - (width - n)], v[width - n :]) if width > n else v


class Strings:
    """A set of hashes, by a bit for each value of their first 22 bits and a sorted array."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.may = np.zeros(1 << 22, bool)
        self.may[self.sorted >> np.uint64(42)] = True

    def __len__(self) -> int:
        return len(self.sorted)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = self.may[h >> np.uint64(42)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.sorted, h[at]), max(len(self) - 1, 0))
        out[at] = self.sorted[place] == h[at] if len(self) else False
        return out


class Keyed:
    """The windows of a portion of text: which starts are valid, and where each one's key lies."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, length: int):
        self.buf, self.offsets, self.width = buf, offsets, length - GRAM + 1
        n = np.maximum(np.diff(offsets) - length + 1, 0)
        self.starts = ragged(offsets[:-1], n)
        self.text = np.repeat(np.arange(len(n)), n)
        if len(self.starts):
            self.hash = gram_hashes(buf)
            self.key = self.keys()

    def keys(self, hot: Strings | None = None) -> np.ndarray:
        """The place of each window's string of least hash; those in `hot` count only if there is no other."""
        place = np.uint64((1 << PLACE) - 1)
        v = (self.hash >> np.uint64(1)) & ~place
        if hot:
            v |= hot.holds(self.hash).astype(np.uint64) << np.uint64(63)
        v |= np.arange(len(v), dtype=np.uint64)
        return (sliding_least(v, self.width) & place).astype(np.int64)[self.starts]


def keyed_portions(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, Keyed, int]]:
    """Rows in portions of about 2 MB, their windows, and the place in its text of a portion's first byte: a text of over
    LONGEST bytes is a portion of its own for each so many windows, and neighbouring ones share length - 1 bytes."""
    for whole in batches:
        for b in chunks(whole, "text", min(2 << 20, LONGEST)):
            buf, offsets = flat(b.column("text"))
            for first in range(0, max(len(buf), 1), LONGEST):  # more than one turn only for a single text
                part = buf[first : first + LONGEST + length - 1] if len(buf) > LONGEST else buf
                w = Keyed(part, np.array([0, len(part)]) if len(buf) > LONGEST else offsets, length)
                if len(w.starts):
                    yield b, w, first


def counted_keys(batches: Iterator[pa.RecordBatch], length: int, hot: Strings | None = None) -> Iterator[pa.RecordBatch]:
    """Keys and how often they occur in this portion (n); with `hot`, all strings of windows whose key is in it."""
    for _, w, _ in keyed_portions(batches, length):
        if hot is None:
            at = w.key[np.append(True, (w.key[1:] != w.key[:-1]) | (w.text[1:] != w.text[:-1]))]
        else:
            own = w.starts[hot.holds(w.hash[w.key])]
            edge = np.zeros(len(w.hash) + w.width + 1, np.int64)
            np.add.at(edge, own, 1)
            np.add.at(edge, own + w.width, -1)
            at = np.flatnonzero(np.cumsum(edge)[: len(w.hash)] > 0)
        h, n = np.unique(w.hash[at], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def frequent_strings(docs: DataFrame, length: int, total: int, least: int) -> Strings:
    """The strings that occur `least` times or more in a sample of about SAMPLE bytes of docs (rank, doc, text): the most
    frequent keys first, then all others of their windows. At most HOT_KEYS and HOT_STRINGS reach the driver."""
    share = min(1.0, SAMPLE / max(total, 1))
    some = docs.where(F.pmod(F.xxhash64("rank", "doc"), F.lit(1 << 40)) < int(share * (1 << 40))).select("text")

    def most(hot: Strings | None, limit: int) -> np.ndarray:
        counts = some.mapInArrow(lambda batches: counted_keys(batches, length, hot), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        return np.array([r["h"] for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(limit).collect()], np.int64).view(np.uint64)

    keys = most(None, HOT_KEYS)
    return Strings(np.concatenate((keys, most(Strings(keys), HOT_STRINGS))) if len(keys) else keys)


def key_batches(batches: Iterator[pa.RecordBatch], length: int, hot: Strings) -> Iterator[pa.RecordBatch]:
    """Rows (h, rank, doc, place), where place holds at + n * 2^32: keys that occur once in this portion (n = 1); for those
    that occur more often all places, known to repeat (n = 0), and one row that tells other portions of it (doc null).
    Of a text's frequent keys, known to repeat everywhere, only the first place is given."""
    for b, w, base in keyed_portions(batches, length):
        new = np.append(True, (w.key[1:] != w.key[:-1]) | (w.text[1:] != w.text[:-1]))
        at, text = w.key[new], w.text[new]
        h = w.hash[at]
        often = hot.holds(h)
        if often.any():
            known = np.flatnonzero(often)
            keep = ~often
            keep[known[np.append(True, text[known][1:] != text[known][:-1])]] = True
            at, text, h, often = at[keep], text[keep], h[keep], often[keep]
        distinct, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        sure = often | (count[inverse] > 1)
        tell = (count > 1) & ~hot.holds(distinct)
        none = np.zeros(int(tell.sum()), np.int64)
        absent = np.append(np.zeros(len(h), bool), np.ones(len(none), bool))
        rank, doc = (np.append(b.column(c).to_numpy()[text], none) for c in ("rank", "doc"))
        place = np.append(at - w.offsets[text] + base + ((~sure).astype(np.int64) << 32), count[tell] << 32)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(h, distinct[tell]).view(np.int64)), pa.array(rank), pa.array(doc, mask=absent), pa.array(place)], ["h", "rank", "doc", "place"])


def runs(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Tables of about `most` rows that hold every row of the values of `column` in them; batches are sorted by it."""
    held, n, enough = [], 0, most
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held)
        value = table[column].to_numpy()
        end = int(np.searchsorted(value, value[-1], "left"))
        if end:
            yield table.slice(0, end)
            held, n = table.slice(end).combine_chunks().to_batches(), n - end
        enough = n + most if end else 2 * n
    if n:
        yield pa.Table.from_batches(held)


def repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places (rank, doc, at) whose key occurs elsewhere."""
    for t in runs(batches, "h", 200_000):
        told = t["doc"].is_null().to_numpy()
        h, rank, place, doc = *(t[c].to_numpy() for c in ("h", "rank", "place")), t["doc"].fill_null(0).to_numpy()
        n = place >> 32
        _, inverse = np.unique(h, return_inverse=True)
        again = ~told & ((n == 0) | (np.bincount(inverse, weights=n)[inverse] > 1))
        yield pa.RecordBatch.from_arrays([pa.array(x[again]) for x in (rank, doc, place & (1 << 32) - 1)], ["rank", "doc", "at"])


def surroundings(batches: Iterator[pa.RecordBatch], length: int, hot: Strings) -> Iterator[pa.RecordBatch]:
    """Rows (h, rank, doc, start, key, windows, bytes): runs of neighbouring windows of one key that may repeat.

    Of equal rows in this portion the first is sent on; the others' windows surely repeat and are given as rows without
    bytes. The task remembers rows of frequent strings that it has sent, and treats later equal ones alike."""
    sent: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    for b, w, base in keyed_portions(batches, length):
        size = b.column("places").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        places = b.column("places").fill_null([]).flatten().to_numpy(zero_copy_only=False) - base + np.repeat(w.offsets[:-1], size)
        wanted = np.zeros(len(w.buf), bool)
        wanted[places[(places >= 0) & (places < len(w.buf))]] = True
        may = wanted[w.key]
        key = w.key
        if hot:
            may |= hot.holds(w.hash[w.key])
            key = w.keys(hot)
        start, key, text = w.starts[may], key[may], w.text[may]
        if not len(start):
            continue
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)))
        count = np.diff(np.append(new, len(start)))
        begin, key, text = start[new], key[new], text[new]
        h, raw = w.hash[key], w.buf.tobytes()
        data = [raw[s : s + c + length - 1] for s, c in zip(begin.tolist(), count.tolist(), strict=True)]
        rank, doc = b.column("rank").to_numpy()[text], b.column("doc").to_numpy()[text]
        local, offset = begin - w.offsets[text] + base, key - begin
        code = pa.array(data, pa.binary()).dictionary_encode().indices.to_numpy()
        order = np.lexsort((local, doc, rank, offset, code, h))
        same = (h[order][1:] == h[order][:-1]) & (code[order][1:] == code[order][:-1]) & (offset[order][1:] == offset[order][:-1])
        later = np.zeros(len(h), bool)
        first = order[np.flatnonzero(np.append(True, ~same))][np.cumsum(np.append(True, ~same)) - 1]
        later[order] = (rank[order] != rank[first]) | (doc[order] != doc[first]) | (local[order] != local[first])
        twice = np.zeros(len(h), bool)
        twice[order] = np.append(False, same) & ~later[order]
        for i in np.flatnonzero(hot.holds(h) & ~later & ~twice).tolist():
            own, what = (int(rank[i]), int(doc[i]), int(local[i])), (int(offset[i]), data[i])
            if (known := sent.get(what)) and known < own:
                later[i] = True
            elif known != own:
                if len(sent) >= SENT:
                    sent.clear()
                sent[what] = own
        keep = ~twice
        cols = {"h": h[keep].view(np.int64), "rank": rank[keep], "doc": doc[keep], "start": local[keep], "key": offset[keep].astype(np.int32), "windows": count[keep].astype(np.int32)}
        bytes_ = pa.array([None if x else d for d, x, k in zip(data, later.tolist(), keep.tolist(), strict=True) if k], pa.binary())
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols.values()), bytes_], [*cols, "bytes"])


def radix_groups(buf: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (numbers into `at`) that equal another of their group through `length` bytes, and their groups.

    Each pass sorts by the next eight bytes within the groups so far; what stands alone then is dropped."""
    words = np.ndarray((max(len(buf) - 7, 0),), ">u8", buf, strides=(1,))
    live = np.arange(len(at))
    _, group = np.unique(group, return_inverse=True)
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        single = np.bincount(group)[group] < 2 if len(group) else np.zeros(0, bool)
        live, group = live[~single], group[~single]
        if not len(live):
            break
        digit = words[at[live] + depth].astype(np.uint64)
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        group = np.cumsum(np.append(False, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
    many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    return live[many], group[many]


def repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges (rank, doc, begin, end) of windows that also start earlier."""
    for t in runs(batches, "h", 20_000):
        sure = t["bytes"].is_null().to_numpy()
        out = [[t[c].to_numpy()[sure] for c in ("rank", "doc", "start", "windows")]]
        rest = t.filter(pa.array(~sure))
        if rest.num_rows:
            buf, offsets = flat(rest["bytes"].combine_chunks())
            h, rank, doc, start, key, windows = (rest[c].to_numpy() for c in ("h", "rank", "doc", "start", "key", "windows"))
            # Windows whose keys lie at different places can't be equal: one such place at a time bounds the memory.
            row = np.repeat(np.arange(len(h)), windows)
            turn = ragged(np.zeros(len(h), np.int64), windows)
            rel = key[row] - turn
            parts = [np.arange(len(row))] if len(row) < 4_000_000 else np.split(np.argsort(rel, kind="stable"), np.cumsum(np.bincount(rel))[:-1])
            hit = []
            for part in parts:
                own, j = row[part], turn[part]
                _, base = np.unique(h[own], return_inverse=True)
                live, group = radix_groups(buf, offsets[own] + j, base * (length + 1) + rel[part], length)
                r, place = own[live], start[own[live]] + j[live]
                order = np.lexsort((place, doc[r], rank[r], group))
                r, place, group, live = r[order], place[order], group[order], live[order]
                head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
                first = np.repeat(head, np.diff(np.append(head, len(group))))
                later = (rank[r] != rank[r[first]]) | (doc[r] != doc[r[first]]) | (place != place[first])
                hit.append(part[live[later]])
            hit = np.sort(np.concatenate(hit))
            if len(hit):
                new = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])))
                count = np.diff(np.append(new, len(hit)))
                r = row[hit[new]]
                out.append([rank[r], doc[r], start[r] + turn[hit[new]], count])
        rank, doc, begin, count = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(doc), pa.array(begin), pa.array(begin + count + length - 1)], ["rank", "doc", "begin", "end"])


def cut_batches(batches: Iterator[pa.RecordBatch], keep: list[str], characters: bool) -> Iterator[pa.RecordBatch]:
    """The texts without the bytes in `ranges`; with `characters`, also without the rest of a character that was split."""
    for whole in batches:
        for b in chunks(whole, "text"):
            buf, offsets = flat(b.column("text"))
            size = b.column("ranges").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ranges, row = b.column("ranges").fill_null([]).flatten(), np.repeat(np.arange(len(size)), size)
            begin, end = (ranges.field(c).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[row] for c in ("begin", "end"))
            order = np.lexsort((begin, row))
            row, begin, reach = row[order], begin[order], np.maximum.accumulate(end[order]) if len(order) else end
            new = np.flatnonzero(np.append(True, (begin[1:] > reach[:-1]) | (row[1:] != row[:-1]))) if len(order) else order
            row, begin, end = row[new], begin[new], reach[np.append(new[1:], len(reach)) - 1] if len(new) else new
            removed = np.bincount(row, weights=end - begin, minlength=len(size)).astype(np.int64)
            spans = np.bincount(row, minlength=len(size))
            if characters:
                inner = lambda at: (at > offsets[row]) & (at < offsets[row + 1]) & (buf[np.minimum(at, len(buf) - 1)] & 0xC0 == 0x80)
                for _ in range(3):
                    begin, end = begin - inner(begin), end + inner(end)
            raw, kept, k = memoryview(buf).cast("B"), [], 0
            cuts = list(zip(begin.tolist(), end.tolist(), strict=True))
            for i, n in enumerate(spans.tolist()):
                at, parts = int(offsets[i]), []
                for s, e in cuts[k : k + n]:
                    parts.append(raw[at : max(s, at)])
                    at = max(e, at)
                kept.append(b"".join([*parts, raw[at : int(offsets[i + 1])]]))
                k += n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(removed), pa.array(spans.astype(np.int64)), pa.array(kept, pa.binary())], [*keep, "n_removed", "n_spans", "kept"])


def repeated_ranges(docs: DataFrame, length: int, frequent: int | None) -> tuple[DataFrame, DataFrame]:
    """docs (row, text) with rank, doc, copy (equals an earlier text) and places (null: nothing in it can repeat); and the
    byte ranges that repeat, a list for each (rank, doc)."""
    text = text_or_empty()
    marked = docs.withColumns({"rank": F.coalesce(F.col("row").getField("doc_id").cast("long"), F.lit(-(1 << 63))), "doc": F.xxhash64(text)})
    id_ = ["rank", "doc"]
    small = written(marked.select(*id_, F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("n")), "text-digests")
    first = written(small.where(F.col("n") >= length).groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "first-texts")
    copies = join_spread(small, first, "digest", id_).where("rank > first").select(*id_).distinct().withColumn("copy", F.lit(True))
    total = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = frequent_strings(marked.select(*id_, "text"), length, total, frequent or 16)
    keys = marked.select(*id_, "text").mapInArrow(lambda b: key_batches(b, length, hot), "h long, rank long, doc long, place long")
    dealt = keys.repartition(F.when(F.col("place") < 1 << 32, F.xxhash64(*id_, "place")).otherwise(F.col("h"))).sortWithinPartitions("h")
    again = dealt.mapInArrow(repeated_keys, "rank long, doc long, at long")
    places = again.groupBy(*id_).agg(F.collect_set("at").alias("places"))  # a row that is repeated is one document
    rows = small.groupBy(*id_).agg(F.count(F.lit(1)).alias("rows"))
    known = written(rows.join(places.join(copies, id_, "full"), id_), "places")
    found = join_spread(marked, known, id_, ["doc"], "left").withColumns({"places": F.when(F.col("copy").isNull(), F.col("places")), "copy": F.col("copy").isNotNull()})
    found = written(found, "texts-with-places", compression="zstd")
    some = found.where("places IS NOT NULL").select(*id_, "text", "places")
    sent = some.mapInArrow(lambda b: surroundings(b, length, hot), "h long, rank long, doc long, start long, key int, windows int, bytes binary")
    dealt = sent.repartition(F.when(F.col("bytes").isNull(), F.xxhash64(*id_, "start")).otherwise(F.col("h"))).sortWithinPartitions("h")
    gone = dealt.mapInArrow(lambda b: repeats(b, length), "rank long, doc long, begin long, end long")
    ranges = gone.groupBy(*id_).agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    return found, written(known.where("copy IS NULL AND places IS NOT NULL").select(*id_, "rows").join(ranges, id_, "left"), "ranges")


def remove_repeats(docs: DataFrame, length: int = 100, frequent: int | None = None, characters: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and `kept`: the UTF-8 bytes of the text without those covered by a string of
    `length` bytes that also starts earlier, in a document of smaller doc_id or earlier in the same one.

    A null text is empty. A null doc_id comes first. Rows of one doc_id are ordered by a hash of their texts; repeated
    rows count as one document and get the same result. Texts shorter than `length` stay whole, and texts of any length
    are worked on in pieces of 64 MB. Matches never cross documents, overlaps count, and all strings are judged on the
    input. A text that equals an earlier one goes whole without sorting its suffixes. `frequent`: from how many
    occurrences in the sample on a string is a frequent one. `characters`: the rest of a character that was split goes
    from `kept` too; n_removed doesn't count it. Other columns stay; those with the added names are replaced. An empty
    table gives none.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    found, ranges = repeated_ranges(aside(docs, "text"), length, frequent)
    text, keep = text_or_empty(), ["row", "text"]
    plain = found.where("places IS NULL").withColumn("n_bytes", F.octet_length(text).cast("long"))
    whole = F.col("copy") & (F.col("n_bytes") >= length)
    plain = plain.withColumns({"n_removed": F.when(whole, F.col("n_bytes")).otherwise(0), "n_spans": whole.cast("long"), "kept": F.when(whole, F.lit("").cast("binary")).otherwise(text.cast("binary"))})
    touched = join_spread(found.where("places IS NOT NULL"), ranges, ["rank", "doc"], ["doc"], "left").select(*keep, "ranges")
    schema = T.StructType([touched.schema[c] for c in keep] + T._parse_datatype_string("n_removed long, n_spans long, kept binary").fields)
    touched = touched.mapInArrow(lambda batches: cut_batches(batches, keep, characters), schema).withColumn("n_bytes", F.octet_length(text).cast("long"))
    out = [*keep, "n_bytes", "n_removed", "n_spans", "kept"]
    return plain.select(out).unionByName(touched.select(out)).select(*back(found, docs.columns, "text"), *out[2:])


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs' rows and columns with the kept bytes as text; a character of which only a part is left goes too, and no other
    one. n_chars follows if present. A text that nothing is removed from stays as it is, a null one null."""
    work = aside(docs, "text")
    found = remove_repeats(work.select("row", "text", F.col("row").getField("doc_id").alias("doc_id")), length, characters=True)
    cut = F.col("n_removed") > 0
    out = found.withColumn("text", F.when(cut, F.col("kept").cast("string")).otherwise(F.col("text")))
    columns = dict(zip(docs.columns, back(out, docs.columns, "text"), strict=True))
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"]).alias("n_chars")
    return out.select(*columns.values())
