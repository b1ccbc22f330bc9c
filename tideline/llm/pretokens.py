"""Vectorised cutting of texts into the words that byte-level BPE works on, and a cache of what each word becomes.

The cut follows the pattern that the public byte-level vocabularies share (contractions; letters, numbers or other
signs with one space before them; white space). Words lie end to end, so they are an Arrow array over the text's own
bytes, and each distinct word of a partition is encoded once.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tideline.llm.common import binary_array, flat, ragged, sums

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space (fixed values).
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE] = SPACE
    return out


def byte_classes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the character that each byte belongs to, and which bytes begin a character."""
    table = classes()
    kinds, lead = table[:256][buf], np.ones(len(buf), bool)
    high = np.flatnonzero(buf >= 0x80)
    if len(high):
        lead[high] = buf[high] >= 0xC0
        at = high[lead[high]]
        first = buf[at].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | buf[at[more] + k] & 0x3F
        kind = table[point]
        for k in (0, 1, 2, 3):
            more = size > k
            kinds[at[more] + k] = kind[more]
    return kinds, lead


def word_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where words begin; a text's end is a word's end."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kinds, lead = byte_classes(buf)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    run = begins[:n].copy()
    run[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    after_blank = np.zeros(n, bool)  # the byte before is a blank of the same text
    after_blank[1:] = (buf[:-1] == 0x20) & ~begins[1:n]
    starts = run & (space | ~after_blank)
    # The last white space before something else begins a word (its own, or that of what follows).
    ends = np.flatnonzero(space[:-1] & ~space[1:] & ~begins[1:n])
    while len(back := np.flatnonzero(~lead[ends])):
        ends[back] -= 1
    starts[ends] = True
    quote = np.flatnonzero((buf == 0x27) & run & ~after_blank)
    if len(quote):
        limit = offsets[np.searchsorted(offsets, quote, "right")]  # the end of the text
        one = np.where(quote + 1 < limit, buf[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 < limit, buf[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        starts[quote[short | long] + 1] = False
        over = np.concatenate((quote[short] + 2, quote[long] + 3))
        starts[over[over < n]] = True
    return np.flatnonzero(starts)


@functools.cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabulary files: itself if it prints, else the next one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words:
    """What each distinct word becomes, kept for a partition. `encode` gets distinct words and returns lists of ids."""

    def __init__(self, encode: Callable[[list[bytes]], list], most: int = 400_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, words: list[bytes]) -> np.ndarray:
        """Places of the words, after those not seen before have been encoded."""
        if len(self.index) > self.most:
            self.clear()
        new = [w for w in words if w not in self.index]
        if new:
            found = self.encode(new)
            size = np.fromiter(map(len, found), np.int64, len(found))
            begin = len(self.ids) + np.cumsum(size) - size
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, *(np.asarray(x, np.uint32) for x in ([i for f in found for i in f],))])
            self.begin, self.size = np.concatenate((self.begin, begin)), np.concatenate((self.size, size))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word of the texts, and the texts' offsets in that list."""
        buf, offsets = flat(texts)
        starts = word_starts(buf, offsets)
        coded = binary_array(buf, np.append(starts, len(buf))).dictionary_encode()
        place = self.take(coded.dictionary.to_pylist())
        return place[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64), np.searchsorted(starts, offsets)

    def counts(self, texts: pa.Array) -> np.ndarray:
        place, offsets = self.places(texts)
        return sums(self.size[place], offsets)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the texts' offsets in them."""
        place, offsets = self.places(texts)
        size = self.size[place]
        return self.ids[ragged(self.begin[place], size)], np.concatenate(([0], np.cumsum(size)))[offsets]


class LibraryWords(Words):
    """Ids as the `tokenizers` library gives them for a byte-level vocabulary file, without special tokens at the ends.

    Strings of added tokens inside a text are that token, the library's default; texts that hold one go to the library
    whole. So does every text if the file's normaliser or pre-tokeniser isn't the plain byte-level one."""

    def __init__(self, path: str, fast: bool = False):
        """fast: distinct words are merged by `tiktoken`'s engine with the file's own vocabulary, about eight times as
        fast; only where each merge's id follows the merge order, so that both give the same ids (tested)."""
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.plain = not made.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [x["content"] for x in made.get("added_tokens", [])]
        super().__init__(self.engine(made["model"]) if fast and self.plain else lambda words: self.whole([w.decode() for w in words]))

    def engine(self, model: dict) -> Callable[[list[bytes]], list]:
        import tiktoken

        back = {v: k for k, v in byte_letters().items()}
        added = set(self.added)
        ranks = {bytes(back[c] for c in x): i for x, i in model["vocab"].items() if x not in added}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        if model.get("ignore_merges") or ids != sorted(ids) or len(set(ids)) + 256 != len(ranks):
            return lambda words: self.whole([w.decode() for w in words])
        one = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        return lambda words: list(map(one, words))

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def odd(self, texts: pa.Array) -> np.ndarray:
        import pyarrow.compute as pc

        if not self.plain:
            return np.ones(len(texts), bool)
        found = np.zeros(len(texts), bool)
        for x in self.added:
            found |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        return found

    def counts(self, texts: pa.Array) -> np.ndarray:
        texts = texts.fill_null("")
        out = super().counts(texts)
        for i in np.flatnonzero(self.odd(texts)):
            out[i] = len(self.whole([texts[i].as_py()])[0])
        return out

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        ids, offsets = super().encoded(texts)
        odd = np.flatnonzero(self.odd(texts))
        if not len(odd):
            return ids, offsets
        parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        for i in odd:
            parts[i] = np.asarray(self.whole([texts[i].as_py()])[0], np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
