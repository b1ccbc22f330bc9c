"""Vectorised statistics of whole texts: words, lines, repeated windows. Helpers of the quality operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tideline.llm.common import binary_array, flat, sums

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(range(0x41, 0x5B))] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?.,;:")] = True


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words `[^\\x20\\x09-\\x0D]+`, none across texts."""
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~_WHITE[buf]
    begins = inside.copy()
    begins[1:] &= _WHITE[buf[:-1]] | edge[1:n]
    stops = inside.copy()
    stops[:-1] &= _WHITE[buf[1:]] | edge[1:n]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal slices get equal numbers. The slices are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.int64)
    cuts = np.empty(2 * len(starts) + 1, np.int64)  # slice, gap, slice, gap ...
    cuts[0:-1:2], cuts[1::2], cuts[-1] = starts, ends, ends[-1]
    return binary_array(buf[: ends[-1]], cuts[:-1]).take(pa.array(np.arange(0, 2 * len(starts) - 1, 2))).dictionary_encode().indices.to_numpy().astype(np.int64)


def line_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of all \\n-split lines, in order; an empty text has one empty line."""
    breaks = np.flatnonzero(buf == 0x0A)
    of = np.searchsorted(offsets, breaks, "right") - 1
    n = len(offsets) - 1
    text = np.concatenate((np.arange(n), of))
    starts = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    ends = np.where(last, offsets[text + 1], np.append(starts[1:], 0) - 1)
    return starts, ends, text


def windows(word: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of `width` words that its text holds twice or more."""
    n = len(word)
    covered = np.zeros(n, bool)
    if n <= width:
        return covered
    key = word
    for k in range(1, width):  # pairs, then threes ...: numbers stay small, so nothing overflows
        size = n - k
        _, key = np.unique(key[:size] * (word.max() + 1) + word[k:], return_inverse=True)
    whole = text[: n - width + 1] == text[width - 1 :]
    at = np.flatnonzero(whole)
    _, inverse, count = np.unique(text[at] * (key.max() + 1) + key[at], return_inverse=True, return_counts=True)
    hit = at[count[inverse] > 1]
    for k in range(width):
        covered[hit + k] = True
    return covered


def quality_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_punct (int64)."""
    buf, offsets = flat(texts)
    starts, ends = word_bounds(buf, offsets)
    at = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    point = (buf & 0xC0) != 0x80
    line_start, line_end, line_text = line_bounds(buf, offsets)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_text = line_start[has_word], line_end[has_word], line_text[has_word]
    line = codes(buf, line_start, line_end)
    distinct = np.unique(line_text * (line.max(initial=0) + 1) + line) // (line.max(initial=0) + 1)
    n = len(offsets) - 1
    n_lines = np.bincount(line_text, minlength=n)
    return {
        "n_words": np.diff(at),
        "word_chars": sums(point & ~_WHITE[buf], offsets),
        "n_symbols": sums(_SYMBOL[buf], offsets),
        "n_dup_lines": n_lines - np.bincount(distinct, minlength=n),
        "n_repeat_words": sums(windows(codes(buf, starts, ends), text, 3), at),
        "n_lines": n_lines,
        "n_upper": sums(_UPPER[buf], offsets),
        "n_punct": sums(_PUNCT[buf], offsets),
    }
