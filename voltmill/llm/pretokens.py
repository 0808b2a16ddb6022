"""Splitting text into pretokens as the public byte-level pattern does, on byte arrays.

The pattern (a fixed value of the tokenizer files) is
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its matches tile the text, so it is enough to know where a match starts:

* at every change between letters, numbers, white space and the rest;
* white space before a word gives up its last character: a blank joins the word, any other character stands alone;
* a lone apostrophe takes the letters of a contraction with it.
"""

from __future__ import annotations

import numpy as np
import regex

from voltmill.llm import arrays

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions of the pattern.
_CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _make_classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, _OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, points):
            low, high = ord(points[found.start()]), ord(points[found.end() - 1])
            table[low : high + 1] = kind
    table[_WHITE_SPACE] = _SPACE
    return table


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = arrays.kept_by_worker("classes of code points", _make_classes)
    classes = table[: 256][data]
    leads = np.flatnonzero(data >= 0xC0)
    if len(leads):
        first = data[leads].astype(np.int64)
        extra = 1 + (first >= 0xE0) + (first >= 0xF0)
        points = first & (0x3F >> extra)
        for k in (1, 2, 3):
            has = extra >= k
            at = leads[has] + k
            points[has] = points[has] << 6 | (data[np.minimum(at, len(data) - 1)] & 0x3F)
        kinds = table[np.minimum(points, 0x10FFFF)]
        classes[leads] = kinds
        for k in (1, 2, 3):
            has = extra >= k
            classes[leads[has] + k] = kinds[has]
    return classes


def pretoken_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorted byte positions where a pretoken starts; each ends where the next or the next row starts."""
    size = len(data)
    if size == 0:
        return np.zeros(0, np.int64)
    classes = _byte_classes(data)
    row_edge = np.zeros(size + 1, bool)
    row_edge[bounds] = True
    change = np.ones(size + 1, bool)
    change[1:size] = classes[1:] != classes[:-1]
    change |= row_edge
    runs = np.flatnonzero(change)
    begin, end = runs[:-1], runs[1:]
    kind = classes[begin]
    starts = change.copy()
    # white space that is followed by something else in the same row
    gives = (kind == _SPACE) & ~row_edge[end]
    last = end[gives] - 1
    while True:
        inner = (data[last] & 0xC0) == 0x80
        if not inner.any():
            break
        last = last - inner
    starts[last] = True
    starts[end[gives][data[last] == 0x20]] = False
    # lone apostrophes
    lone = np.flatnonzero((kind == _OTHER) & (end - begin == 1) & (data[begin] == 0x27) & starts[begin] & ~row_edge[end])
    lone = lone[lone + 1 < len(begin)]
    lone = lone[kind[lone + 1] == _LETTER]
    if len(lone):
        letters, letters_end = begin[lone + 1], end[lone + 1]
        one = data[letters]
        two = np.where(letters + 1 < letters_end, data[np.minimum(letters + 1, size - 1)], 0)
        taken = np.zeros(len(lone), np.int64)
        for word in reversed(_CONTRACTIONS):
            hit = (one == word[0]) if len(word) == 1 else (one == word[0]) & (two == word[1])
            taken[hit] = len(word)
        hit = taken > 0
        starts[letters[hit]] = False
        starts[letters[hit] + taken[hit]] = True
    return np.flatnonzero(starts[:size])
