"""Counts over a whole text that the quality operators share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The characters that count as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

#: Classes of characters: small and capital letters, digits, spaces, line ends, plain
#: punctuation, symbols, other ASCII, letters and signs beyond ASCII.
CLASSES = ("small", "capital", "digit", "space", "line", "mark", "symbol", "other", "beyond")


def _ascii_classes() -> np.ndarray:
    table = np.full(128, CLASSES.index("other"), np.uint8)
    for c in range(128):
        x = chr(c)
        if x.islower():
            table[c] = 0
        elif x.isupper():
            table[c] = 1
        elif x.isdigit():
            table[c] = 2
        elif x == "\n":
            table[c] = 4
        elif x in SPACES:
            table[c] = 3
        elif x in SYMBOLS:
            table[c] = 6
        elif x in ".,;:!?'\"()-":
            table[c] = 5
    return table


ASCII_CLASSES = _ascii_classes()


def class_counts(text: str) -> np.ndarray:
    """Code points of each class."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = codes[codes < 128]
    counts = np.bincount(ASCII_CLASSES[low], minlength=len(CLASSES)).astype(np.int64)
    counts[-1] += len(codes) - len(low)
    return counts


@dataclass
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    words: list[bytes]


def measure(text: str | None) -> Measures:
    """Words are maximal runs of non-white-space (ASCII); null is the empty text.

    ``n_dup_lines``: lines with a word that equal an earlier line. ``n_repeat_words``:
    words in windows of three that the text holds twice or more, the first included.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # on bytes: ASCII white space only
    seen, repeated, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    return Measures(
        n_words=len(words),
        word_chars=len(text) - sum(map(text.count, SPACES)),
        n_symbols=sum(map(text.count, SYMBOLS)),
        n_dup_lines=repeated,
        n_repeat_words=_repeat_words(words),
        n_lines=lines,
        words=words,
    )


def _repeat_words(words: list[bytes]) -> int:
    first: dict[tuple, int] = {}
    again: list[int] = []
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(w, i)
        if j != i:
            again.append(i)
            again.append(j)
    if not again:
        return 0
    covered = bytearray(len(words))
    for i in again:
        covered[i : i + 3] = b"\1\1\1"
    return covered.count(1)
