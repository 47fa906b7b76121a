"""Words of a text as numbers: what the n-gram rules and the statistics work on."""

from __future__ import annotations

import numpy as np
import xxhash

from plumbline.llm.common import WHITESPACE, Remembered

#: Bytes of words that a worker remembers.
REMEMBERED = 100 << 20


class WordHashes(Remembered):
    """64-bit hash of a word, remembered."""

    def __init__(self, limit: int = REMEMBERED):
        super().__init__(limit)

    def __missing__(self, word: bytes) -> int:
        self.room()
        return self.keep(word, xxhash.xxh3_64_intdigest(word))

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and tab to return: what bytes.split() cuts at."""
    return text.split()


def code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "replace")) if not text.isascii() else len(text)


def chars_in_words(text: bytes) -> int:
    return code_points(text) - (len(text) - len(text.translate(None, WHITESPACE)))


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """How many words stand in a window of ``width`` words that occurs twice or more in the text.

    Exact: words get numbers by equality, windows numbers by equality of their words' numbers."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    key, top = ids[: n - width + 1], len(number)
    for j in range(1, width):
        if top * len(number) >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            top = int(key.max()) + 1
        key = key * len(number) + ids[j : n - width + 1 + j]
        top *= len(number)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(width):
        covered[j : n - width + 1 + j] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    full = [x for x in lines if x.split(None, 1)]
    return len(full) - len(set(full))
